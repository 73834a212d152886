"""The training-data queries: one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, fingerprint, licenses, neardup, packing, pii, quality, suffixes, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": pii.op1_pii_spans,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_bpe_round_trip": bpe.op3_bpe_round_trip,
    "op4_suffix_dedup": suffixes.op4_suffix_dedup,
    "op5_pack_sequences": packing.op5_pack_sequences,
    "op6_quality_scores": quality.op6_quality_scores,
    "op7_fingerprints": fingerprint.op7_fingerprints,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_media_audio": audio.op9_media_audio,
    "op10_warc_records": warc.op10_warc_records,
}
#: SQL for the operators that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    # Every 200-byte string of every text (hex, two digits a byte) by its digest; runs of covered bytes; what lies between.
    "op4_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT r, q, substr(h, 2 * q + 1, 2 * (256 + 199)) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2, 256)) AS q FROM d)),
w AS (SELECT r, q + o AS pos, md5(substr(h, 2 * o + 1, 400)) AS k FROM (SELECT r, q, h, unnest(range(length(h) // 2 - 199)) AS o FROM b WHERE length(h) >= 400)),
c AS (SELECT r, pos FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
i AS (SELECT r, pos, sum(opens) OVER (PARTITION BY r ORDER BY pos) AS run FROM
      (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 200 THEN 0 ELSE 1 END AS opens FROM c)),
s AS (SELECT r, min(pos) AS a, max(pos) + 200 AS b FROM i GROUP BY r, run),
g AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM s
      UNION ALL SELECT d.r, coalesce(max(s.b), 0), max(length(h)) // 2 FROM d LEFT JOIN s USING (r) GROUP BY d.r),
k AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM g JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN n USING (r)""",
    "op10_warc_records": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE octet_length(encode(html)) >= 100 GROUP BY html)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (html)""",
}
