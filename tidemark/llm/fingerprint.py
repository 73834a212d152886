"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each shingle of five words is hashed once; the top bits of its hash name a bin and each bin keeps
its least hash.  An empty bin copies the bin that a fixed random sequence of its own first finds
filled.  The low BITS of each bin are packed; likeness is the share of equal bins, corrected for
chance agreement of so few bits.

Defined results: a null text counts as empty; a text of fewer than five words is one shingle of all
its words (an empty text one empty shingle); documents are ordered by id (null first), ties by text;
repeated rows are neighbours of each other; in a table of one row the next document is itself; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, table, texts

BINS_LOG, BITS, WORDS = 8, 8, 5
BINS = 1 << BINS_LOG
KEPT = 150_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHash:
    """64-bit hashes of words; those seen lately are kept, within a bound."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        claim(self.kept)
        new = [w for w in set(words) if w not in self.kept]
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(set(words))
        for w in new:
            self.kept[w] = xxhash.xxh3_64_intdigest(w.encode())
        return np.fromiter(map(self.kept.__getitem__, words), np.uint64, len(words))


@functools.lru_cache(maxsize=1)
def word_hash() -> WordHash:
    return WordHash()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def shingles(words: list[str], size: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `size` words; of all the words if they are fewer."""
    h = word_hash()(words or [""])
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


@functools.lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    return np.random.default_rng(20240101).integers(0, BINS, size=(BINS, 8 * BINS))


def fingerprint(text: str) -> bytes:
    h = shingles(text.split())
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    where = (h >> np.uint64(64 - BINS_LOG)).astype(np.intp)
    value = h & np.uint64((1 << (64 - BINS_LOG)) - 1)
    np.minimum.at(least, where, value)
    filled = least != np.iinfo(np.uint64).max
    empty = np.flatnonzero(~filled)
    if len(empty):
        donors = _donors()[empty]
        hit = filled[donors]
        pick = donors[np.arange(len(empty)), hit.argmax(axis=1)]
        missed = ~hit.any(axis=1)
        if missed.any():
            # The sequence found nothing: the next filled bin, in a circle.
            full = np.flatnonzero(filled)
            pick[missed] = full[np.searchsorted(full, empty[missed]) % len(full)]
        least[empty] = least[pick]
    return (least & np.uint64((1 << BITS) - 1)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard likeness from packed bins, 0 to 1."""
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 1 / (1 << BITS)
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def _bucket(ids: list, bounds: np.ndarray) -> np.ndarray:
    low = np.iinfo(np.int64).min
    return np.searchsorted(bounds, np.array([low if i is None else i for i in ids], np.int64), side="right")


def with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Rows (bucket, extra, doc_id, text) dealt so that each bucket is an interval of ids, and each
    bucket's first document also ends the bucket before it (extra = 1).

    Only `buckets` numbers are held by the driver: approximate quantiles of the ids, then the least
    id of each bucket.
    """
    low = np.iinfo(np.int64).min
    ids = docs.select("doc_id")
    cuts = ids.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0] if buckets > 1 else []
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(_bucket(got, bounds), pa.int64()), "id": pa.array([low if i is None else i for i in got], pa.int64())})

    firsts = np.array(sorted(r[0] for r in ids.mapInArrow(number, "bucket long, id long").groupBy("bucket").agg(F.min("id")).select("min(id)").collect()), np.int64)
    last = len(firsts) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, text = b.column(0), b.column(1)
            key = np.array([low if i is None else i for i in got.to_pylist()], np.int64)
            own = np.searchsorted(firsts, key, side="right") - 1
            first = np.flatnonzero(firsts[own] == key)
            before = np.where(own[first] == 0, last, own[first] - 1)
            yield _dealt(own, np.zeros(len(own)), got, text)
            if len(first):
                yield _dealt(before, np.ones(len(first)), got.take(pa.array(first)), text.take(pa.array(first)))

    return texts(docs, "doc_id").mapInArrow(deal, "bucket long, extra int, doc_id long, text string"), len(firsts)


def _dealt(bucket, extra, ids: pa.Array, text: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(extra.astype(np.int32), pa.int32()), ids, text.cast(pa.string())], names=["bucket", "extra", "doc_id", "text"])


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, buckets = with_next(docs, 4 * parts)
    arrow = pa.schema(_FIELDS)

    def row(doc_id, text: str, print_: bytes, head: str, next_print: bytes) -> tuple:
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + head[:quarter]
        other = print_ if edited == text else fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_.hex(), other.hex(), likeness(print_, other), likeness(print_, next_print)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # bucket, id, text and fingerprint of the row that waits for its next
        for b in batches:
            rows = []
            for bucket, extra, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if extra and held is None:
                    continue  # more rows with the first id of the next bucket
                print_ = held[3] if held and held[2] == text else fingerprint(text)
                if held is not None:
                    rows.append(row(held[1], held[2], held[3], text, print_))
                held = None if extra else (bucket, doc_id, text, print_)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=arrow)

    # Every bucket ends with an extra row, so several buckets may follow each other in a partition;
    # buckets are of about equal size, and so are partitions of as many buckets each.
    each = -(-max(1, buckets) // parts)
    dealt = dealt.repartitionById(parts, (F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket", "extra", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
