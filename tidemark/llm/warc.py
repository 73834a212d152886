"""WARC archives: one gzip member per record, written by tasks and read back by byte ranges.

A reading task owns the records that start inside its range.  It looks for the gzip magic, decodes
the header of each candidate to be sure that a record starts there, and then follows the members,
past its range's end for the last one.

Defined results: a null html is an empty payload; a null url is written as urn:page:<id>; rows of
one page_id with equal payloads are one capture written more than once and get the same type; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: Payloads below this size are never revisits.
LEAST = 100


def _opened(uri: str):
    """File system and path of a URI; only shared or remote folders come here."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """Fields of a decoded record; the payload's digest and length are taken from its bytes if it
    has them, else from the headers that a revisit repeats."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    number = lambda s: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)>", s)) else None
    length = re.search(rb"(?i)content-length: (\d+)", http)
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
        "payload_bytes": int(length[1]) if revisit else len(payload), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": number(fields.get("warc-refers-to", "")), "payload": None if revisit else payload,
    }


def write(pages: DataFrame, path: str, least: int = LEAST) -> int:
    """Archives under path, one for each task; returns the number of records.

    Only digests are grouped, and only (id, digest) meets a digest's first capture; bodies are
    joined by id and digest, so the copies of one body are dealt like any others.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    found = rows.select("page_id", "digest").join(first, "digest").groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    found = found.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first")
    rows = rows.join(found, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = TaskContext.get()
        files, base = _opened(path)
        files.create_dir(base)
        name, n = f"{base}/part-{c.partitionId():06d}.warc.gz", 0
        part = f"{base}/_{c.partitionId():06d}-{c.taskAttemptId()}"
        with files.open_output_stream(part, compression=None) as out:
            for b in batches:
                at = {k: b.schema.get_field_index(k) for k in ("page_id", "url", "html", "digest", "first")}
                for page, url, html, digest, of in zip(*(b.column(at[k]).to_pylist() for k in at), strict=True):
                    out.write(record(page, url, html.encode(), digest, of if of is not None and of != page else None))
                    n += 1
        # Renamed when complete: a lost or repeated task leaves no half archive behind.
        if n:
            files.move(part, name)
        else:
            files.delete_file(part)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def scan(files, path: str, start: int, end: int) -> Iterator[bytes]:
    """The decoded records that start in [start, end) of an archive."""
    with files.open_input_file(path) as f:
        size = f.size()
        at, buffer = start, b""  # buffer holds the bytes from `at` on

        def more(k: int = READ_BYTES) -> bool:
            nonlocal buffer
            got = f.read_at(min(k, max(0, size - at - len(buffer))), at + len(buffer))
            buffer += got
            return bool(got)

        while at < end:
            found = buffer.find(MAGIC)
            if found < 0:
                drop = max(0, len(buffer) - 2)
                at, buffer = at + drop, buffer[drop:]
                if not more():
                    return
                continue
            at, buffer = at + found, buffer[found:]
            if at >= end:
                return
            z, parts, used, sound = zlib.decompressobj(31), [], 0, True
            try:
                while not z.eof:
                    if used == len(buffer) and not more():
                        sound = False
                        break
                    piece = buffer[used : used + READ_BYTES]
                    parts.append(z.decompress(piece))
                    used += len(piece)
                    text = parts[0] if len(parts[0]) >= 7 else b"".join(parts)
                    if len(text) >= 7 and not text.startswith(b"WARC/1."):
                        sound = False
                        break
            except zlib.error:
                sound = False
            if sound:
                yield b"".join(parts)
                used -= len(z.unused_data)
                at, buffer = at + used, buffer[used:]
            else:
                at, buffer = at + 1, buffer[1:]


def read(spark: SparkSession, path: str, split: int = SPLIT_BYTES, payload: bool = False) -> DataFrame:
    """The records of all archives under path; ranges come from the files' lengths alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payload else {})
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    arrow = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, name = _opened(uri)
                rows: list[dict] = []
                for data in scan(files, name, start, start + split):
                    rows.append({k: v for k, v in parse(data).items() if k in kinds})
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    # Dealt round by round: ranges, unlike files, are of equal size.
    return ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def op10_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = fresh_path(spark, "warc")
    n = write(pages, path)
    out = read(spark, path) if n else spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
