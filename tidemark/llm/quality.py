"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Training uses a bounded sample of labelled documents (SAMPLE rows, those with the smallest hash of
their id, so it is the same on every run); their hashed features, not their texts, are learned from
in one task.  Scoring is a sparse dot product with a table of 2^BITS weights, which is the size of
what is broadcast whatever the input.

Defined results: a null text counts as empty; an empty text is scored by its bias and its "empty"
feature; a document labelled more than once has label 1 if most of its labels are 1 (a tie is 1);
null labels don't count; without usable labels the score is 0.5; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, map_rows, table, texts

BITS = 18
SAMPLE = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.3, 1.0
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_MASK = (1 << BITS) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hash of words, kept for those seen lately."""

    def __init__(self, most: int = 150_000):
        self.kept: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        kept = self.kept
        claim(kept)
        if len(kept) > self.most:
            kept.clear()
        for w in set(words):
            if w not in kept:
                kept[w] = zlib.crc32(w.encode()) | (zlib.adler32(w.encode()) << 32)
        return np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))


@functools.lru_cache(maxsize=1)
def hasher() -> Hasher:
    return Hasher()


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(64 - BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: unigrams, bigrams, and shape features; values have norm 1 or less."""
    words = _WORD.findall(text.lower())
    shape = [f"#len{len(text).bit_length()}", f"#words{len(words).bit_length()}"]
    if words:
        n, kinds = len(words), set(words)
        letters = sum(map(str.isalpha, kinds))
        shape += [f"#unique{int(8 * len(kinds) / n)}", f"#alpha{int(8 * letters / len(kinds))}", f"#upper{int(8 * sum(map(str.isupper, text)) / len(text))}", f"#mean{min(15, sum(map(len, words)) // n)}"]
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        shape += [f"#same{int(12 * same / n)}", f"#bigrams{int(8 * len(set(zip(words, words[1:], strict=False))) / n)}"]
        shape += [f"#punct{min(12, int(16 * sum(map(text.count, '!#$%&*|')) / n))}", f"#lines{min(12, int(32 * text.count(chr(10)) / n))}"]
    s = hasher()(shape)
    parts = [_mixed(s, 11)]
    if words:
        h = hasher()(words)
        parts += [_mixed(h, 1), _mixed(h[:-1] * np.uint64(3) + (h[1:] ^ (h[1:] >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93), 2)]
    grams = np.concatenate(parts[1:]) if words else np.empty(0, np.uint64)
    idx, count = np.unique(grams, return_counts=True)
    value = np.sqrt(count)
    value /= max(1.0, np.sqrt((value**2).sum()))
    return np.concatenate([idx, parts[0]]).astype(np.int64), np.concatenate([value, np.full(len(s), 0.5)])


def train(rows: Iterator[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over the rows in the given order; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    rows = list(rows)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, value, label = rows[r]
            i, x = np.append(idx, size - 1), np.append(value, 1.0)
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1 * (i != size - 1), 0.0, -(zi - np.sign(zi) * L1 * (i != size - 1)) / ((BETA + root) / ALPHA + L2 * 0.01))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(ni + g * g) - root) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
    root, l1 = np.sqrt(n), np.full(size, L1)
    l1[-1] = 0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + root) / ALPHA + L2 * 0.01)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int | None = 1) -> np.ndarray:
    """Weights from at most `sample` labelled documents; those of the held-out fold are never read."""
    lab = labels.where("doc_id is not null and quality is not null")
    if held_out is not None:
        lab = lab.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != held_out)
    lab = lab.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # At most `sample` rows: the smallest hashes.  This bound is what allows the broadcast.
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = texts(docs, "doc_id").join(F.broadcast(lab), "doc_id").select("doc_id", "text", "y")
    picked = picked.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))

    def hashed(b: dict[str, list]) -> dict[str, list]:
        got = [features(t) for t in b["text"]]
        return {"doc_id": b["doc_id"], "y": b["y"], "i": [g[0].astype("<i4").tobytes() for g in got], "v": [g[1].astype("<f4").tobytes() for g in got]}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        w = train((np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float), y) for _, y, i, v in rows)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    # One task on purpose: it gets `sample` rows at most.
    out = map_rows(picked, hashed, "doc_id long, y int, i binary, v binary").coalesce(1).mapInArrow(learn, "w binary").collect()
    return np.frombuffer(out[0]["w"], np.float32) if out else np.zeros((1 << BITS) + 1, np.float32)


def score_text(text: str, w: np.ndarray) -> float:
    idx, value = features(text)
    return float(1 / (1 + np.exp(-np.clip(w[idx] @ value + w[-1], -35, 35))))


def score(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(w))

    def run(b: dict[str, list]) -> dict[str, list]:
        weights = _weights(shared)
        s = [score_text(t, weights) for t in b["text"]]
        return {"doc_id": b["doc_id"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

    out = map_rows(texts(docs, "doc_id"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"), "score", "predicted")


def _weights(shared) -> np.ndarray:
    return _loaded(shared.value)


@functools.lru_cache(maxsize=2)
def _loaded(packed: bytes) -> np.ndarray:
    return pickle.loads(packed)


def keep(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """All columns of the documents that the classifier takes, texts unchanged (null as null)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(w))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _weights(shared)
        for b in batches:
            yield b.filter(pa.array([score_text(t or "", weights) >= 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
