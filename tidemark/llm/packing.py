"""Packing token sequences by Karmarkar-Karp multiway differencing.

Whole windows are cut off a document first; the remainders of a bundle of documents are divided
among windows by largest differencing: each item starts as a partial partition (its size and
zeros); the two partial partitions with the largest imbalance merge, the fullest window of one
with the emptiest of the other, until one is left.  If a window would hold more than the capacity,
the bundle is divided anew among one more window.  Bundles are consecutive rows of an input
partition, so nothing is shuffled and a lost task is repeated alike.

Defined results: null and empty texts are a single end id; repeated rows are packed each; an empty
table gives an empty result; extra columns are ignored.  A bundle holds at most BUNDLE_WINDOWS
windows of remainders, whatever the input's size.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import claim, table, texts, tokenizer

CAPACITY = 2048
END_ID = 1
BUNDLE_WINDOWS = 64
#: Remainders are cut into items of at most so many ids: small items balance better.
ITEM = 512
KEPT = 600_000
#: Words encoded as one text when they are learned, and what stands between them.
CHAIN, MARK = 256, "|"
#: ASCII and composed Latin-1 letters: stable under NFC, lower case by single characters.
PLAIN = re.compile(r"[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class Words:
    """Ids as bytes, by words: the tokenizer drops white space, so a blank always ends a token."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        # Lower-casing is all that the normalizer does to PLAIN words; without it they cost half.
        self.bare = type(self.tok).from_str(self.tok.to_str())
        self.bare.normalizer = None
        self.kept: dict[str, bytes] = {"": b""}
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids

    def clear(self) -> None:
        self.kept = {"": b""}

    def learn(self, new: list[str]) -> None:
        """Many words as one text, with a mark between them; words that hold the mark alone."""
        fast = {w: w.lower() for w in new if PLAIN.fullmatch(w)}
        self.encode(sorted({v for v in fast.values() if v not in self.kept}), self.bare)
        self.kept |= {w: self.kept[v] for w, v in fast.items()}
        self.encode([w for w in new if w not in fast], self.tok)

    def encode(self, new: list[str], tok) -> None:
        plain = [w for w in new if MARK not in w]
        groups = [plain[i : i + CHAIN] for i in range(0, len(plain), CHAIN)]
        alone = [w for w in new if MARK in w]
        for group, e in zip(groups, tok.encode_batch_fast([f" {MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            for w, a, b in zip(group, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                self.kept[w] = ids[a:b].tobytes()
        for w, e in zip(alone, tok.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self.kept[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids of the whole text."""
        claim(self)
        plain = "<|" not in text and PLAIN_TEXT.fullmatch(text)
        if plain:
            words = UNIT.findall(text.lower())
        else:
            words = text.replace("\n", " ").split(" ")
        new = [w for w in set(words) if w not in self.kept]
        if new:
            if len(self.kept) + len(new) > KEPT:
                self.clear()
                new = list(set(words) - {""})
            self.encode(new, self.bare) if plain else self.learn(new)
        return b"".join(map(self.kept.__getitem__, words))


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of the items of each window."""
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for i, n in enumerate(sizes):
        heapq.heappush(heap, (-n, i, [(n, [i])]))
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Sorted from full to empty; windows that aren't listed hold the same least load.
        a += [(0, [])] * (windows - len(a))
        b += [(0, [])] * (windows - len(b))
        merged = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda w: -w[0])
        least = merged[-1][0]
        tick += 1
        # Loads stay absolute in the lists; the imbalance is what orders the heap.
        heapq.heappush(heap, (-(merged[0][0] - least), tick, merged))
    return [p for _, p in heap[0][2]] if heap else []


def divide(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most the capacity, near equal; their number rises while one is too full."""
    n = max(1, -(-sum(sizes) // capacity))
    while sizes:
        out = [w for w in difference(sizes, n) if w]
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        n += 1
    return []


#: A text of such characters only is split as the pre-tokenizer splits it: far fewer kinds of units
#: than words with their punctuation.
PLAIN_TEXT = re.compile(r"[\n\r\t -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
UNIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str = "word_bpe_49k.json", capacity: int = CAPACITY, bundle_windows: int = BUNDLE_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece; sequence ids are the partition's number and a count within it."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    arrow = pa.schema(_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 36
        encode = words(path).ids
        rows: list[tuple] = []
        rest: list[tuple[int, int, int, int, int]] = []
        held = 0

        def close() -> None:
            nonlocal sequence, rest, held
            for window in divide([r[2] for r in rest], capacity):
                at = 0
                for i in window:
                    rows.append((*rest[i], sequence, at))
                    at += rest[i][2]
                sequence += 1
            rest, held = [], 0

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n = len(ids) // 4
                for start in range(0, n - capacity + 1, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, sequence, 0))
                    sequence += 1
                if left := n % capacity:
                    if held + left > bundle_windows * capacity:
                        close()
                    for start in range(n - left, n, ITEM):
                        part = ids[4 * start : 4 * (start + ITEM)]
                        rest.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                    held += left
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=arrow)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=arrow)

    return texts(docs, "doc_id").mapInArrow(run, _SCHEMA)


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
