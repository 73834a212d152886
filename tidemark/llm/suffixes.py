"""Suffix-array de-duplication: bytes covered by a 200-byte string that starts anywhere else.

1. Winnowing.  Every 200-byte window is assigned to the least hash (the first, on ties) of the GRAM-
   byte strings inside it, its anchor.  Equal windows have equal anchors.  Neighbouring windows with
   one anchor are a run; each window is in exactly one run, so no window meets itself.  Only runs,
   with a hash of their bytes, are counted and shuffled.
2. Runs whose anchor occurs once are dropped.  Runs whose bytes occur more than once are covered as
   a whole.  Where an anchor has different bytes, one copy of each is sought: these meet by anchor.
   A run whose anchor lies at several of its places may repeat inside itself and is sought too.
3. In a task, a suffix array over the runs is built by two-stage sorting: suffixes smaller than
   their successors are sorted directly, the rest induced by bucket scans.  Adjacent common prefixes
   of 200 bytes mark repeated starts.
4. An anchor with more than HOT different runs, or PLENTY bytes, is dealt over several tasks.  What
   they find is completed by the hashes of the distinct windows of such anchors, over all tasks: a
   task packs them by bucket of the hash, a row for each bucket and BATCH windows; a bucket tells
   which occur twice, by their numbers in the batch; these go back to the places of the batch and
   become ranges there.

Texts are shuffled once, by id and hash: the step that takes runs out of them and the step that
removes what was found read the same exchange.  "Same bytes" of two runs of one anchor is decided
by 64-bit hashes.

Defined results: null texts count as empty; texts under 200 bytes lose nothing; repeated rows are
copies of each other; matches never cross documents; an empty table gives an empty result; extra
columns are ignored by the digest and kept by `remove`.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table, trim

LENGTH, GRAM = 200, 32
#: Different runs and bytes of an anchor that may meet in one task, and bytes sorted at once.
HOT, PLENTY, CHUNK = 4096, 4 << 20, 1 << 19
#: Windows packed together by a task, and windows of a bucket, about.
BATCH, BUCKET = 1 << 18, 1 << 20
#: A window: its hash, and its number in the batch (or NONE, if it is covered already).
_WINDOW, _NONE = np.dtype([("hi", "<u8"), ("lo", "<u8"), ("at", "<u4")]), (1 << 32) - 1
#: A piece of a batch: the text, its first start, and the number of its first window.
_PLACE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("first", "<i8"), ("at", "<u4")])
#: A run's place in one number: first start, whether it may repeat inside itself, starts after the first.
_LONGEST = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    out = []
    for b in (_BASE, _INVERSE):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of `width` bytes."""
    n = len(data)
    up, down = _powers(max(1 << 16, 1 << (n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[width:] - sums[: n + 1 - width]) * down[: n + 1 - width])


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each run of windows that share one anchor, and whether the
    anchor lies at several places of the run (without which no window repeats inside it)."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, bool)
    h = rolling(data, gram)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (_least(packed, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    anchor = h[at]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    if len(at) > _LONGEST:
        first = np.union1d(first, np.arange(0, len(at), _LONGEST))
    last = np.append(first[1:], len(at)) - 1
    return anchor[first].view(np.int64), first, last, at[first] != at[last]


def _direct(data: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The given suffixes in order of their first `depth` bytes."""
    wide = np.zeros(len(data) + 2 * depth + 16, np.uint8)
    wide[: len(data)] = data
    words = np.zeros(len(data) + depth + 8, np.uint64)
    for k in range(8):
        words |= wide[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    whole = rolling(wide[: len(data) + depth], depth)
    strides = [(w, rolling(wide[: len(words) + w], w)) for w in (64, 16) if w < depth]
    order = small[np.argsort(words[small], kind="stable")]
    first = words[order]
    where = np.arange(len(order))
    new = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    at = np.full(len(order), 8)
    while len(where):
        # Only groups whose members differ somewhere in the first `depth` bytes need more sorting.
        own = order[where]
        size = np.diff(np.append(new, len(own)))
        mixed = _differs(whole[own], new, size)
        keep = np.repeat(mixed & (at[new] < depth), size)
        where, own, at, size = where[keep], own[keep], at[keep], size[mixed & (at[new] < depth)]
        if not len(where):
            break
        new = np.concatenate([[0], np.cumsum(size)[:-1]])
        # A group that agrees on a whole stride moves on by it; the others sort by their next word.
        agreed = np.zeros(len(size), bool)
        for w, h in strides:
            same = ~agreed & ~_differs(h[own + np.minimum(at, depth)], new, size)
            at = at + np.repeat(w * same, size)
            agreed |= same
        group = np.repeat(np.arange(len(size)), size)
        todo = np.flatnonzero(np.repeat(~agreed, size))
        fresh = np.zeros(len(own), bool)
        fresh[new] = True
        if len(todo):
            mine, g = own[todo], group[todo]
            key = words[mine + np.minimum(at[todo], depth)]
            by = np.lexsort((key, g))
            own[todo] = mine = mine[by]
            order[where] = own
            key = key[by]
            fresh[todo[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])
            at[todo] += 8
        new = np.flatnonzero(fresh)
    return order


def _differs(x: np.ndarray, new: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each group, given its first index and size, whether its values differ."""
    return np.logical_or.reduceat(x != np.repeat(x[new], size), new)


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All suffixes ordered by at least their first `depth` bytes, by two-stage sorting."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    change = np.flatnonzero(data[1:] != data[:-1])
    upto = np.searchsorted(change, np.arange(n))
    rises = np.append(data[change] < data[change + 1], False)  # the last suffix is larger than the empty one
    smaller = rises[upto]
    small = _direct(data, np.flatnonzero(smaller), depth)
    ends = np.searchsorted(data[small], np.arange(257)) if len(small) else np.zeros(257, np.int64)
    alike = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, data[1:] != data[:-1]), np.arange(n), 0)) + 1
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    pending[data[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        # The larger suffixes of bucket c follow the order of their successors, which stand in
        # earlier buckets or, for runs of c, in this one one step before.
        level = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        steps = alike[level]
        step = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
        larger_ones = (np.repeat(level, steps) - step)[np.argsort(step, kind="stable")]
        bucket = np.concatenate([larger_ones, small[ends[c] : ends[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        back = bucket[bucket > 0] - 1
        before = data[back]
        larger = before > c
        back, before = back[larger], before[larger]
        by = np.argsort(before, kind="stable")
        back, before = back[by], before[by]
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else []
        for k, piece in zip(first, np.split(back, first[1:]) if len(before) else [], strict=True):
            pending[before[k]].append(piece)
    return np.concatenate(out)


def repeated(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct piece, whether each of its starts (with `length` bytes left) has an equal
    string at another start of any piece."""
    data = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    left = np.repeat(ends, np.diff(np.append(begins, len(data)))) - np.arange(len(data))
    order = suffix_array(data, length)
    order = order[left[order] >= length]  # equal strings stay adjacent: shorter suffixes hold a mark in them
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    for at in [*range(0, length - 7, 8), max(0, length - 8)]:
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    hit = np.zeros(len(data), bool)
    hit[a[alive]] = True
    hit[b[alive]] = True
    return [hit[s : e - length + 1] for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def _spans(hit: np.ndarray, offset: int, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the marked starts."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.append(0, gap + 1)], at[np.append(gap, len(at) - 1)]
    return [(int(a) + offset, int(b) + offset + length) for a, b in zip(first, last, strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Rows by (k1, k2): the id and a hash of the text.  Equal rows share a key and a result."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def _runs(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """k1, k2, anchor, at and a hash of the bytes of every run."""
    names = ["k1", "k2", "anchor", "at", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
            keep: list[list[np.ndarray]] = [[] for _ in names]
            size = 0
            for i, t in enumerate(b.column(2).to_pylist()):
                raw = t.encode()
                anchor, first, last, several = runs(np.frombuffer(raw, np.uint8), length, gram)
                if not len(anchor):
                    continue
                view = memoryview(raw)
                same = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                at = (first << 21) | (several.astype(np.int64) << 20) | (last - first)
                for out, x in zip(keep, (np.full(len(anchor), k1[i]), np.full(len(anchor), k2[i]), anchor, at, same.view(np.int64)), strict=True):
                    out.append(x)
                size += len(anchor)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in keep], names=names)
                    keep, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in keep], names=names)

    return keyed.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, anchor long, at long, same long")


def _repeating(rows: DataFrame, length: int, hot: int, plenty: int) -> DataFrame:
    """anchor, same: how often these bytes occur (n), which copy stands for them (rep), over how many
    tasks the anchor's bytes are dealt (0: none is needed), and, if over several, how many windows
    these bytes have.  Anchors that can't repeat are out."""
    kinds = rows.groupBy("anchor", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("k1", "k2", "at")).alias("rep"), F.max(F.col("at").bitwiseAND(2 * _LONGEST - 1)).alias("size"))
    several = F.col("size") >= _LONGEST
    whole = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all"), F.sum(F.col("size").bitwiseAND(_LONGEST - 1) + length).alias("bytes"))
    salts = F.greatest(F.ceil(F.col("kinds") / hot), F.ceil(F.col("bytes") / plenty))
    needed = (F.col("kinds") > 1) | several & (F.col("n") == 1)
    both = kinds.join(whole, "anchor").where((F.col("all") > 1) | several)
    windows = F.when(needed & (salts > 1), F.col("size").bitwiseAND(_LONGEST - 1) + 1)
    return both.select("anchor", "same", "n", "rep", F.when(needed, salts).otherwise(0).cast("int").alias("salts"), windows.alias("windows"))


def _per_text(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The runs of each text that repeat: place, whether they are covered as a whole, and, if their
    bytes are needed, their anchor and its number of tasks.  A set: copies of a row share it."""
    mine = (F.col("salts") > 0) & ((F.col("n") == 1) | (F.xxhash64("k1", "k2", "at") == F.col("rep")))
    found = rows.join(counts, ["anchor", "same"]).where((F.col("n") > 1) | mine)
    run = F.struct("at", (F.col("n") > 1).alias("whole"), F.when(mine, F.col("salts")).alias("salts"), F.when(mine, F.col("anchor")).alias("anchor"))
    return found.groupBy("k1", "k2").agg(F.collect_set(run).alias("runs"))


def _pieces(both: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs that are sought; from (k1, k2, text, runs, ...)."""
    names = ["anchor", "salt", "salts", "k1", "k2", "first", "whole", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for k1, k2, t, own in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if (k1, k2) == last or not own:
                    continue  # a copy of the row before
                last = k1, k2
                raw = t.encode()
                for r in own:
                    if not r["salts"]:
                        continue
                    first, more = r["at"] >> 21, r["at"] & (_LONGEST - 1)
                    salt = 0 if r["salts"] == 1 else xxhash.xxh3_64_intdigest(f"{k1}:{k2}:{first}") % r["salts"]
                    piece = raw[first : first + more + length]
                    for c, x in zip(cols, (r["anchor"], salt, r["salts"], k1, k2, first, r["whole"], piece), strict=True):
                        c.append(x)
                    size += len(piece)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)))
                    cols, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)))

    return both.mapInArrow(run, "anchor long, salt long, salts long, k1 long, k2 long, first long, whole boolean, piece binary")


#: kind 0: a covered range of a text.  For batches of windows k1 is the batch: kind 1, windows of a
#: bucket; kind 2, numbers of windows that occur twice; kind 3, the places of the batch.  Rows meet by key.
_OUT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
_OUT_SQL = "kind int, key long, k1 long, k2 long, a long, b long, data binary"


def _packed(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)


class _Batch:
    """Windows of a task on their way to the buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.done = buckets, 0
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers, self.places, self.size = bytearray(), array("I"), [], 0

    def add(self, window: bytes, number: int) -> None:
        self.hashes += window
        self.numbers.append(number)

    def flush(self) -> list[tuple]:
        if not len(self.numbers):
            return []
        batch = TaskContext.get().partitionId() << 32 | self.done
        own = np.empty(len(self.numbers), _WINDOW)
        own["hi"], own["lo"] = np.frombuffer(bytes(self.hashes), "<u8").reshape(-1, 2).T
        own["at"] = np.frombuffer(self.numbers, np.uint32)
        bucket = (own["hi"] % np.uint64(self.buckets)).astype(np.int64)
        out = [(1, int(bucket[x[0]]), batch, 0, 0, 0, own[x].tobytes()) for x in _groups(bucket)]
        if self.places:
            out.append((3, batch, batch, 0, 0, 0, np.array(self.places, _PLACE).tobytes()))
        self.done += 1
        self.clear()
        return out


def _groups(x: np.ndarray) -> list[np.ndarray]:
    """Indices of equal values, each group in ascending order."""
    order = np.argsort(x, kind="stable")
    return np.split(order, np.flatnonzero(x[order[1:]] != x[order[:-1]]) + 1) if len(x) else []


def _searched(pieces: DataFrame, length: int, chunk: int, buckets: int) -> DataFrame:
    """Covered ranges; for anchors dealt over tasks, packed windows and the places they are from."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(rows: list[tuple], batch: _Batch) -> Iterator[pa.RecordBatch]:
        # Bytes that stand for several copies are covered already; the others occur once.
        distinct = {r[5]: k for k, r in enumerate(rows)}
        keys = list(distinct)
        hits = dict(zip(keys, repeated(keys, length), strict=True))
        out: list[tuple] = []
        windows: set[bytes] = set()
        last = None
        for anchor, salts, k1, k2, first, piece, whole in rows:
            if anchor != last:
                windows.clear()  # rows are in the order of their anchors
                last = anchor
            hit = hits[piece]
            if not whole:
                out += [(0, k1 ^ k2, k1, k2, first + a, first + b, None) for a, b in _spans(hit, 0, length)]
            if salts > 1:
                if not whole:
                    batch.places.append((k1, k2, first, batch.size))
                for i, covered in enumerate(hit.tolist(), batch.size):
                    w = xxhash.xxh3_128_digest(piece[i - batch.size : i - batch.size + length])
                    if not covered and not whole:
                        batch.add(w, i)
                    elif w not in windows:
                        windows.add(w)
                        batch.add(w, _NONE)
                batch.size += len(hit)
                if batch.size > BATCH:
                    out += batch.flush()
            if len(out) > 20_000:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by anchor and salt; whole groups are gathered up to `chunk` bytes.
        rows: list[tuple] = []
        batch = _Batch(buckets)
        last, size = None, 0
        for b in batches:
            for anchor, salt, salts, k1, k2, first, whole, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (anchor, salt) != last:
                    if size > chunk:
                        yield from solve(rows, batch)
                        rows, size = [], 0
                        trim()
                    last = (anchor, salt)
                rows.append((anchor, salts, k1, k2, first, piece, whole))
                size += len(piece)
        if rows:
            yield from solve(rows, batch)
        if rest := batch.flush():
            yield _packed(rest)
        trim()

    dealt = pieces.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, _OUT_SQL)


def _twice(own: list[tuple[int, bytes]]) -> list[tuple]:
    """Of the windows of one bucket, given with their batches, the numbers of those that occur twice."""
    x = np.concatenate([np.frombuffer(data, _WINDOW) for _, data in own])
    batch = np.repeat(np.array([k for k, _ in own], np.int64), [len(data) // _WINDOW.itemsize for _, data in own])
    order = np.lexsort((x["lo"], x["hi"]))
    s = x[order]
    same = (s["hi"][1:] == s["hi"][:-1]) & (s["lo"][1:] == s["lo"][:-1])
    found = order[np.append(same, False) | np.append(False, same)]
    found = found[x["at"][found] != _NONE]
    return [(2, int(batch[found[g[0]]]), int(batch[found[g[0]]]), 0, 0, 0, x["at"][found[g]].tobytes()) for g in _groups(batch[found])]


def _ranges(numbers: list[bytes], places: bytes, length: int) -> list[tuple]:
    """The windows of a batch with these numbers as covered ranges of their texts."""
    at = np.sort(np.frombuffer(b"".join(numbers), "<u4")).astype(np.int64)
    p = np.frombuffer(places, _PLACE)
    begins = p["at"].astype(np.int64)
    piece = np.searchsorted(begins, at, "right") - 1
    start = at - begins[piece] + p["first"][piece]
    first = np.flatnonzero(np.append(True, (np.diff(at) > 1) | (np.diff(piece) > 0)))
    last = np.append(first[1:], len(at)) - 1
    k1, k2 = p["k1"][piece[first]], p["k2"][piece[first]]
    cols = (k1 ^ k2, k1, k2, start[first], start[last] + length)
    return [(0, *row, None) for row in zip(*(c.tolist() for c in cols), strict=True)]


def _completed(out: DataFrame, length: int) -> DataFrame:
    """Covered ranges, with those that windows of other tasks tell."""
    parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, bytes]] = []
        last = None
        for b in batches:
            windows = np.asarray(b.column(0)) == 1
            if not windows.all():
                yield b.filter(pa.array(~windows))
            for key, batch, data in zip(*(b.filter(pa.array(windows)).column(i).to_pylist() for i in (1, 2, 6)), strict=True):
                if key != last and own:
                    if found := _twice(own):
                        yield _packed(found)
                    own = []
                last = key
                own.append((batch, data))
        if own and (found := _twice(own)):
            yield _packed(found)
        trim()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The numbers of a batch come before its places.
        numbers: list[bytes] = []
        for b in batches:
            ranges = np.asarray(b.column(0)) == 0
            if ranges.any():
                yield b.filter(pa.array(ranges))
            for kind, data in zip(*(b.filter(pa.array(~ranges)).column(i).to_pylist() for i in (0, 6)), strict=True):
                if kind == 2:
                    numbers.append(data)
                elif numbers:
                    yield _packed(_ranges(numbers, data, length))
                    numbers = []

    for step in (count, place):
        out = out.repartition(parts, "key").sortWithinPartitions("key", "kind").mapInArrow(step, _OUT_SQL)
    return out


def covered(keyed: DataFrame, *more: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, plenty: int = PLENTY, chunk: int = CHUNK) -> DataFrame:
    """`more` columns, text, and what is covered: its runs and the ranges that were found."""
    spark = keyed.sparkSession
    path = fresh_path(spark, "runs")
    _runs(keyed, length, gram).write.parquet(path)
    rows = spark.read.parquet(path)
    path = fresh_path(spark, "repeating")
    _repeating(rows, length, hot, plenty).write.parquet(path)
    counts = spark.read.parquet(path)
    # `more` is carried along, unused, so that both readers of the texts share one exchange.
    both = keyed.join(_per_text(rows, counts), ["k1", "k2"], "left").select("k1", "k2", "text", "runs", *more)
    # Only the windows of anchors dealt over several tasks are counted over all of them.
    windows = counts.agg(F.sum("windows")).first()[0] or 0
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * -(-windows // BUCKET)
    out = _searched(_pieces(both, length), length, chunk, buckets)
    if windows:
        out = _completed(out, length)
    spans = out.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return both.join(spans, ["k1", "k2"], "left").select(*more, "text", "runs", "spans")


def _gone(own: list[dict] | None, spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered ranges of one text."""
    whole = [(r["at"] >> 21, (r["at"] >> 21) + (r["at"] & (_LONGEST - 1)) + length) for r in own or [] if r["whole"]]
    return merged(whole + [(s["a"], s["b"]) for s in spans or []])


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def digest(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    both = covered(_keyed(docs), "k1", length=length, **options)
    null = -(2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, own, spans in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                gone = _gone(own, spans, length)
                out.append((None if doc_id == null else doc_id, len(raw), sum(e - s for s, e in gone), len(gone), hashlib.sha256(_cut(raw, gone)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*out, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)})

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """All columns; covered bytes leave the text, and halves of characters at the cuts with them.

    A null text stays null; n_chars, where there is such a column, follows the text.
    """
    cols = docs.columns
    row = F.struct(F.col("text").isNull().alias("_null"), *[F.col(f"`{c}`") for c in cols if c != "text"])
    both = covered(_keyed(docs.select(row.alias("_row"), "doc_id", "text"), "_row"), "_row", length=length, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for text, own, spans in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                gone = _gone(own, spans, length)
                new.append(_cut(text.encode(), gone).decode("utf-8", "ignore") if gone else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string())], names=["_row", "_text"])

    done = both.mapInArrow(run, f"_row {both.schema['_row'].dataType.simpleString()}, _text string")
    text = F.when(~F.col("_row._null"), F.col("_text"))
    return done.select(*[(text if c == "text" else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
