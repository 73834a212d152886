"""Near-duplicates: ProbMinHash signatures of weighted shingles, banding, verification, classes.

Each shingle of five words, weighted by how often it occurs, is a Poisson process of arrivals whose
rate is its weight; each arrival falls on a random register, which keeps the shingle that arrives
first.  A shingle stops as soon as its next arrival is later than all registers.  Registers agree
with the probability Jaccard similarity.  BANDS bands of ROWS registers give candidates; each
candidate is verified on the exact weighted shingles.  A text that repeats shingles is banded once
more as a set, each shingle with weight 1.

A bucket's members first meet its two leaders only, so a bucket of n texts gives 2n candidates.
Then all texts of buckets that still hold more than one class meet again by the rarest of their
shingles (a prefix filter), which misses no pair at the threshold: a text meets the classes, not the
texts, that it can't be told apart from, and is then compared with all their members, in blocks of
bounded size.  Equal texts are joined first by their hash and go through all this once.

Two texts are linked if their probability Jaccard similarity, or the Jaccard similarity of their
sets of shingles, is at least THRESHOLD.  A class is a connected component; its id is its least
doc_id.  Shingles are compared by 32-bit hashes in the verification: a false agreement adds one
shared shingle, with a chance of the product of both texts' shingles over 2^32.

Defined results: a null text counts as empty; texts of fewer than five words are one shingle of all
their words; empty texts are one class; repeated rows share a class; rows that share an id but not
their text are classed by their texts (where two classes have the same least id, that id stands for
both, and `distinct` keeps a row of each); a null id is treated as the least number and comes back as
null; an empty table gives an empty result; extra columns are ignored (kept by `distinct`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, table
from .fingerprint import mix, shingles

BANDS, ROWS, THRESHOLD = 24, 6, 0.8
#: Shingles worked on at once.
GROUP = 200_000
NULL_ID = -(2**63)
#: Pairs of one leader, rows of one text, and texts or bytes of one class that meet in one piece.
MOST, SPLIT, BLOCK, BLOCK_BYTES = 2000, 64, 64, 1 << 17
_STEP, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts."""
    return np.unique(shingles(text.split()), return_counts=True)


def signatures(items: list[tuple[np.ndarray, np.ndarray]], registers: int = BANDS * ROWS) -> np.ndarray:
    """One row of registers for each item, all items at once; each round draws an arrival for every
    shingle that may still be first somewhere."""
    size = [len(h) for h, _ in items]
    doc = np.repeat(np.arange(len(items)), size)
    elem = np.concatenate([h for h, _ in items])
    rate = np.concatenate([w for _, w in items]).astype(float)
    when = np.zeros(len(elem))
    first = np.full(len(items) * registers, np.inf)
    who = np.zeros(len(items) * registers, np.uint64)
    turn = 0
    while len(elem):
        turn += 1
        draw = mix(elem + np.uint64(int(_STEP) * turn % (1 << 64)))
        when = when - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / rate
        cell = doc * registers + (mix(draw ^ _TURN) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, cell, when)
        won = when == first[cell]
        who[cell[won]] = elem[won]
        live = np.unique(doc)
        last = np.full(len(items), -np.inf)
        last[live] = first.reshape(-1, registers)[live].max(axis=1)
        stay = when < last[doc]
        doc, elem, rate, when = doc[stay], elem[stay], rate[stay], when[stay]
    return who.reshape(-1, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.shape[1] // bands
    out = np.zeros((len(signature), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix(out * _STEP + signature[:, r::rows][:, :bands])
    return out.view(np.int64)


def all_keys(texts: list[str]) -> list[np.ndarray]:
    """Distinct band keys of many texts, in groups of bounded size.

    Texts that repeat a shingle have the keys of their set of shingles too, as if each occurred once.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    group, at, held = [], [], 0

    def flush() -> None:
        for k, keys in zip(at, band_keys(signatures(group)), strict=True):
            out[k] = np.union1d(out[k], keys)

    for k, t in enumerate(texts):
        h, w = weighted(t)
        for weights in [w] if (w == 1).all() else [w, np.ones_like(w)]:
            group.append((h, weights))
            at.append(k)
            held += len(h)
        if held > GROUP:
            flush()
            group, at, held = [], [], 0
    if group:
        flush()
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Probability Jaccard of the weights, and Jaccard of the sets."""
    (ha, wa), (hb, wb) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0, 0.0
    x, y = wa[ia] / wa.sum(), wb[ib] / wb.sum()
    rest_y = 1.0 - y.sum()
    plain = len(ia) / (len(ha) + len(hb) - len(ia))
    # For shingle i: sum over j of max(x_j / x_i, y_j / y_i), by the order of the ratios y / x;
    # shingles of b alone have an infinite ratio, those of a alone ratio 0.
    by = np.argsort(y / x, kind="stable")
    x, y = x[by], y[by]
    low = (1.0 - x.sum()) + np.cumsum(x)
    high = rest_y + (y.sum() - np.cumsum(y))
    return float((1.0 / (low / x + high / y)).sum()), plain


def _packed(item: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Sorted 32-bit shingle hashes, then counts if some shingle occurs more than once."""
    h, at = np.unique((item[0] >> np.uint64(32)).astype(np.uint32), return_inverse=True)
    w = np.bincount(at, weights=item[1]).astype(np.uint32)
    return b"\0" + h.astype("<u4").tobytes() if (w == 1).all() else b"\1" + h.astype("<u4").tobytes() + w.astype("<u4").tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(data, "<u4", offset=1)
    return (v, np.ones(len(v))) if not data[0] else (v[: len(v) // 2], v[len(v) // 2 :].astype(float))


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """id, the text and two hashes of it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), *more)


def _texts(keyed: DataFrame) -> DataFrame:
    """(t1, t2, salt, rep, node) of each distinct text: its least id, and a number of its own.

    The node is that id; of several texts with one least id, all but one have a hash instead.  The
    copies of a text are dealt over SPLIT salts: a row for each of those in use.
    """
    parts = keyed.select("id", "t1", "t2", _salt()).groupBy("t1", "t2", "salt").agg(F.min("id").alias("least"))
    whole = parts.groupBy("t1", "t2").agg(F.min("least").alias("rep"))
    first = whole.groupBy("rep").agg(F.min("t1").alias("f"))
    node = F.when(F.col("t1") == F.col("f"), F.col("rep")).otherwise(F.xxhash64("rep", "t1", "t2"))
    return parts.drop("least").join(whole.join(first, "rep").select("t1", "t2", "rep", node.alias("node")), ["t1", "t2"])


def _salt():
    return F.pmod(F.xxhash64("id"), F.lit(SPLIT)).cast("int").alias("salt")


def _of_nodes(rows: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """(node, column), once for each node: from the rows that have its least id and its text."""
    key = ["id", "t1", "t2"]
    both = rows.join(nodes.select(F.col("rep").alias("id"), "t1", "t2", "node"), key)
    return both.groupBy(*key).agg(F.first("node").alias("node"), F.first(column).alias(column)).select("node", column)


def _banded(keyed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = all_keys(b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(keys, pa.list_(pa.int64()))], names=["id", "t1", "t2", "keys"])

    return keyed.select("id", "t1", "t2", "text").mapInArrow(run, "id long, t1 long, t2 long, keys array<long>")


def _contents(texts: DataFrame) -> DataFrame:
    """Shingles of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(weighted(t)) for t in b.column(1).to_pylist()], pa.binary())], names=["id", "sh"])

    return texts.mapInArrow(run, "id long, sh binary")


def _stars(members: DataFrame) -> DataFrame:
    """(key, id) -> distinct pairs (a, l): each bucket's members with its two leaders."""
    led = members.groupBy("key").agg(F.min("id").alias("l1"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("l2"), F.max("id").alias("top")).where("l1 < top")
    both = members.join(led.select("key", "l1", F.col("l2.id").alias("l2")), "key")
    pair = F.explode(F.array(F.col("l1"), F.col("l2"))).alias("l")
    return both.select(F.col("id").alias("a"), pair).where("a <> l").distinct()


def _verified(pairs: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, l) that are links, as (a, b).  A member is in few pairs; a leader's pairs are
    dealt over as many tasks as they need."""
    many = pairs.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("salts")).where("salts > 1")
    dealt = pairs.join(many, "l", "left").select("a", "l", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), F.col("salts"))).cast("int").alias("salt"))
    one = contents.select(F.col("id").alias("a"), F.col("sh").alias("sa"))
    two = contents.join(many, contents["id"] == many["l"], "left").select("id", "sh", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    two = two.select(F.col("id").alias("l"), F.col("sh").alias("sl"), "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [max(similarity(_unpacked(x), _unpacked(y))) >= threshold - 1e-12 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return dealt.join(one, "a").join(two, ["l", "salt"]).select("a", "l", "sa", "sl").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Least id of each linked id's component: (id, label).  Alternating large and small stars, cut
    after each pair of steps, until the set of links no longer changes."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        # Large star: every neighbour that is larger than u links to the least of u and its neighbours.
        ways = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of u, and u, link to the least of them.
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut(e)
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == now:
            break
        mark = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("label"))


def _unlinked(bands: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label) of all texts in buckets that hold more than one class."""
    known = bands.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.explode("keys").alias("key"))
    mixed = known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return known.join(mixed, "key", "left_semi").select("id", "label").distinct()


def _prefixes(items: DataFrame, threshold: float) -> DataFrame:
    """(id, h, w, u) of `items` (id, sh): the prefix's shingles and the odds of what is before them.

    The shingles that a linked pair shares have at least the threshold's share of the weights, or of
    the number, in both texts.  So the first of them in any fixed order lies in both prefixes, of
    what has at most the rest before it; in the order from rare to common, passages that many texts
    share are in few prefixes.  With shares f and g of two texts before their first common shingle,
    both similarities are at most 1 / (1 + f / (1 - f) + g / (1 - g)).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_unpacked(x) for x in b.column(1).to_pylist()]
            if got:
                size = [len(h) for h, _ in got]
                row = np.repeat(np.arange(len(got)), size)
                h = np.concatenate([h for h, _ in got]).astype(np.int64)
                w = np.concatenate([w / w.sum() for _, w in got])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h), pa.array(w), pa.array(np.repeat([1 / n for n in size], size))], names=["id", "h", "w", "u"])

    each = items.select("id", "sh").mapInArrow(run, "id long, h long, w double, u double")
    # Shingles of one text make no pair; they are the start of its prefix, before all others.
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    text = Window.partitionBy("id")
    order = text.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = [(1 - F.sum(c).over(text) + F.sum(c).over(order) - F.col(c)).alias(c) for c in ("w", "u")]
    odds = [(F.col(c) / (1 - F.col(c))).alias(c) for c in ("w", "u")]
    first = each.join(often, "h").select("id", "h", "n", *ahead).where(F.least("w", "u") <= 1 - threshold + 1e-6)
    first = cut(first.where("w < 1 AND u < 1").select("id", "h", "n", *odds))
    # Of shingles that lie in the prefixes of just the same texts, the first is enough.
    who = first.groupBy("h", "n").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id")).alias("i1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("i2")).where("k > 1")
    one = who.groupBy("k", "i1", "i2").agg(F.min(F.struct("n", "h"))["h"].alias("h")).select("h")
    return cut(first.drop("n").join(one, "h", "left_semi"))


def _between(first: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(x, label): texts and the other classes that they can have links to.  None is left out."""
    named = first.join(labels, "id")
    able = F.least(F.col("wx") + F.col("wy"), F.col("ux") + F.col("uy")) <= 1 / threshold - 1 + 1e-5
    # A class counts with its members' least odds.  Of two classes at least one is not the
    # shingle's largest, so a large class never meets itself.
    kinds = named.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("wy"), F.min("u").alias("uy"))
    top = kinds.groupBy("h").agg(F.max(F.struct("n", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h", "top")
    x = named.join(top, "h").where("label <> top").select("h", "top", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("w").alias("wx"), F.col("u").alias("ux"))
    y = kinds.select("h", "label", "wy", "uy")
    return x.join(y, "h").where("lx <> label AND (label = top OR lx < label)").where(able).select("x", "label").distinct()


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(label, id, sh) -> (label, name): arrays of about BLOCK texts or BLOCK_BYTES bytes."""
    size = rows.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.length("sh")) / BLOCK_BYTES)).alias("blocks"))
    dealt = rows.join(size, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return dealt.groupBy("label", "block").agg(F.collect_list(F.struct("id", "sh")).alias(name)).drop("block")


def _links_of(xs: list[dict], ys: list[dict], threshold: float) -> list[tuple[int, int]]:
    """Links of two blocks of texts; of those between one text and a block, one is enough."""
    other = [_unpacked(y["sh"]) for y in ys]
    size = np.array([len(h) for h, _ in other])
    owner = np.repeat(np.arange(len(other)), size)
    h, share = np.concatenate([h for h, _ in other]), np.concatenate([w / w.sum() for _, w in other])
    by = np.argsort(h, kind="stable")
    h, share, owner = h[by], share[by], owner[by]
    out = []
    for x in xs:
        a, w = _unpacked(x["sh"])
        at = np.minimum(np.searchsorted(a, h), len(a) - 1)
        hit = np.flatnonzero(a[at] == h)
        both = np.bincount(owner[hit], minlength=len(other))
        plain = both / (len(a) + size - both)
        # The probability Jaccard similarity is at most the sum of the lesser shares.
        lesser = np.bincount(owner[hit], weights=np.minimum(share[hit], (w / w.sum())[at[hit]]), minlength=len(other))
        for k in np.flatnonzero((plain >= threshold - 1e-12) | (lesser >= threshold - 1e-9)):
            if plain[k] >= threshold - 1e-12 or similarity((a, w), other[k])[0] >= threshold - 1e-12:
                out.append((x["id"], ys[k]["id"]))
                break
    return out


def _met(found: DataFrame, labels: DataFrame, contents: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the texts x and the classes of `found`."""
    ours = found.join(contents.withColumnRenamed("id", "x"), "x").select("label", F.col("x").alias("id"), "sh")
    theirs = labels.join(found.select("label").distinct(), "label", "left_semi").join(contents, "id").select("label", "id", "sh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                got = _links_of(b.column(0)[i].as_py(), b.column(1)[i].as_py(), threshold)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["a", "b"])

    return _blocks(ours, "xs").join(_blocks(theirs, "ys"), "label").select("xs", "ys").mapInArrow(run, "a long, b long")


def _classed(keyed: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (see `_texts`), and (node, label) of those that have links."""
    spark = keyed.sparkSession
    path = fresh_path(spark, "texts")
    _texts(keyed).write.parquet(path)
    texts = spark.read.parquet(path)
    # A node's own row is that of its least id's salt: one row for each distinct text.
    nodes = texts.where(F.col("salt") == F.pmod(F.xxhash64("rep"), F.lit(SPLIT))).select("t1", "t2", "rep", "node")
    path = fresh_path(spark, "bands")
    _of_nodes(_banded(keyed), nodes, "keys").select(F.col("node").alias("id"), "keys").write.parquet(path)
    bands = spark.read.parquet(path)
    pairs = cut(_stars(bands.select("id", F.explode("keys").alias("key"))))
    # The contents of all texts that share a bucket, read by both rounds of verification.
    ids = pairs.select(F.explode(F.array("a", "l")).alias("node")).distinct()
    path = fresh_path(spark, "contents")
    _contents(_of_nodes(keyed, nodes.join(ids, "node", "left_semi"), "text")).write.parquet(path)
    contents = spark.read.parquet(path)
    links = cut(_verified(pairs, contents, threshold))
    labels = components(links)
    rest = cut(_unlinked(bands, labels))
    more = _between(_prefixes(contents.join(rest.select("id"), "id", "left_semi"), threshold), rest, threshold)
    more = cut(_met(cut(more), rest, contents, threshold))
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    return texts, labels.withColumnRenamed("id", "node")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row."""
    keyed = _keyed(docs)
    texts, labels = _classed(keyed, threshold)
    named = texts.join(labels, "node", "left").select("t1", "t2", "salt", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("class"))
    named = named.join(least, "label").select("t1", "t2", "salt", "class")
    out = keyed.select("id", "t1", "t2", _salt()).join(named, ["t1", "t2", "salt"])
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("id").alias("doc_id"), null("class").alias("class_id"))


def distinct(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of one document of each class: that with the least id; of repeated rows, one."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = _keyed(docs.select("doc_id", "text", row.alias("_row")), "_row")
    texts, labels = _classed(keyed, threshold)
    named = texts.join(labels, "node", "left").select("t1", "t2", "rep", F.coalesce("label", "node").alias("label"))
    # Of several texts with the class's least id, the one with the least hash.
    kept = named.groupBy("label").agg(F.min(F.struct("rep", "t1", "t2")).alias("k")).select("k.*").withColumnRenamed("rep", "id")
    rows = keyed.join(kept, ["id", "t1", "t2"], "left_semi").dropDuplicates(["id", "t1", "t2"])
    return rows.select("_row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
