"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Templates are files beside this module: header sentences, and whole licences.  A whole text is
compared with the whole licences; runs of header words in it, and the parts of such runs that a
header could fill, are compared with the headers.  Document frequencies of the templates' terms come
from all documents; terms outside the templates count as the rarest.  A file like a whole licence,
or mostly of header lines, or with a licence and a licence's file name, is a licence file: files
without a licence of their own inherit from the licence file in the nearest ancestor directory, found
by joins on directory paths.

Defined results: null and empty texts have no licence of their own; ties of similarity go to the
greater name; several licence files in a directory: the most similar counts, then the last path;
repeated rows give repeated results; a null path has no directory; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, fresh_path, map_rows, table, texts

THRESHOLD = 0.72
#: Similarity to a whole licence from which a file is one, and words that such a file has at least.
WHOLE, WORDS = 0.85, 30
#: A word with at least this share of some header may open or close a run.
HEAVY = 0.03
#: Words whose share is kept by a worker; emptied when full.
KEPT = 150_000
#: Share of a text's words in licence lines from which it is a licence file.
MOSTLY = 0.6
_FILES = Path(__file__).parent / "licences"
#: Names (SPDX) with their header sentences, and with the whole licence.
TEMPLATES: dict[str, list[str]] = json.loads((_FILES / "headers.json").read_text())
BODIES: dict[str, str] = {f.stem: f.read_text() for f in sorted(_FILES.glob("*.txt"))}
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_NAME = r"(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[._-].*)?$"


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


VOCABULARY = frozenset(t for v in TEMPLATES.values() for x in v for t in terms(x))
#: Terms whose document frequencies count.
COUNTED = VOCABULARY.union(*(terms(x) for x in BODIES.values()))
#: Words of the longest header.
LONGEST = max(len(x.split()) for v in TEMPLATES.values() for x in v)


class Scorer:
    """Cosines to all templates; `df` are document frequencies among n documents."""

    def __init__(self, df: dict[str, int], n: int):
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in COUNTED}
        self.rare = math.log(1 + n) + 1
        self.rows = [self._row(name, x) for name, variants in TEMPLATES.items() for x in variants]
        self.bodies = [self._row(name, x) for name, x in BODIES.items()]
        self.shares: dict[str, tuple[float, float]] = {}

    def _row(self, name: str, text: str) -> tuple[str, dict[str, float], float]:
        v = {t: c * self.idf[t] for t, c in Counter(terms(text)).items()}
        return name, v, math.sqrt(sum(w * w for w in v.values()))

    def line(self, words: list[str]) -> tuple[float, str]:
        """The best header's cosine and name."""
        known = VOCABULARY.intersection(words)
        if not known:
            return 0.0, ""
        count = Counter(words)
        own = {t: count[t] * self.idf[t] for t in known}
        inside = sum(w * w for w in own.values())
        norm = inside + sum((c * self.idf.get(t, self.rare)) ** 2 for t, c in count.items() if t not in known)
        if inside < THRESHOLD**2 * norm:
            return 0.0, ""  # the cosine is at most sqrt(inside / norm)
        norm = math.sqrt(norm)
        # One or two shared words are no licence, however rare: short templates must match in full.
        fit = (x for x in self.rows if len(known & x[1].keys()) >= min(3, len(x[1])))
        return max(((sum(w * v[t] for t, w in own.items() if t in v) / norm / size, name) for name, v, size in fit), default=(0.0, ""))

    def whole(self, words: list[str]) -> tuple[float, str]:
        """The best whole licence's cosine and name."""
        own = {t: c * self.idf.get(t, self.rare) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
        return max((sum(w * v[t] for t, w in own.items() if t in v) / norm / size, name) for name, v, size in self.bodies)

    def share(self, word: str) -> tuple[float, float]:
        """At most how much of a header's squared norm the word's terms can match; and the word's
        weight, negative if a term of it is in no template."""
        own = terms(word)
        head = sum(max((v[t] ** 2 / size**2 for _, v, size in self.rows if t in v), default=0.0) for t in VOCABULARY.intersection(own))
        weight = sum(self.idf.get(t, self.rare) ** 2 for t in own)
        return head, weight if all(t in COUNTED for t in own) else -weight

    def text(self, text: str) -> tuple[float, str, bool]:
        """Similarity and name of the best licence, and whether the text is a licence file.

        Only runs of header words are compared with headers, cut at empty lines and at two other words
        in a row.  A cosine is at most the square root of the run's share of the header's squared
        norm, so runs whose words can't reach the threshold are passed over; that loses nothing.
        """
        lines = [line.split() for line in text.lower().split("\n")]
        words = [w for line in lines for w in line]
        claim(self.shares)
        if len(self.shares) > KEPT:
            self.shares.clear()
        for w in set(words):
            if w not in self.shares:
                self.shares[w] = self.share(w)
        both = np.fromiter((x for w in words for x in self.shares[w]), float, 2 * len(words)).reshape(-1, 2)
        share, weight = both[:, 0], both[:, 1]
        if len(words) >= WORDS and weight[weight > 0].sum() >= 0.6 * np.abs(weight).sum():
            # Few words are foreign to all templates: the file may be a licence as a whole.
            best, name = self.whole(terms(" ".join(words)))
            if best >= WHOLE:
                return best, name, True
        at = np.flatnonzero(share)
        if not len(at):
            return 0.0, "", False
        line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])[at]
        new = np.flatnonzero(np.append(True, (np.diff(at) > 2) | (np.diff(line) > 1)))
        best, name, covered = 0.0, "", 0
        ends = np.append(new[1:], len(at))
        for k in np.flatnonzero(np.add.reduceat(share[at], new) >= THRESHOLD**2):
            own = at[new[k] : ends[k]]
            # Common words at either end belong to the sentence around it.
            heavy = own[share[own] >= HEAVY].tolist()
            if not heavy:
                continue
            top, taken = self.line(terms(" ".join(words[heavy[0] : heavy[-1] + 1]))), len(words[heavy[0] : heavy[-1] + 1])
            # Parts from one heavy word to another, no longer than headers are: one sentence of several.
            for i, a in enumerate(heavy):
                for b in heavy[i:]:
                    if b - a >= LONGEST:
                        break
                    if share[a : b + 1].sum() >= THRESHOLD**2 and (b > a):
                        one = self.line(terms(" ".join(words[a : b + 1])))
                        if one > top:
                            top, taken = one, b - a + 1
            if top[0] >= THRESHOLD:
                covered += taken
                best, name = max((best, name), top)
        return best, name, covered >= MOSTLY * len(words)


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """Document frequencies of the template terms, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter[str] = Counter()
        kept: dict[str, frozenset[str]] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                found: set[str] = set()
                for w in set(t.lower().split()):
                    known = kept.get(w)
                    if known is None:
                        if len(kept) > KEPT:
                            kept.clear()
                        known = kept[w] = COUNTED.intersection(terms(w))
                    if known:
                        found |= known
                got.update(found)
            got[""] += b.num_rows
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(got), pa.string()), "n": pa.array(list(got.values()), pa.int64())})

    rows = texts(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in rows}
    return df, df.pop("", 0)


@functools.lru_cache(maxsize=2)
def _scorer(df: tuple[tuple[str, int], ...], n: int) -> Scorer:
    return Scorer(dict(df), n)


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id") -> DataFrame:
    """id, path, own_license, similarity, is_license_file, license, inherited_from."""
    df, n = frequencies(docs)
    keyed = docs.select(F.col(id_col).alias("id"), path.alias("path"), "text")

    def run(b: dict[str, list]) -> dict[str, list]:
        s = _scorer(tuple(sorted(df.items())), n)
        got = [s.text(t) for t in b["text"]]
        return {"id": b["id"], "path": b["path"], "own": [g[1] or None for g in got], "similarity": [round(g[0], 6) for g in got], "mostly": [g[2] for g in got]}

    own = map_rows(texts(keyed, "id", "path"), run, "id long, path string, own string, similarity double, mostly boolean")
    own = own.withColumn("dir", F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", "")))
    own = own.withColumn("file", F.col("own").isNotNull() & (F.col("mostly") | F.regexp_extract("path", "[^/]*$", 0).rlike(_NAME)))
    # Scored once: the table, without texts, serves the files and their directories.
    own.write.parquet(out := fresh_path(docs.sparkSession, "licenses"))
    own = docs.sparkSession.read.parquet(out)
    given = own.where("file").groupBy("dir").agg(F.max_by("own", F.struct(F.col("similarity"), F.col("path"))).alias("given"))
    # Ancestors of each directory, itself first; the deepest that has a licence file counts.
    dirs = own.where("dir is not null").select("dir").distinct()
    up = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))
    up = dirs.select("dir", F.posexplode(up).alias("depth", "above"))
    near = up.join(given.select(F.col("dir").alias("above"), "given"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    out = own.join(near, "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", F.col("own").alias("own_license"), "similarity", F.col("file").alias("is_license_file"), F.coalesce("own", "near.given").alias("license"), F.when(F.col("own").isNull(), F.col("near.above")).alias("inherited_from"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: source and language stand for their directories."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))
