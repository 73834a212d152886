"""Rankings kept up to date by Structured Streaming.

A file or message stream of points updates, in each micro-batch, the last value of each series in
its buckets; the batch's buckets are ranked again and written as a new version of their lists.
Readers take the latest version of each list (`topn.newest`), so a batch that runs twice changes
nothing.  Points of buckets that ended before the watermark are late and dropped, and the state of
such buckets goes.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog, Kind, Ranking, Resource
from ..operators import dedup, topn
from ..sources.storage import _names, _remove


def state_columns(r: Resource, tags: list[str]) -> list[str]:
    return ["bucket", "group_key", *dict.fromkeys([*tags, *r.entity])]


class RankingStream:
    """One ranking's streaming query, its state table and its lists, under a root folder.

    The state is the points' last values, a table partitioned by bucket: a batch reads the buckets
    that it touches.  The watermark is the latest time seen in earlier batches less lru x interval;
    it never moves back, and it bounds the buckets that are kept.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, group: str, name: str, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.ranking: Ranking = catalog.rankings[group, name]
        self.r = catalog.get(Kind.MEASURE, self.ranking.source_group, self.ranking.source)
        self.keys = state_columns(self.r, topn.group_tags(self.ranking, self.r))

    def start(self, points: DataFrame, **trigger: object) -> StreamingQuery:
        """points: a streaming DataFrame with the measure's columns; ts must be a TIMESTAMP."""
        prepared = topn.prepared(points, self.ranking, self.r)
        return prepared.writeStream.foreachBatch(self._update).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"processingTime": "24 seconds"})).start()

    def _length(self) -> timedelta:
        return topn._length(self.ranking.interval)

    def watermark(self, number: int) -> datetime | None:
        """As batches before this one left it."""
        seen = [t for n, t in self._seen().items() if n < number]
        return max(seen) - self.ranking.lru * self._length() if seen else None

    def _seen(self) -> dict[int, datetime]:
        """The latest time of each batch: one row a batch, the last few."""
        if not _names(self.spark, f"{self.root}/seen"):
            return {}
        return {r["batch"]: r["ts"] for r in self.spark.read.parquet(f"{self.root}/seen").collect() if r["ts"] is not None}

    def _update(self, batch: DataFrame, number: int) -> None:
        """Adds the batch's values to the state, ranks the buckets that it touched, and drops what is
        past the watermark.  A batch that runs again overwrites its own folders."""
        state, lists = f"{self.root}/state", f"{self.root}/lists"
        mark = self.watermark(number)
        late = F.lit(False) if mark is None else F.col("bucket") + F.expr(f"INTERVAL {self.ranking.interval}") <= F.lit(mark)
        day = F.unix_timestamp("bucket").alias("_b")
        last = dedup.best(batch.where(~late), self.keys, [F.col("ts"), F.col("version")]).select("*", day)
        mine = f"{state}/batch={number}"
        last.write.mode("overwrite").partitionBy("_b").parquet(mine)
        batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(f"{self.root}/seen/batch={number}")
        touched = sorted(int(n[3:]) for n in _names(self.spark, mine) if n.startswith("_b="))
        if not touched:
            return
        new = self.spark.read.schema(last.schema).parquet(mine)
        # Bounds of the buckets prune folders; the join then takes the touched ones alone.
        whole = self.spark.read.schema(last.schema).option("basePath", state).parquet(state).where(F.col("_b").between(touched[0], touched[-1]))
        points = whole.join(new.select("_b").distinct(), "_b", "left_semi").drop("_b", "batch")
        ranked = topn.ranked(points, self.ranking, self.r.entity).drop("version").withColumn("version", F.lit(number).cast("long"))
        ranked.write.mode("overwrite").parquet(f"{lists}/batch={number}")
        self._expire(number)

    def _expire(self, number: int) -> None:
        """Drops the state of buckets that no later point can touch, and the times seen that no batch needs."""
        mark = self.watermark(number + 1)
        if mark is None:
            return
        ended = (mark - self._length()).timestamp()
        for name in _names(self.spark, f"{self.root}/state"):
            for b in _names(self.spark, f"{self.root}/state/{name}"):
                if b.startswith("_b=") and int(b[3:]) <= ended:
                    _remove(self.spark, f"{self.root}/state/{name}/{b}")
        # This batch may run again: the latest time before it stays.
        before = {n: t for n, t in self._seen().items() if n < number}
        best = max(before, key=before.get, default=None)
        for n in before:
            if n != best:
                _remove(self.spark, f"{self.root}/seen/batch={n}")

    def lists(self) -> DataFrame:
        """The current lists."""
        path = f"{self.root}/lists"
        rows = self.spark.read.option("basePath", path).parquet(path).drop("batch")
        return topn.newest(rows, [k for k in self.keys if k not in ("bucket", "group_key")])


def windowed(points: DataFrame, ts: str, interval: str, keys: list[str], value: str, delay: str, slide: str | None = None) -> DataFrame:
    """Tumbling (or, with a slide, sliding) event-time windows with a watermark: sum and count by key,
    as a streaming frame.  Spark drops points of windows that ended before the watermark."""
    w = F.window(ts, interval, slide) if slide else F.window(ts, interval)
    return points.withWatermark(ts, delay).groupBy(w.alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(F.col("w.start").alias("bucket"), *keys, "total", "n")


def sessions(points: DataFrame, ts: str, gap: str, keys: list[str], value: str, delay: str) -> DataFrame:
    """Session windows: a key's points with less than the gap between neighbours; sum, count, start, end."""
    got = points.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "total", "n")
