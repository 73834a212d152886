"""Tables as Parquet by day: writes, compaction, retention, stages, copies, dumps.

A table is root/<stage>/<kind>/<group>/<name>/date=...; a day is the unit of pruning, compaction
and expiry.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Kind, Resource
from ..errors import RequestError
from ..operators import dedup
from ..operators.sampling import sampled

HOT = "hot"


@dataclass(frozen=True)
class Store:
    """A root folder on any file system that Spark reaches."""

    root: str

    def path(self, r: Resource, stage: str = HOT) -> str:
        return f"{self.root.rstrip('/')}/{stage}/{r.kind.value.lower()}/{r.group}/{r.name}"

    def append(self, df: DataFrame, r: Resource, stage: str = HOT, bloom: tuple[str, ...] = ()) -> None:
        """Writes rows by day, each day's rows ordered by series, with bloom filters on some tags.

        Rows are dealt by day and series hash, so that one busy day is written by many tasks.
        """
        df = self._dealt(df.withColumn("date", F.to_date(F.col(f"`{r.timestamp}`"))), r)
        w = df.write.mode("append").partitionBy("date")
        for c in bloom:
            w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
        w.parquet(self.path(r, stage))

    def _dealt(self, df: DataFrame, r: Resource) -> DataFrame:
        keys = [F.col(f"`{e}`") for e in (r.sharding_key or r.entity)]
        if not keys:
            return df
        return df.repartition("date", F.pmod(F.xxhash64(*keys), F.lit(32))).sortWithinPartitions("date", *keys, F.col(f"`{r.timestamp}`"))

    def read(self, spark: SparkSession, r: Resource, stage: str = HOT) -> DataFrame:
        return spark.read.parquet(self.path(r, stage))

    def loader(self, r: Resource, stage: str = HOT):
        return lambda spark: self.read(spark, r, stage)

    def days(self, spark: SparkSession, r: Resource, stage: str = HOT) -> list[date]:
        """The days that have a folder."""
        names = _names(spark, self.path(r, stage))
        return sorted(date.fromisoformat(n[5:]) for n in names if n.startswith("date="))

    def compact(self, spark: SparkSession, r: Resource, days: Sequence[date], stage: str = HOT, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """One version of each point (or copy of each element or span) of the days, in fewer files,
        all days in one job.  `keep` may drop rows, as trace sampling does.

        The new files are complete before an old day goes: a failure leaves one of the two.
        """
        if not days:
            return
        path = self.path(r, stage)
        df = self.read(spark, r, stage).where(F.col("date").isin(list(days)))
        if r.kind is Kind.MEASURE:
            df = dedup.versions(df, [*r.entity, "date"], r.timestamp)
        else:
            df = dedup.first(df, ["date", r.trace_id, r.span_id] if r.kind is Kind.TRACE else ["date", r.element_id], [r.timestamp])
        df = df if keep is None else keep(df)
        new = f"{path}/_compact"
        _remove(spark, new)
        self._dealt(df, r).write.partitionBy("date").parquet(new)
        made = _names(spark, new)
        for day in days:
            # The old day stays under a hidden name until the new one is in its place.
            _rename(spark, f"{path}/date={day}", f"{path}/_old-{day}")
            if f"date={day}" in made:
                _rename(spark, f"{new}/date={day}", f"{path}/date={day}")
            _remove(spark, f"{path}/_old-{day}")
        _remove(spark, new)

    def finalize(self, spark: SparkSession, r: Resource, links: Sequence, today: date, grace_days: int = 0, stage: str = HOT) -> list[date]:
        """Compacts the days of traces that ended at least grace days ago, and drops the traces that
        the sampling chain does not keep."""
        done = [d for d in self.days(spark, r, stage) if d + timedelta(days=1 + grace_days) <= today]
        self.compact(spark, r, done, stage, lambda df: sampled(df, r.trace_id, links))
        return done

    def expire(self, spark: SparkSession, r: Resource, ttl_days: int, today: date, segment_days: int = 1, stage: str = HOT) -> list[date]:
        """Drops the days of segments that ended ttl or more days ago; whole segments only."""
        gone = [d for d in self.days(spark, r, stage) if segment_end(d, segment_days) <= today - timedelta(days=ttl_days)]
        for d in gone:
            _remove(spark, f"{self.path(r, stage)}/date={d}")
        return gone

    def migrate(self, spark: SparkSession, r: Resource, days: Sequence[date], source: str, target: str) -> None:
        """Moves days to another stage by renaming their folders, or, where the stage has rows of the
        day already, their files: a row is in one stage or the other."""
        there = set(self.days(spark, r, target))
        for day in days:
            old, new = f"{self.path(r, source)}/date={day}", f"{self.path(r, target)}/date={day}"
            if day in there:
                for name in _names(spark, old):
                    _rename(spark, f"{old}/{name}", f"{new}/{name}")
                _remove(spark, old)
            else:
                _rename(spark, old, new)

    def backup(self, spark: SparkSession, r: Resource, target: Store, stage: str = HOT) -> None:
        spark.read.parquet(self.path(r, stage)).write.mode("overwrite").partitionBy("date").parquet(target.path(r, stage))

    def restore(self, spark: SparkSession, r: Resource, source: Store, stage: str = HOT) -> None:
        source.backup(spark, r, self, stage)

    def resegment(self, spark: SparkSession, r: Resource, target: Store, casts: dict[str, str] | None = None, stage: str = HOT) -> None:
        """Writes the rows anew elsewhere, with some columns in other types."""
        df = self.read(spark, r, stage).drop("date")
        target.append(df.select(*[(F.col(f"`{c}`").cast(casts[c]) if casts and c in casts else F.col(f"`{c}`")).alias(c) for c in df.columns]), r, stage)

    def dump(self, df: DataFrame, path: str) -> None:
        """Text form: arrays and bytes as JSON and base64."""
        cols = [F.base64(c).alias(c) if t == "binary" else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def segment_end(day: date, segment_days: int = 1) -> date:
    """The first day after the segment that holds a day; segments are aligned to the epoch."""
    n = (day - date(1970, 1, 1)).days
    return date(1970, 1, 1) + timedelta(days=(n // segment_days + 1) * segment_days)


def unexpired(df: DataFrame, ttl_days: int, now: Column, segment_days: int = 1, ts: str = "ts") -> DataFrame:
    """Rows whose segment ended less than ttl days before now."""
    day = F.datediff(F.to_date(F.col(f"`{ts}`")), F.lit("1970-01-01").cast("date"))
    end = (F.floor(day / segment_days) + 1) * segment_days
    return df.where(end > F.datediff(now, F.lit("1970-01-01").cast("date")) - ttl_days)


def _opened(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it; a path without a scheme is in the default one."""
    if "://" not in path and not path.startswith("file:"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        path = path if default.startswith("file:") else default.rstrip("/") + path
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _names(spark: SparkSession, path: str) -> list[str]:
    files, base = _opened(spark, path)
    return [f.base_name for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True))]


def _remove(spark: SparkSession, path: str) -> None:
    files, p = _opened(spark, path)
    if files.get_file_info(p).type is not fs.FileType.NotFound:
        files.delete_dir(p)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    (files, a), (_, b) = _opened(spark, old), _opened(spark, new)
    files.create_dir(b.rsplit("/", 1)[0], recursive=True)
    files.move(a, b)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint
    folder.  Only a local session without either gets a temporary one, set for the whole context."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RequestError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")
