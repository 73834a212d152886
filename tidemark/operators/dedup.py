"""Which of several copies of a row stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_types(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns that have an order (maps have none)."""
    return [n for n in names if not isinstance(df.schema[n].dataType, T.MapType)]


def best(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """One row for each key: the one whose `by` columns are greatest.

    An aggregate, not a window: rows of a key combine before they are shuffled, so a hot key costs
    a row for each task.  Ties are broken by the rest of the row, which makes the choice repeatable.
    """
    rest = [c for c in df.columns if c not in set(keys)]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    tie = F.struct(*by, *[F.col(f"`{c}`") for c in ordered_types(df, rest)])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(whole, tie).alias("_w"))
    return got.select(*[F.col(f"`{c}`") if c in set(keys) else F.col(f"_w.`{c}`").alias(c) for c in df.columns])


def first(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row for each key: the one whose `by` columns are least; ties by the rest of the row."""
    rest = [c for c in df.columns if c not in set(keys)]
    tie = F.struct(*[F.col(f"`{c}`") for c in by], *[F.col(f"`{c}`") for c in ordered_types(df, rest)])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), tie).alias("_w"))
    return got.select(*[F.col(f"`{c}`") if c in set(keys) else F.col(f"_w.`{c}`").alias(c) for c in df.columns])


def series(df: DataFrame, name: str, entity: Sequence[str]) -> DataFrame:
    """Adds sid, the series: a hash of the resource's name and its entity values."""
    return df.withColumn("sid", F.xxhash64(F.lit(name), *[F.col(f"`{e}`") for e in entity]))


def versions(df: DataFrame, entity: Sequence[str], ts: str = "ts", version: str = "version") -> DataFrame:
    """The highest version of each point (series and time)."""
    return best(df, [*entity, ts], [F.col(f"`{version}`")])


def latest(df: DataFrame, entity: Sequence[str], ts: str = "ts") -> DataFrame:
    """The last document of each series (index-mode measures)."""
    return best(df, list(entity), [F.col(f"`{ts}`")])


def revisions(df: DataFrame, deleted: bool = False) -> DataFrame:
    """The latest revision of each property; a tombstone hides it."""
    out = best(df, ["group", "name", "id"], [F.col("mod_revision")])
    return out if deleted else out.where("delete_time is null")


def replicas(df: DataFrame, shard: str, keys: Sequence[str]) -> DataFrame:
    """One partial result for each shard and group key: copies from replicas don't count twice."""
    return df.dropDuplicates([shard, *keys])
