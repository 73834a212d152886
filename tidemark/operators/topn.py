"""Continuous rankings: per time bucket and group, the best values by series; and their queries.

In a bucket the latest write of a series replaces its earlier ones; then the best `counters` series
of each group are kept.  The lists are rows, one for each (bucket, group, series, direction).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Kind, Ranking, Resource, Type
from ..errors import RequestError
from ..functions.aggregates import aggregate, numeric
from ..model import TopNQuery
from . import dedup
from .common import clamped, within
from .predicates import compile_criteria, conditions


def text_of(r: Resource, name: str) -> Column:
    """A tag as part of a group key: null is empty, arrays are comma-joined, bytes base64."""
    t, c = r.tag(name), F.col(f"`{name}`")
    if t.type.array:
        c = F.array_join(c.cast("array<string>"), ",")
    elif t.type is Type.DATA_BINARY:
        c = F.base64(c)
    return F.coalesce(c.cast("string"), F.lit(""))


def group_tags(ranking: Ranking, r: Resource) -> list[str]:
    """The group's tags that the measure still has; if none is left, the ranking is void."""
    left = [t for t in ranking.group_by if r.tag(t)]
    if ranking.group_by and not left:
        raise RequestError(f"ranking {ranking.name}: none of its group tags exist any more")
    return left


def prepared(df: DataFrame, ranking: Ranking, r: Resource) -> DataFrame:
    """bucket, group_key, group tags, entity, value, ts, version of the points that count."""
    f = numeric(r.field_(ranking.field), ranking.field)
    c = compile_criteria(ranking.criteria, r)
    df = df if c is None else df.where(c)
    tags = group_tags(ranking, r)
    ts = F.col(f"`{r.timestamp}`")
    if isinstance(df.schema[r.timestamp].dataType, T.TimestampNTZType):
        ts = ts.cast("timestamp")
    key = F.concat_ws("|", *[text_of(r, t) for t in tags]) if tags else F.lit("")
    names = list(dict.fromkeys([*tags, *r.entity]))
    return df.select(F.window(ts, ranking.interval)["start"].alias("bucket"), key.alias("group_key"), *[F.col(f"`{n}`") for n in names], F.col(f"`{f.name}`").alias("value"), ts.alias("ts"), F.col("version"))


def ranked(points: DataFrame, ranking: Ranking, entity: tuple[str, ...]) -> DataFrame:
    """The lists: the last value of each series in a bucket, then the best of each group.

    The window's partitions are (bucket, group) after one row is left for each series.
    """
    keys = [c for c in points.columns if c not in ("value", "ts", "version")]
    last = dedup.best(points, keys, [F.col("ts"), F.col("version")]).where("value is not null")
    out = None
    for name in ("asc", "desc") if ranking.sort is None else (ranking.sort.lower(),):
        by = F.col("value").desc() if name == "desc" else F.col("value").asc()
        w = Window.partitionBy("bucket", "group_key").orderBy(by, *[F.col(f"`{e}`") for e in entity])
        one = last.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ranking.counters).withColumn("direction", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def lists(spark: SparkSession, catalog: Catalog, group: str, name: str, begin: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Batch form of a ranking over the points of its measure, of the buckets that begin in the range.

    The range is tested on the points' own time, by constants, so that it reaches the scan.  The last
    write in a bucket is of the highest version; only a test of other than entity tags needs the
    versions sorted out before it.
    """
    ranking, r = _of(catalog, group, name)
    df = within(catalog.frame(spark, r), begin, end and end + _length(ranking.interval), r.timestamp)
    entity_only = all((t := r.tag(c.name)) and t.name in r.entity for c in conditions(ranking.criteria))
    df = df if r.unique or entity_only else dedup.versions(df, r.entity, r.timestamp)
    return ranked(prepared(df, ranking, r), ranking, r.entity)


def _length(interval: str) -> timedelta:
    n, unit = interval.split()
    return timedelta(**{unit.rstrip("s") + "s": int(n)})


def _of(catalog: Catalog, group: str, name: str) -> tuple[Ranking, Resource]:
    ranking = catalog.rankings.get((group, name))
    if ranking is None:
        raise RequestError(f"no ranking {name} in group {group}")
    return ranking, catalog.get(Kind.MEASURE, ranking.source_group, ranking.source)


def newest(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Of repeated snapshots of a bucket, the rows of the latest version: (bucket, group, direction)
    share a version, so older snapshots go as a whole."""
    last = snapshots.groupBy("bucket", "group_key", "direction").agg(F.max("version").alias("version"))
    return snapshots.join(last, ["bucket", "group_key", "direction", "version"]).dropDuplicates(["bucket", "group_key", "direction", *keys])


def run(spark: SparkSession, catalog: Catalog, q: TopNQuery, per_bucket: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """The best n entities over the range, or n for each bucket.

    An entity counts with its best value; an aggregate then runs over that one value, so COUNT is 1
    and the others give the value itself.
    """
    if q.desc is None:
        raise RequestError("a ranking query needs a direction: ORDER BY ASC or DESC")
    direction = "desc" if q.desc else "asc"
    begin = clamped(q, [_of(catalog, g, q.name)[1] for g in q.groups])
    out = entity = field = None
    for g in q.groups:
        ranking, r = _of(catalog, g, q.name)
        if ranking.sort and ranking.sort.lower() != direction:
            raise RequestError(f"ranking {q.name} keeps {ranking.sort} values only")
        if entity is not None and (entity, field) != (r.entity, ranking.field):
            raise RequestError(f"ranking {q.name}: groups differ in entity or field")
        entity, field, type_ = r.entity, ranking.field, r.field_(ranking.field).type
        df = (stored if stored is not None else lists(spark, catalog, g, q.name, begin, q.end)).where(F.col("direction") == direction)
        df = within(df, begin, q.end, "bucket")
        df = _conditioned(df, q, group_tags(ranking, r))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    by = F.col("value").desc() if q.desc else F.col("value").asc()
    ends = [F.col(f"`{e}`") for e in entity]
    if per_bucket:
        w = Window.partitionBy("bucket").orderBy(by, *ends)
        return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= q.n).select("bucket", *entity, F.col("value").alias(field))
    best = out.groupBy(*entity).agg((F.max("value") if q.desc else F.min("value")).alias("value"))
    top = best.orderBy(by, *ends).limit(q.n)
    if q.aggregate:
        from ..catalog import Field

        value = aggregate(q.aggregate, Field("value", type_))
        top = top.groupBy(*entity).agg(value.alias("value")).orderBy(by, *ends)
    return top.select(*entity, F.col("value").alias(field))


def _conditioned(df: DataFrame, q: TopNQuery, tags: list[str]) -> DataFrame:
    """Equality on the group's tags: all of them, or none."""
    given = {c.name: c for c in q.conditions}
    if not given:
        return df
    if any(c.op != "EQ" for c in q.conditions):
        raise RequestError("a ranking's conditions are equalities")
    if set(given) != set(tags):
        raise RequestError(f"conditions must name all group tags: {', '.join(tags)}")
    for name, c in given.items():
        df = df.where(F.coalesce(F.col(f"`{name}`") == F.lit(c.value), F.lit(False)))
    return df
