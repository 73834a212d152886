"""Measure queries: scan, dedup, group, aggregate, top, page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Kind, Resource, Type
from ..errors import RequestError
from ..functions.aggregates import aggregate, final, numeric, partial
from ..model import MeasureQuery
from . import dedup
from .common import chosen, directed, filtered, order_tag, page, projected, pruned, source
from .predicates import check_measure


def scan(spark: SparkSession, catalog: Catalog, q: MeasureQuery) -> tuple[DataFrame, Resource]:
    """Filtered points, one for each (series, time).

    Conditions on entity tags hold alike for all versions of a point, so they go below the dedup
    and reach the scan; conditions on other tags are tested on the version that stays.
    """
    df, r = source(spark, catalog, Kind.MEASURE, q)
    if q.begin is None and q.end is None and not r.index_mode:
        return df.limit(0), r
    check_measure(q.criteria, r)
    groups = [t.name for n in q.group_by or () if (t := r.tag(n))]
    order = order_tag(r, q.order.by) if q.order and q.order.by else None
    df = pruned(df, r, q, *r.entity, *r.sharding_key, r.timestamp, "version", *groups, q.group_field, q.aggregate and q.aggregate[1], q.top and q.top.field, order)
    if r.index_mode:
        df = dedup.latest(df, r.entity, r.timestamp)
    elif not r.unique:
        df = dedup.versions(df, r.entity, r.timestamp)
    return filtered(df, q, r), r


def _keys(r: Resource, names: tuple[str, ...], strict: bool) -> list[Column]:
    tags = [r.tag(n) for n in names]
    for n, t in zip(names, tags, strict=True):
        if t is None:
            raise RequestError(f"{r.name} has no tag {n} to group by")
        if t.type.array or t.type is Type.DATA_BINARY:
            raise RequestError(f"{n} is {t.type.value} and cannot be a group key")
    if len({t.family for t in tags}) > 1:
        raise RequestError("the tags of a GROUP BY are of one family")
    empty = {Type.INT: F.lit(0).cast("long"), Type.STRING: F.lit("")}
    return [(F.coalesce(F.col(f"`{t.name}`"), empty[t.type]) if strict and t.type in empty else F.col(f"`{t.name}`")).alias(t.name) for t in tags]


def _first(r: Resource, name: str) -> Column:
    """The group's first value, by time and series."""
    return F.min_by(F.col(f"`{name}`"), F.struct(F.col(f"`{r.timestamp}`"), *[F.col(f"`{e}`") for e in r.entity])).alias(name)


def first_rows(df: DataFrame, r: Resource, keys: tuple[str, ...]) -> DataFrame:
    """GROUP BY without an aggregate: the first row of each group."""
    rest = [c for c in df.columns if c not in set(keys)]
    by = F.struct(F.col(f"`{r.timestamp}`"), *[F.col(f"`{e}`") for e in r.entity])
    got = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), by).alias("_w"))
    return got.select(*[F.col(f"`{c}`") if c in set(keys) else F.col(f"_w.`{c}`").alias(c) for c in df.columns])


def run(spark: SparkSession, catalog: Catalog, q: MeasureQuery, strict: bool = False) -> DataFrame:
    df, r = scan(spark, catalog, q)
    order: list[Column] = []
    if q.aggregate:
        function, name = q.aggregate
        f = numeric(r.field_(name), name)
        if q.group_by:
            keys = _keys(r, q.group_by, strict)
            names = [r.tag(n).name for n in q.group_by]
            others = [r.tag(n).name for n in (q.tags or ()) if r.tag(n) and r.tag(n).name not in names]
            out = df.groupBy(*keys).agg(aggregate(function, f, strict).alias(f.name), *[_first(r, n) for n in others])
            out = out.select(*names, *others, f.name)
            tie = names
        else:
            out = df.agg(aggregate(function, f, strict).alias(f.name), F.count(F.lit(1)).alias("_n")).where("_n > 0").select(f.name)
            tie = []
    elif q.group_by:
        names = [r.tag(n).name if r.tag(n) else n for n in q.group_by]
        _keys(r, q.group_by, strict)
        out, tie = first_rows(df, r, tuple(names)), [r.timestamp, *r.entity]
    else:
        out, tie = df, [r.timestamp, *r.entity]
    if q.top:
        numeric(r.field_(q.top.field), q.top.field)
        out = out.orderBy(directed(F.col(f"`{q.top.field}`"), q.top.desc), *[F.col(f"`{t}`") for t in tie]).limit(q.top.n)
        order = [directed(F.col(f"`{q.top.field}`"), q.top.desc), *[F.col(f"`{t}`") for t in tie]]
    elif q.aggregate:
        order = [F.col(f"`{t}`") for t in tie]
    elif q.order and q.order.by:
        order = [directed(F.col(f"`{order_tag(r, q.order.by)}`"), q.order.desc), *[F.col(f"`{t}`") for t in tie]]
    else:
        desc = bool(q.order and q.order.desc)
        order = [directed(F.col(f"`{r.timestamp}`"), desc), *[F.col(f"`{e}`") for e in r.entity]]
    if order:
        out = out.orderBy(*order)
    out = page(out, q, Kind.MEASURE)
    if q.aggregate:
        return out
    head = [c for c in (r.timestamp, "version") if c in out.columns]
    return chosen(out, *head, *projected(r, q.tags, q.fields))


def partials(spark: SparkSession, catalog: Catalog, q: MeasureQuery, shards: int) -> DataFrame:
    """What data nodes would send for an aggregate: partial results by shard and group."""
    df, r = scan(spark, catalog, q)
    f = numeric(r.field_(q.aggregate[1]), q.aggregate[1])
    shard = F.pmod(F.xxhash64(*[F.col(f"`{e}`") for e in (r.sharding_key or r.entity)]), F.lit(shards)).alias("__shard")
    return df.groupBy(shard, *_keys(r, q.group_by or (), False)).agg(*partial(q.aggregate[0], f))


def reduced(parts: DataFrame, function: str, field, keys: list[str]) -> DataFrame:
    """The final results from partial ones; copies of a shard's partial count once."""
    once = dedup.replicas(parts, "__shard", keys)
    return once.groupBy(*keys).agg(final(function, field).alias(field.name))
