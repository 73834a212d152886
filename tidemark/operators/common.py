"""Steps that all models share: time, projection, limits."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Catalog, Kind, Resource, Type, aligned, merged
from ..errors import RequestError
from ..model import Request
from .predicates import compile_criteria, conditions

#: Rows (traces for a trace query) that a request without a limit gives.
DEFAULT_LIMIT = {Kind.MEASURE: 100, Kind.STREAM: 20, Kind.TRACE: 20, Kind.PROPERTY: 100}
NUMERIC = (Type.INT, Type.FLOAT)
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def within(df: DataFrame, begin: datetime | None, end: datetime | None, ts: str = "ts") -> DataFrame:
    """Rows in the range, both ends included; days first, where rows are stored by day."""
    c = F.col(f"`{ts}`")
    lit = (lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")) if isinstance(df.schema[ts].dataType, T.TimestampNTZType) else (lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%fZ")).cast("timestamp"))
    if begin is not None:
        df = df.where(c >= lit(begin))
        df = df.where(F.col("date") >= F.lit(begin.strftime("%Y-%m-%d")).cast("date")) if "date" in df.columns else df
    if end is not None:
        df = df.where(c <= lit(end))
        df = df.where(F.col("date") <= F.lit(end.strftime("%Y-%m-%d")).cast("date")) if "date" in df.columns else df
    return df


def segments(df: DataFrame, begin: datetime | None, end: datetime | None, ts: str, days: int) -> DataFrame:
    """Rows of the segments (so many days, aligned to the epoch) that overlap the range.  The bounds
    are constants, which reach the scan."""
    first = None if begin is None else _EPOCH + timedelta(days=(begin - _EPOCH).days // days * days)
    last = None if end is None else _EPOCH + timedelta(days=((end - _EPOCH).days // days + 1) * days, microseconds=-1)
    return within(df, first, last, ts)


def clamped(q: Request, resources: list[Resource]) -> datetime | None:
    """Where the range begins: not before the resources were created."""
    created = [r.created for r in resources if r.created]
    return max(q.begin, *created) if q.begin and created else q.begin


def source(spark: SparkSession, catalog: Catalog, kind: Kind, q: Request) -> tuple[DataFrame, Resource]:
    """Rows of all groups under one schema, in the time range; traces by whole segments.

    The range begins no earlier than the last of the groups' resources was created.
    """
    if not q.groups:
        raise RequestError("a request names at least one group")
    resources = [catalog.get(kind, g, q.name) for g in q.groups]
    schema, conflicts = merged(resources)
    out = None
    begin = clamped(q, resources)
    for r in resources:
        df = catalog.frame(spark, r, q.stages)
        if kind is Kind.TRACE and not q.exact_time:
            group = catalog.groups.get(r.group)
            df = segments(df, begin, q.end, r.timestamp, group.segment_days if group else 1)
        elif kind is not Kind.PROPERTY:
            df = within(df, begin, q.end, r.timestamp)
        df = aligned(df, r, schema, conflicts) if len(resources) > 1 else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    bad = conflicts & {t for t in (x.name for x in _ranges(q)) if t}
    if bad:
        raise RequestError(f"{', '.join(sorted(bad))}: groups differ in its type, so it has no order")
    return out, schema


def _ranges(q: Request):
    return [c for c in conditions(q.criteria) if c.op in ("LT", "LE", "GT", "GE")]


def filtered(df: DataFrame, q: Request, r: Resource) -> DataFrame:
    c = compile_criteria(q.criteria, r)
    return df if c is None else df.where(c)


def projected(r: Resource, tags: tuple[str, ...] | None, fields: tuple[str, ...] | None = ()) -> list[str]:
    """Names of the asked columns, each once; None asks for all."""
    out = []
    for name in [t.name for t in r.tags] if tags is None else tags:
        t = r.tag(name)
        if t is None:
            raise RequestError(f"{r.name} has no tag {name}")
        out.append(t.name)
    for name in [f.name for f in r.fields] if fields is None else fields:
        if r.field_(name) is None:
            raise RequestError(f"{r.name} has no field {name}")
        out.append(name)
    return list(dict.fromkeys(out))


def chosen(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])


def pruned(df: DataFrame, r: Resource, q: Request, *names: str | None) -> DataFrame:
    """The columns that a request can touch.  A dedup carries whole rows, so what it need not carry
    must go before it; below a plain projection Catalyst would see to that itself."""
    keep = {n for n in names if n} | {t.name for c in conditions(q.criteria) if (t := r.tag(c.name))}
    for asked, have in ((q.tags, r.tags), (getattr(q, "fields", ()), r.fields)):
        keep |= {x.name for x in have} if asked is None else {t.name if (t := r.tag(n)) else n for n in asked}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def directed(c: Column, desc: bool) -> Column:
    """Null counts as the lowest value."""
    return c.desc_nulls_last() if desc else c.asc_nulls_first()


def order_tag(r: Resource, by: str) -> str:
    """The tag of a sortable single-tag index rule."""
    rule = r.rule(by)
    if rule is None:
        raise RequestError(f"{r.name} has no index rule {by} to order by")
    if not rule.sortable or len(rule.tags) != 1:
        raise RequestError(f"index rule {by} cannot order rows")
    return rule.tags[0]


#: Spark's own limit counts with 31 bits; the largest count that a request can hold asks for all rows.
MOST, ALL = 2**31 - 1, 2**32 - 1


def page(df: DataFrame, q: Request, kind: Kind) -> DataFrame:
    """Offset, then limit.  The limit ALL cuts nothing, so the sort stays distributed."""
    if q.offset > MOST:
        raise RequestError(f"an offset is at most {MOST}")
    df = df.offset(q.offset) if q.offset else df
    n = q.limit or DEFAULT_LIMIT[kind]
    if MOST < n < ALL:
        raise RequestError(f"a limit is at most {MOST}, or {ALL} for all rows")
    return df if n == ALL else df.limit(n)
