"""Trace queries: by ids, or ordered by an index rule's key; a trace comes with all its spans.

Ids are found on narrow columns and limited before any span is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Kind, Resource, Type
from ..errors import RequestError
from ..model import TraceQuery
from . import dedup
from .common import chosen, filtered, page, projected, source, within
from .predicates import trace_ids


def selected(df: DataFrame, q: TraceQuery, r: Resource, ids: list[str] | None) -> DataFrame:
    """(trace id, rank): the traces of the answer, in order, after offset and limit.

    A trace counts if any of its spans passes the criteria.  By a key, it ranks by its least
    (ascending) or greatest key among the spans that have one.
    """
    tid = F.col(f"`{r.trace_id}`")
    number = r.tag(r.trace_id) is not None and r.tag(r.trace_id).type is Type.INT
    hits = df if ids is None else df.where(tid.isin([int(i) for i in ids] if number else ids))
    hits = filtered(hits, q, r)
    rule = r.rule(q.order.by) if q.order and q.order.by else None
    if q.order and q.order.by and rule is None:
        raise RequestError(f"{r.name} has no index rule {q.order.by} to order by")
    if rule:
        key = r.tag(rule.tags[-1])
        if key.type not in (Type.INT, Type.TIMESTAMP):
            raise RequestError(f"{key.name} is {key.type.value} and cannot order traces")
        if key.name == r.timestamp:
            hits = within(hits, q.begin, q.end, r.timestamp)
        k = F.col(f"`{key.name}`")
        ranked = hits.where(k.isNotNull()).groupBy(tid.alias(r.trace_id)).agg((F.max(k) if q.order.desc else F.min(k)).alias("_rank"))
        by = F.col("_rank").desc() if q.order.desc else F.col("_rank").asc()
    else:
        ranked = hits.select(r.trace_id).distinct().withColumn("_rank", F.lit(0))
        by = F.col("_rank").asc()
    ranked = ranked.orderBy(by, tid)
    return page(ranked, q, Kind.TRACE)


def key_scan(df: DataFrame, r: Resource, rule: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(trace id, span id, key): the entries of an order key in a range, of all series, both ends
    included; spans without the key have no entry."""
    x = r.rule(rule)
    if x is None or r.tag(x.tags[-1]).type not in (Type.INT, Type.TIMESTAMP):
        raise RequestError(f"{r.name} has no index rule {rule} with a key")
    k = F.col(f"`{x.tags[-1]}`")
    df = df.where(k.isNotNull())
    df = df if low is None else df.where(k >= low)
    df = df if high is None else df.where(k <= high)
    return chosen(df, r.trace_id, r.span_id, x.tags[-1])


def run(spark: SparkSession, catalog: Catalog, q: TraceQuery) -> DataFrame:
    """One row for each span of the answer, with its trace's rank columns left out."""
    df, r = source(spark, catalog, Kind.TRACE, q)
    ids = trace_ids(q.criteria, r)
    if ids is None and q.order is None:
        raise RequestError("a trace query needs trace ids or an order")
    if q.order is not None and q.order.by is None and ids is None:
        raise RequestError("a trace query is ordered by an index rule")
    if not r.unique:
        df = dedup.first(df, [r.trace_id, r.span_id], [r.timestamp])
    top = selected(df, q, r, ids)
    out = df.join(top, r.trace_id)
    desc = bool(q.order and q.order.desc)
    out = out.orderBy(F.col("_rank").desc() if desc else F.col("_rank").asc(), F.col(f"`{r.trace_id}`"), F.col(f"`{r.span_id}`"))
    body = ["span"] if "span" in df.columns else []
    return chosen(out, r.trace_id, r.span_id, *projected(r, q.tags), *body)


def assembled(spans: DataFrame, trace_id: str, span_id: str) -> DataFrame:
    """One row for each trace: its spans as an array, by span id."""
    rest = [c for c in spans.columns if c != trace_id]
    spans = spans.select(trace_id, F.struct(F.col(f"`{span_id}`"), *[F.col(f"`{c}`") for c in rest if c != span_id]).alias("_s"))
    return spans.groupBy(trace_id).agg(F.sort_array(F.collect_list("_s")).alias("spans"))


def without(spans: DataFrame, dropped: DataFrame, trace_id: str) -> DataFrame:
    """Spans of the traces that sampling kept."""
    return spans.join(dropped.select(trace_id), trace_id, "left_anti")
