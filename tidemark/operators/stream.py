"""Stream queries: elements by time or by an indexed tag, one row for each element id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, Kind
from ..model import StreamQuery
from . import dedup
from .common import chosen, directed, filtered, order_tag, page, projected, pruned, source
from .predicates import check_stream


def run(spark: SparkSession, catalog: Catalog, q: StreamQuery) -> DataFrame:
    df, r = source(spark, catalog, Kind.STREAM, q)
    check_stream(q.criteria, r)
    key = order_tag(r, q.order.by) if q.order and q.order.by else r.timestamp
    desc = bool(q.order and q.order.desc)
    df = filtered(pruned(df, r, q, r.element_id, r.timestamp, key), q, r)
    if not r.unique:
        # The copy that comes first in the query's order stays: the least one, or the greatest.
        by = F.col(f"`{key}`")
        df = dedup.best(df, [r.element_id], [by]) if desc else dedup.first(df, [r.element_id], [key])
    df = page(df.orderBy(directed(F.col(f"`{key}`"), desc), F.col(f"`{r.element_id}`")), q, Kind.STREAM)
    return chosen(df, r.element_id, r.timestamp, *projected(r, q.tags))

