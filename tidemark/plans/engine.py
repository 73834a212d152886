"""Runs requests and query texts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog
from ..errors import RequestError
from ..model import MeasureQuery, PropertyQuery, Request, StreamQuery, TopNQuery, TraceQuery
from ..operators import measure, property, stream, topn, trace
from .bind import request


class Engine:
    """The catalog's resources, queried by text or by request object.

    strict: null groups, and MAX and MIN of nothing, as the row-at-a-time engines of the data model
    give them; by default they are SQL's.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog, strict: bool = False):
        self.spark, self.catalog, self.strict = spark, catalog, strict

    def query(self, text: str, params: Sequence[object] = (), now: datetime | None = None) -> DataFrame:
        return self.run(request(text, self.catalog, params, now))

    def run(self, q: Request) -> DataFrame:
        if q.begin and q.end and q.begin > q.end:
            raise RequestError("the time range ends before it begins")
        if isinstance(q, MeasureQuery):
            out = measure.run(self.spark, self.catalog, q, self.strict)
        elif isinstance(q, StreamQuery):
            out = stream.run(self.spark, self.catalog, q)
        elif isinstance(q, TraceQuery):
            out = trace.run(self.spark, self.catalog, q)
        elif isinstance(q, PropertyQuery):
            out = property.run(self.spark, self.catalog, q)
        elif isinstance(q, TopNQuery):
            out = topn.run(self.spark, self.catalog, q)
        else:
            raise RequestError(f"unknown request {type(q).__name__}")
        if q.explain:
            out.explain("formatted")
        return out
