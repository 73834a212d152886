"""Trace sampling: which traces stay when segments are finalized.

A chain keeps a trace if each of its links does; a link that fails keeps it.  Built-in links are
columns over one aggregate per trace; a user's own function runs on the trace's spans as pandas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TagRule:
    """Keeps a trace with a span whose tag exists, equals, is in, or matches a pattern."""

    tag: str
    op: str = "exists"
    value: object = None

    def hit(self) -> Column:
        c = F.col(f"`{self.tag}`")
        test = {"exists": lambda: c.isNotNull(), "equals": lambda: c == F.lit(self.value), "in": lambda: c.isin(list(self.value or [])), "regex": lambda: c.cast("string").rlike(str(self.value))}[self.op]()
        return F.coalesce(test, F.lit(False))


@dataclass(frozen=True)
class Sampler:
    """Slow traces, traces with errors, traces that a rule hits, and a share of the others stay."""

    threshold: int | None = None
    error: str | None = None  # a boolean SQL expression over a span
    rules: tuple[TagRule, ...] = ()
    rate: float = 0.0
    start: str = "start"
    duration: str = "duration"


def share(trace_id: str) -> Column:
    """A number in [0, 1) fixed by the trace id."""
    return F.pmod(F.xxhash64(F.col(f"`{trace_id}`")), F.lit(1_000_000)) / 1_000_000


def decisions(spans: DataFrame, trace_id: str, s: Sampler) -> DataFrame:
    """(trace id, keep).  A trace without any pair of start and duration stays."""
    aggs = [F.lit(False).alias("_k0")]
    if s.threshold is not None:
        end = F.col(f"`{s.start}`") + F.col(f"`{s.duration}`")
        pair = end.isNotNull()
        envelope = F.max(F.when(pair, end)) - F.min(F.when(pair, F.col(f"`{s.start}`")))
        aggs.append(F.coalesce(envelope >= s.threshold, F.lit(True)).alias("_k1"))
    if s.error:
        aggs.append(F.bool_or(F.coalesce(F.expr(s.error), F.lit(False))).alias("_k2"))
    aggs += [F.bool_or(rule.hit()).alias(f"_r{i}") for i, rule in enumerate(s.rules)]
    out = spans.groupBy(trace_id).agg(*aggs)
    keep = share(trace_id) < s.rate
    for c in out.columns[1:]:
        keep = keep | F.col(c)
    return out.select(trace_id, keep.alias("keep"))


def chain(spans: DataFrame, trace_id: str, links: Sequence[Sampler | Callable[[pd.DataFrame], bool]], columns: Sequence[str] | None = None) -> DataFrame:
    """(trace id, keep, failures) of several links.  A user's function sees the named columns, or all;
    one that raises keeps the trace and counts as a failure."""
    columns = [c for c in (spans.columns if columns is None else columns) if c != trace_id]
    parts = [decisions(spans, trace_id, s).withColumn("failures", F.lit(0)) for s in links if isinstance(s, Sampler)]
    if own := [f for f in links if not isinstance(f, Sampler)]:
        parts.append(_plugins(spans.select(*[F.col(f"`{c}`") for c in (trace_id, *columns)]), trace_id, own))
    if len(parts) == 1:
        return parts[0].withColumn("failures", F.col("failures").cast("long"))
    return reduce(DataFrame.union, parts).groupBy(trace_id).agg(F.bool_and("keep").alias("keep"), F.sum("failures").alias("failures"))


def _plugins(spans: DataFrame, trace_id: str, links: Sequence[Callable[[pd.DataFrame], bool]]) -> DataFrame:
    """(trace id, keep, failures) of users' functions.

    Spans come by trace, the first of each marked, in batches of many traces: a pandas group for each
    trace costs much more than most decisions.  Only the open trace is carried to the next batch.
    """
    key = F.col(f"`{trace_id}`")
    # By number: partitions put together by their bytes, as adaptive execution does, are few for narrow
    # spans, whose functions take time.
    dealt = spans.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    marked = dealt.select("*", (F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1).alias("_first"))
    schema = T.StructType([T.StructField(trace_id, spans.schema[trace_id].dataType), T.StructField("keep", T.BooleanType()), T.StructField("failures", T.IntegerType())])
    return marked.mapInArrow(_decider(links, spans.columns.index(trace_id), spans.sparkSession.conf.get("spark.sql.session.timeZone")), schema)


def _decider(links: Sequence[Callable[[pd.DataFrame], bool]], at: int, zone: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Decisions on marked spans whose column `at` is the trace id.  All is inside, so that it goes to
    workers by value."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole traces; one that may span batches comes alone, in one piece."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            if not len(begins):
                held.append(batch)
                continue
            if held:
                yield pa.Table.from_batches([*held, batch.slice(0, begins[0])]).combine_chunks()
            if begins[0] < begins[-1]:
                yield pa.Table.from_batches([batch.slice(begins[0], begins[-1] - begins[0])])
            held = [batch.slice(begins[-1])]
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks()

    def settled(c: pa.ChunkedArray | pa.Array) -> bool:
        """Whether each value's pandas form is the same beside any others: nulls turn integers and
        booleans, also nested ones, into other types."""
        if isinstance(c, pa.ChunkedArray):
            return all(settled(x) for x in c.chunks)
        if pa.types.is_map(c.type):
            return settled(c.keys) and settled(c.items)
        if pa.types.is_list(c.type) or pa.types.is_large_list(c.type):
            return settled(c.flatten())
        if pa.types.is_struct(c.type):
            return all(settled(x) for x in c.flatten())
        return c.null_count == 0 or not (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type))

    def alike(spans: pa.Table, begins: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of the traces that have nulls in the same columns, where that matters: together they
        give pandas the types that each alone does."""
        loose = [c for c in spans.columns if not settled(c)]
        if any(pa.types.is_nested(c.type) for c in loose):
            yield from np.arange(len(begins))[:, None]
        elif loose:
            holes = np.stack([np.logical_or.reduceat(c.is_null().to_numpy(), begins) for c in loose])
            kinds = np.unique(holes, axis=1, return_inverse=True)[1].ravel()
            yield from (np.flatnonzero(kinds == k) for k in range(kinds.max() + 1))
        else:
            yield np.arange(len(begins))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import _create_converter_to_pandas, from_arrow_type

        forms: dict[pa.DataType, Callable[[pd.Series], pd.Series]] = {}

        def series(c: pa.ChunkedArray, name: str) -> pd.Series:
            """As a grouped pandas function gets it."""
            if c.type not in forms:
                forms[c.type] = _create_converter_to_pandas(from_arrow_type(c.type, prefer_timestamp_ntz=True), timezone=zone, struct_in_pandas="dict")
            return forms[c.type](c.to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True)).rename(name)

        for table in whole(batches):
            spans = table.select(range(table.num_columns - 1))
            begins = np.flatnonzero(table.column(table.num_columns - 1).to_numpy())
            sizes = np.diff(np.append(begins, table.num_rows))
            keep, failures = np.ones(len(begins), dtype=bool), np.zeros(len(begins), dtype=np.int32)
            for traces in alike(spans, begins):
                if len(traces) == 1:
                    some = spans.slice(begins[traces[0]], sizes[traces[0]])
                else:
                    some = spans if len(traces) == len(begins) else spans.filter(pa.array(np.repeat(np.isin(np.arange(len(begins)), traces), sizes)))
                rows = pd.concat([series(c, name) for c, name in zip(some.columns, some.column_names)], axis=1)
                ends = np.cumsum(sizes[traces])
                for i, a, b in zip(traces.tolist(), (ends - sizes[traces]).tolist(), ends.tolist()):
                    for decide in links:
                        try:
                            keep[i] &= bool(decide(rows.iloc[a:b].reset_index(drop=True)))
                        except Exception:  # noqa: BLE001  a failing link is bypassed, and counted
                            failures[i] += 1
            yield pa.RecordBatch.from_arrays([spans.column(at).take(pa.array(begins)).combine_chunks(), pa.array(keep), pa.array(failures)], names=["id", "keep", "failures"])

    return run


def sampled(spans: DataFrame, trace_id: str, links: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """All spans of the traces that stay."""
    kept = chain(spans, trace_id, links, columns).where("keep").select(trace_id)
    return spans.join(kept, trace_id, "left_semi")
