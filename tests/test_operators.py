"""Semantics that the catalogue queries don't show: nulls, plans, storage, streams, sampling."""

from datetime import date, datetime, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, Field, IndexRule, Kind, Resource, Tag, Type, merged
from tidemark.errors import RequestError
from tidemark.model import Cond, MeasureQuery, Or, StreamQuery
from tidemark.operators import dedup, sampling
from tidemark.operators.predicates import compile_criteria
from tidemark.plans.engine import Engine
from tidemark.sources.storage import Store, segment_end

BEGIN, END = datetime(2020, 1, 1, tzinfo=timezone.utc), datetime(2030, 1, 1, tzinfo=timezone.utc)
R = Resource(Kind.STREAM, "g", "s", (Tag("a"), Tag("n", Type.INT), Tag("xs", Type.STRING_ARRAY)))


@pytest.fixture(scope="module")
def few(spark):
    return spark.sql("SELECT * FROM VALUES ('a', 1L, array('x', 'y')), (NULL, NULL, NULL), ('', 0L, array()), ('b', -5L, array('y', NULL)) AS t(a, n, xs)")


@pytest.mark.parametrize(
    ("cond", "want"),
    [
        (Cond("a", "EQ", "a"), 1),
        (Cond("a", "EQ", None), 0),
        (Cond("a", "NE", None), 4),
        (Cond("a", "NE", "a"), 3),
        (Cond("n", "LT", 1), 2),
        (Cond("n", "GE", None), 0),
        (Cond("a", "IN", ["a", "b"]), 2),
        (Cond("a", "NOT_IN", ["a", "b"]), 2),
        (Cond("xs", "HAVING", ["y"]), 2),
        (Cond("xs", "HAVING", ["x", "y"]), 1),
        (Cond("xs", "NOT_HAVING", ["y"]), 2),
        (Cond("a", "HAVING", "a"), 1),
        (Cond("a", "MATCH", ["A"]), 0),
        (Or(Cond("a", "EQ", "a"), None), 1),
    ],
)
def test_null_rules(few, cond, want):
    assert few.where(compile_criteria(cond, R)).count() == want


def test_both_sides_missing():
    with pytest.raises(RequestError):
        compile_criteria(Or(None, None), R)


def test_best_is_order_free(spark):
    df = spark.sql("SELECT id % 10 AS k, id AS v, cast(id AS string) AS s FROM range(1000)")
    a = sorted(map(tuple, dedup.best(df, ["k"], [F.col("v") % 7]).collect()))
    b = sorted(map(tuple, dedup.best(df.orderBy(F.desc("v")), ["k"], [F.col("v") % 7]).collect()))
    assert a == b and len(a) == 10


def test_entity_filter_reaches_the_scan(spark, sf):
    from tidemark.bindings import catalog

    c = catalog(sf)
    df = Engine(spark, c).query("SELECT user_id, value::field FROM MEASURE event_value IN ev TIME BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-20T00:00:00Z' WHERE event_type = 'click'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_dedup_reads_only_what_is_asked(spark, sf):
    from tidemark.bindings import catalog

    df = Engine(spark, catalog(sf)).query("SELECT l_suppkey, quantity_i::field, SUM(quantity_i) FROM MEASURE supply IN tpch TIME > '1990-01-01T00:00:00Z' GROUP BY l_suppkey, quantity_i")
    schema = df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "l_quantity" in schema and "l_returnflag" not in schema


def test_missing_time_range_is_empty(spark, sf):
    from tidemark.bindings import catalog

    assert Engine(spark, catalog(sf)).query("SELECT user_id FROM MEASURE event_value IN ev").count() == 0


def test_merged_schemas():
    other = Resource(Kind.STREAM, "h", "s", (Tag("a", Type.INT), Tag("z")))
    r, conflicts = merged([R, other])
    assert conflicts == {"a"} and [t.name for t in r.tags] == ["a", "n", "xs", "z"]
    with pytest.raises(RequestError):
        merged([R, Resource(Kind.STREAM, "h", "s", (Tag("a"),), entity=("a",))])
    with pytest.raises(RequestError):
        merged([Resource(Kind.STREAM, "g", "s", (Tag("a"),), rules=(IndexRule("i", ("a",)),)), Resource(Kind.STREAM, "h", "s", (Tag("b"),), rules=(IndexRule("i", ("b",)),))])


def test_clamp_to_creation(spark):
    c = Catalog()
    r = Resource(Kind.STREAM, "g", "s", (Tag("a"),), created=datetime(2024, 1, 2, tzinfo=timezone.utc))
    c.add(r, lambda s: s.sql("SELECT * FROM VALUES ('1', 'x', timestamp '2024-01-01'), ('2', 'y', timestamp '2024-01-03') AS t(element_id, a, ts)"))
    assert [x.a for x in Engine(spark, c).run(StreamQuery(("g",), "s", BEGIN, END)).collect()] == ["y"]


def test_registry():
    c = Catalog()
    c.add(R, lambda s: None)
    assert c.list(Kind.STREAM, "g") == [R] and c.bind(Kind.STREAM, "g", "s", IndexRule("n", ("n",))).rule("n")
    assert c.drop(Kind.STREAM, "g", "s") and not c.drop(Kind.STREAM, "g", "s")
    with pytest.raises(RequestError):
        c.add(Resource(Kind.MEASURE, "g", "m", (Tag("x"),), (Field("x"),)), lambda s: None)


def test_strict_groups(spark):
    c = Catalog()
    r = Resource(Kind.MEASURE, "g", "m", (Tag("k"),), (Field("v"),), ("k",))
    c.add(r, lambda s: s.sql("SELECT * FROM VALUES ('', 1L, timestamp '2024-01-01', 1L), (NULL, 2L, timestamp '2024-01-01', 1L) AS t(k, v, ts, version)"))
    q = MeasureQuery(("g",), "m", BEGIN, END, group_by=("k",), aggregate=("SUM", "v"))
    assert Engine(spark, c).run(q).count() == 2
    assert [x.v for x in Engine(spark, c, strict=True).run(q).collect()] == [3]


@pytest.fixture
def stored(spark, tmp_path):
    r = Resource(Kind.MEASURE, "g", "m", (Tag("k"),), (Field("v"),), ("k",))
    df = spark.sql("SELECT * FROM VALUES ('a', 1L, timestamp '2024-01-01 01:00', 1L), ('a', 2L, timestamp '2024-01-01 01:00', 2L), ('b', 3L, timestamp '2024-01-02 01:00', 1L), ('b', 4L, timestamp '2024-01-05 01:00', 1L) AS t(k, v, ts, version)")
    s = Store(f"file://{tmp_path}/hot")
    s.append(df, r, bloom=("k",))
    return s, r


def test_store(spark, stored, tmp_path):
    s, r = stored
    assert s.days(spark, r) == [date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 5)]
    s.compact(spark, r, s.days(spark, r))
    assert sorted(x.v for x in s.read(spark, r).collect()) == [2, 3, 4]
    other = Store(f"file://{tmp_path}/copy")
    s.backup(spark, r, other)
    s.migrate(spark, r, [date(2024, 1, 2)], "hot", "cold")
    assert sorted(x.v for x in s.read(spark, r).collect()) == [2, 4] and [x.v for x in s.read(spark, r, "cold").collect()] == [3]
    assert s.expire(spark, r, 2, date(2024, 1, 5)) == [date(2024, 1, 1)]
    s.restore(spark, r, other)
    assert s.read(spark, r).count() == 3
    new = Store(f"file://{tmp_path}/new")
    s.resegment(spark, r, new, {"v": "string"})
    assert dict(new.read(spark, r).dtypes)["v"] == "string"
    s.dump(s.read(spark, r), f"file://{tmp_path}/dump")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/dump").count() == 3


def test_store_prunes_days(spark, stored):
    s, r = stored
    c = Catalog()
    c.add(r, s.loader(r))
    df = Engine(spark, c).run(MeasureQuery(("g",), "m", datetime(2024, 1, 2, tzinfo=timezone.utc), datetime(2024, 1, 3, tzinfo=timezone.utc)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and [x.v for x in df.collect()] == [3]


def test_segments():
    assert segment_end(date(2024, 1, 1)) == date(2024, 1, 2)
    assert (segment_end(date(2024, 1, 1), 7) - date(1970, 1, 1)).days % 7 == 0


def test_streaming_update_and_repeat(spark, tmp_path):
    """Two batches: a later value replaces an earlier one, and a batch may run twice."""
    from tidemark.catalog import Ranking
    from tidemark.streaming.topn import RankingStream

    c = Catalog()
    r = Resource(Kind.MEASURE, "g", "m", (Tag("k"), Tag("grp")), (Field("v"),), ("k",))
    c.add(r, lambda s: None)
    c.add_ranking(Ranking("g", "t", "m", "g", "v", ("grp",), "DESC", counters=2))
    job = RankingStream(spark, c, "g", "t", f"file://{tmp_path}")
    first = spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS bucket, 'x' AS group_key, 'x' AS grp, k, v AS value, ts, 1L AS version FROM VALUES ('a', 9L, timestamp '2024-01-01 00:00:01'), ('b', 5L, timestamp '2024-01-01 00:00:01'), ('c', 1L, timestamp '2024-01-01 00:00:01') AS t(k, v, ts)")
    job._update(first, 0)
    assert [(x.k, x.value) for x in job.lists().orderBy("rank").collect()] == [("a", 9), ("b", 5)]
    second = first.where("k = 'a'").withColumn("value", F.lit(0).cast("long")).withColumn("ts", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    job._update(second, 1)
    job._update(second, 1)
    assert [(x.k, x.value) for x in job.lists().orderBy("rank").collect()] == [("b", 5), ("c", 1)]


def test_sampling_fails_open(spark):
    spans = spark.sql("SELECT id % 4 AS t, id AS start, CASE WHEN id % 4 = 3 THEN NULL ELSE 1L END AS duration FROM range(16)")
    kept = {x.t for x in sampling.decisions(spans, "t", sampling.Sampler(threshold=1000)).where("keep").collect()}
    assert kept == {3}

    def broken(rows):
        raise RuntimeError

    assert sampling.chain(spans, "t", [broken]).where("keep AND failures = 1").count() == 4
    # A plugin sees the spans' columns; one that asks for others is bypassed and counted.
    assert sampling.sampled(spans, "t", [lambda rows: rows["start"].max() > 99]).count() == 0
    assert sampling.chain(spans, "t", [lambda rows: rows["nothing"].any()]).where("keep AND failures = 1").count() == 4
    assert sampling.sampled(spans, "t", [sampling.Sampler(rate=1.0), lambda rows: len(rows) > 99]).count() == 0


def _in_small_batches(spark, run):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plugins_take_many_traces_at_once(spark):
    """One pass for all functions of a chain, and no pandas group for each trace."""
    spans = spark.sql("SELECT id % 7 AS t, id FROM range(60)")
    out = sampling.chain(spans, "t", [sampling.Sampler(rate=1.0), lambda rows: len(rows) > 8, lambda rows: rows["id"][0] is not None and rows["t"].max() < 5])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 1
    assert {x.t for x in _in_small_batches(spark, out.where("keep AND failures = 0").collect)} == {0, 1, 2, 3}


def test_chain_decides_on_spans_without_trace_id(spark):
    spans = spark.sql("SELECT CASE WHEN id < 5 THEN id % 2 END AS t, id FROM range(9)")
    out = sampling.chain(spans, "t", [sampling.Sampler(rate=1.0), lambda rows: len(rows) < 4])
    assert {x.t: x.keep for x in _in_small_batches(spark, out.collect)} == {0: True, 1: True, None: False}


def test_plugins_see_each_trace_as_a_grouped_function_does(spark):
    """Values, pandas types and index of a trace do not depend on traces beside it or on batches."""
    odd = "CASE WHEN t IN (1, 4) AND id % 3 = 0 THEN NULL ELSE {} END"
    spans = spark.sql("SELECT id, CASE WHEN id % 2 = 0 THEN 8 WHEN id % 9 = 1 THEN NULL ELSE id % 7 END AS t, timestamp_seconds(id) AS ts FROM range(90)")
    flat = spans.selectExpr("t", "id", f"{odd.format('id + 9007199254740993')} AS big", "CASE WHEN t = 2 THEN NULL ELSE id % 2 = 0 END AS flag", f"{odd.format('double(id)')} AS real", f"{odd.format('string(id)')} AS word", f"date_add({odd.format('date(ts)')}, int(id)) AS day", "ts", "CAST(id AS DECIMAL(20, 2)) AS dec")
    nested = flat.selectExpr("t", "id", "array(big, id) AS list", "named_struct('x', big, 'y', flag) AS pair", "map('k', id) AS table", "array(word) AS words")

    def told(rows):
        rows = rows.sort_values("id")
        return f"{list(rows.columns)} {[str(x) for x in rows.dtypes]} {sorted(rows.index)} {[[(type(v).__name__, str(getattr(v, 'dtype', '')), repr(v)) for v in rows.iloc[:, i]] for i in range(rows.shape[1])]}"

    for df in (flat, nested):
        seen = df.groupBy("t").applyInPandas(lambda rows: pd.DataFrame({"told": [told(rows)]}), "told string")
        want = {x.told for x in seen.collect()}
        assert len(want) == 9
        # Neither a change of the frame nor another function's is seen beside it.
        spoil = lambda rows: rows.insert(0, "new", 1) or rows.__setitem__("id", -1) or True
        for run in (lambda f: f(), lambda f: _in_small_batches(spark, f)):
            got = run(sampling.chain(df, "t", [spoil, lambda rows: told(rows) in want]).collect)
            assert len(got) == 9 and all(x.keep and not x.failures for x in got)


def test_streaming_late_points_and_expiry(spark, tmp_path):
    """Points of buckets that ended before the watermark are dropped, and the state of such buckets."""
    from tidemark.catalog import Ranking
    from tidemark.sources.storage import _names
    from tidemark.streaming.topn import RankingStream

    c = Catalog()
    r = Resource(Kind.MEASURE, "g", "m", (Tag("k"), Tag("grp")), (Field("v"),), ("k",))
    c.add(r, lambda s: None)
    c.add_ranking(Ranking("g", "t", "m", "g", "v", ("grp",), "DESC", counters=2))
    job = RankingStream(spark, c, "g", "t", f"file://{tmp_path}")

    def batch(minute, k, v):
        return spark.sql(f"SELECT timestamp '2024-01-01 00:{minute:02}:00' AS bucket, 'x' AS group_key, 'x' AS grp, '{k}' AS k, {v}L AS value, timestamp '2024-01-01 00:{minute:02}:05' AS ts, 1L AS version")

    job._update(batch(0, "a", 1), 0)
    job._update(batch(30, "b", 2), 1)
    assert job.watermark(2).minute == 28 and job.watermark(1).minute == 58
    job._update(batch(0, "c", 3), 2)  # late: its bucket ended at 00:01
    job._update(batch(28, "d", 4), 3)  # not late: its bucket ends at 00:29
    assert sorted((x.k, x.value) for x in job.lists().collect()) == [("a", 1), ("b", 2), ("d", 4)]
    left = [b for n in _names(spark, f"{job.root}/state") for b in _names(spark, f"{job.root}/state/{n}") if b.startswith("_b=")]
    assert len(left) == 2 and job.watermark(4).minute == 28


def test_times_reach_the_scan(spark, sf):
    """Segment bounds of traces, and the range of a ranking, are constants that Parquet tests."""
    from tidemark.bindings import catalog

    e = Engine(spark, catalog(sf))
    for text, column in (("SELECT duration FROM TRACE orders IN shop TIME BETWEEN '1996-01-01T10:00:00Z' AND '1996-01-31T10:00:00Z' ORDER BY duration DESC", "o_orderdate"), ("SHOW TOP 3 FROM MEASURE user_top IN ev TIME BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-20T00:00:00Z' ORDER BY DESC", "ts")):
        plan = e.query(text)._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual({column}" in plan and f"LessThanOrEqual({column}" in plan


def test_creation_clamps_all_groups(spark):
    """The range begins when the last of the groups' resources was created, for traces too."""
    c = Catalog()
    for g, created in (("g", None), ("h", datetime(2024, 1, 3, tzinfo=timezone.utc))):
        for kind, ids in ((Kind.TRACE, {"trace_id": "t", "span_id": "s", "unique": True}), (Kind.STREAM, {"element_id": "s", "unique": True})):
            c.add(Resource(kind, g, "x", (Tag("t"), Tag("n", Type.INT)), rules=(IndexRule("n", ("n",)),), created=created, **ids), lambda spark, g=g: spark.sql(f"SELECT concat('{g}', id) AS t, concat('{g}', id) AS s, id AS n, timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id AS int)) AS ts FROM range(5)"))
    e = Engine(spark, c)
    begin = "TIME BETWEEN '2024-01-01T00:00:00Z' AND '2024-02-01T00:00:00Z'"
    assert e.query(f"SELECT n FROM STREAM x IN (g, h) {begin}").count() == 6
    assert e.query(f"SELECT n FROM TRACE x IN (g, h) {begin} ORDER BY n DESC").count() == 6
    assert e.query(f"SELECT n FROM TRACE x IN g {begin} ORDER BY n DESC").count() == 5


def test_limits_beyond_31_bits(spark, sf):
    from tidemark.bindings import catalog

    with pytest.raises(RequestError):
        Engine(spark, catalog(sf)).query("SELECT user_id FROM STREAM events IN log LIMIT 4294967294")


def test_finalize_samples_traces(spark, tmp_path):
    r = Resource(Kind.TRACE, "g", "t", (Tag("n", Type.INT),), trace_id="t", span_id="s")
    df = spark.sql("SELECT concat('t', id % 3) AS t, id % 9 AS s, id AS n, timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 3 AS int)) AS ts FROM range(18)")
    s = Store(f"file://{tmp_path}/hot")
    s.append(df, r)
    assert s.finalize(spark, r, [lambda rows: rows["n"].min() > 0], date(2024, 1, 3), grace_days=0) == [date(2024, 1, 1), date(2024, 1, 2)]
    # Day 1 holds t0, which goes; day 2 t1, whose spans had two copies each; day 3 is not finalized.
    assert sorted(x.n for x in s.read(spark, r).collect()) == [1, 2, 4, 5, 7, 8, 11, 14, 17]
