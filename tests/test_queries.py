"""Every catalogue query against its SQL."""

import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

from .helpers import rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_type", "value"]
    assert set(QUERIES) <= set(e.queries()) and set(ORACLE_SQL) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", ["P5_hidden_tags", "D9_group_by_entity", "F1_version_dedup", "A16_series_search", "G1_missing_tags", "G2_stream_groups", "P28_stages", "P28_default_stage", "A1_measure_scan", "F3_element_dedup", "P6_eq"])
def test_no_limit_where_the_sql_has_none(name, spark, sf):
    assert "LIMIT" not in ORACLE_SQL[name].upper()
    assert "Limit" not in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_chain_query_drops_orders_without_a_customer(spark, sf, tmp_path):
    import duckdb

    spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey", "nullif(o_custkey % 50, 7) AS o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert len(want := con.sql(ORACLE_SQL["U3_chain"]).df()) > 0
    assert rows(QUERIES["U3_chain"](spark, str(tmp_path)).toPandas()) == rows(want)


def test_plugin_query_decides_on_batches_of_traces(spark, sf, tmp_path):
    """Also with orders without a customer or a price, and with customers whose orders span batches."""
    import duckdb

    spark.read.parquet(f"{sf}/orders.parquet").selectExpr("nullif(o_custkey % 90, 7) AS o_custkey", "CASE WHEN o_custkey % 90 <> 8 AND o_orderkey % 11 > 0 THEN o_totalprice END AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {x[0] for x in con.sql(ORACLE_SQL["U2_plugin"]).fetchall()}
    got = QUERIES["U2_plugin"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        found = [x.o_custkey for x in got.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == want and len(found) == len(want) and 0 < len(want) < 90
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_without_the_training_data_package(tmp_path):
    """The rest of a copy without the two llm folders and the pipeline imports and lists its queries."""
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(here / "tidemark", copy / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for f in ("__spark_entry__.py", *(["corpus_pipeline.py"] if keep_pipeline else [])):
            shutil.copy(here / f, copy / f)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(q) == set(o) and 'entry_top_sum' in q and 'pipeline' not in q"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
