"""The query catalogue: each operator once, with the SQL that gives the same rows.

Keys begin with the operator's number.  Texts in the query language run through the engine; rows
are compared without order, so every limit has a total order behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import catalog
from .catalog import Field, Kind, Type
from .functions.aggregates import aggregate, mean
from .model import MeasureQuery
from .operators import dedup, measure, property, sampling, topn, trace
from .plans.engine import Engine
from .sources.storage import unexpired

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPAN = "TIME BETWEEN '2024-01-05T00:00:00Z' AND '2024-01-20T00:00:00Z'"
ALL = "TIME BETWEEN '1990-01-01T00:00:00Z' AND '2030-01-01T00:00:00Z'"
SPAN_SQL = "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
#: Points after version dedup, as the measure's rows.
EVENT_SQL = "(SELECT *, nullif(event_type, 'error') AS kind, CAST(trunc(value) AS BIGINT) AS amount FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1)"
ELEMENT_SQL = "(SELECT *, nullif(event_type, 'error') AS kind, CAST(trunc(value) AS BIGINT) AS amount FROM events)"
ORDER_SQL = "(SELECT *, CAST(trunc(o_totalprice) AS BIGINT) AS duration FROM orders)"


def engine(spark: SparkSession, sf_dir: str, strict: bool = False) -> Engine:
    return Engine(spark, catalog(sf_dir), strict)


def _ql(key: str, text: str, columns: str, sql: str, params: tuple = ()) -> None:
    QUERIES[key] = lambda spark, d: engine(spark, d).query(text, params).selectExpr(*columns.split("; "))
    ORACLE_SQL[key] = sql


def _fn(key: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _events(key: str, where: str, sql: str) -> None:
    """A predicate on the event stream: the ids that pass."""
    _ql(key, f"SELECT event_type FROM STREAM events IN log WHERE {where} LIMIT 4294967295", "event_id", f"SELECT event_id FROM {ELEMENT_SQL} WHERE {sql}")


def _docs(key: str, where: str, sql: str) -> None:
    _ql(key, f"SELECT lang FROM STREAM documents IN docs WHERE {where} LIMIT 4294967295", "doc_id", f"SELECT doc_id FROM documents WHERE {sql}")


def _agg(key: str, function: str, field: str, sql: str, show: str = "{}") -> None:
    _ql(key, f"SELECT event_type, {field}::field, {function}({field}) FROM MEASURE event_value IN ev {SPAN} GROUP BY event_type, {field}", f"event_type; {show.format(field)} AS {field}", f"SELECT event_type, {sql} AS {field} FROM {EVENT_SQL} WHERE {SPAN_SQL} GROUP BY event_type")


# --- scans ------------------------------------------------------------------------------------
_ql("entry_top_sum", f"SELECT TOP 5 value DESC, event_type, value::field, SUM(value) FROM MEASURE event_value IN ev {SPAN} WHERE event_type IN ('click', 'view') GROUP BY event_type, value", "event_type; round(value, 2) AS value", f"SELECT event_type, round(sum(value), 2) AS value FROM {EVENT_SQL} WHERE {SPAN_SQL} AND event_type IN ('click', 'view') GROUP BY 1 ORDER BY sum(value) DESC LIMIT 5")
_ql("A1_measure_scan", "SELECT l_orderkey, l_linenumber, l_returnflag, quantity::field FROM MEASURE lineitem IN tpch TIME BETWEEN '1996-01-01T00:00:00Z' AND '1996-03-31T00:00:00Z' LIMIT 4294967295", "l_orderkey; l_linenumber; l_returnflag; quantity", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, l_quantity AS quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31'")
_ql("A2_measure_scan_filtered", f"SELECT l_orderkey, l_linenumber, extendedprice::field FROM MEASURE lineitem IN tpch {ALL} WHERE l_returnflag = 'R' AND l_suppkey < 20 LIMIT 4294967295", "l_orderkey; l_linenumber; extendedprice", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice AS extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey < 20")
_ql("A3_measure_versions", f"SELECT l_suppkey, quantity::field FROM MEASURE supply IN tpch {ALL} LIMIT 4294967295", "l_suppkey; version; quantity", "SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS version, l_quantity AS quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 8 + l_linenumber DESC) = 1")
_ql("A4_index_mode", "SELECT n_nationkey, n_name FROM MEASURE nation IN geo WHERE n_regionkey = 1 ORDER BY name", "n_nationkey; n_name", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
_ql("A5_stream_time_scan", f"SELECT event_type FROM STREAM events IN log {SPAN} ORDER BY TIME DESC LIMIT 50", "event_id; event_type", f"SELECT event_id, event_type FROM events WHERE {SPAN_SQL} ORDER BY ts DESC, event_id LIMIT 50")
_ql("A6_stream_index_scan", f"SELECT amount FROM STREAM events IN log {SPAN} ORDER BY amount DESC LIMIT 40", "event_id; amount", f"SELECT event_id, amount FROM {ELEMENT_SQL} WHERE {SPAN_SQL} ORDER BY amount DESC, event_id LIMIT 40")
_ql("A7_stream_default_limit", f"SELECT user_id FROM STREAM events IN log {SPAN}", "event_id; user_id", f"SELECT event_id, user_id FROM events WHERE {SPAN_SQL} ORDER BY ts, event_id LIMIT 20")
_ql("A9_trace_by_id", "SELECT duration, state FROM TRACE orders IN shop WHERE o_custkey IN (1, 2, 5, 7, 100)", "o_custkey; o_orderkey; duration; state", f"SELECT o_custkey, o_orderkey, duration, o_orderstatus AS state FROM {ORDER_SQL} WHERE o_custkey IN (1, 2, 5, 7, 100)")
_ql("A10_trace_ordered", "SELECT duration FROM TRACE orders IN shop ORDER BY duration DESC LIMIT 10", "o_custkey; o_orderkey; duration", f"WITH t AS (SELECT o_custkey FROM {ORDER_SQL} GROUP BY 1 ORDER BY max(duration) DESC, o_custkey LIMIT 10) SELECT o_custkey, o_orderkey, duration FROM {ORDER_SQL} JOIN t USING (o_custkey)")
_ql("A11_trace_key_range", "SELECT duration FROM TRACE orders IN shop WHERE duration >= 100000 AND duration < 200000 ORDER BY duration ASC LIMIT 15", "o_custkey; o_orderkey; duration", f"WITH t AS (SELECT o_custkey FROM {ORDER_SQL} WHERE duration >= 100000 AND duration < 200000 GROUP BY 1 ORDER BY min(duration), o_custkey LIMIT 15) SELECT o_custkey, o_orderkey, duration FROM {ORDER_SQL} JOIN t USING (o_custkey)")
_ql("A13_trace_missing_tags", "SELECT fresh, duration FROM TRACE orders IN (shop, shop_new) WHERE o_custkey IN (1, 10000001)", "o_custkey; o_orderkey; fresh; duration", f"SELECT o_custkey, o_orderkey, CAST(NULL AS VARCHAR) AS fresh, duration FROM {ORDER_SQL} WHERE o_custkey = 1 UNION ALL SELECT o_custkey + 10000000, o_orderkey, 'new', duration FROM {ORDER_SQL} WHERE o_custkey = 1")
PROPERTY_SQL = "(WITH b AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label, c_mktsegment AS segment, CAST(trunc(c_acctbal) AS BIGINT) AS balance, c_custkey AS number FROM customer), r AS (SELECT *, 1 AS rev FROM b UNION ALL SELECT id, label, segment, balance + 1000, number, 2 FROM b WHERE number % 3 = 0 UNION ALL SELECT *, 3 FROM b WHERE number % 7 = 0) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY rev DESC) = 1 AND rev < 3)"
_ql("A15_property_search", "SELECT label, balance FROM PROPERTY customer IN crm WHERE segment = 'BUILDING' LIMIT 4294967295", "id; label; balance", f"SELECT id, label, balance FROM {PROPERTY_SQL} WHERE segment = 'BUILDING'")
_ql("A16_series_search", f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN ev {SPAN} WHERE user_id = 3 AND event_type IN ('click', 'view') LIMIT 4294967295", "user_id; event_type; value", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE {SPAN_SQL} AND user_id = 3 AND event_type IN ('click', 'view')")


@_fn("A14_topn_lists", f"WITH v AS (SELECT date_trunc('day', ts) AS d, event_type, user_id, amount FROM {EVENT_SQL} QUALIFY row_number() OVER (PARTITION BY d, event_type, user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT strftime(d, '%Y-%m-%d') AS day, event_type, user_id, amount AS value FROM v QUALIFY row_number() OVER (PARTITION BY d, event_type ORDER BY amount DESC, user_id) <= 20")
def _a14(spark: SparkSession, d: str) -> DataFrame:
    return topn.lists(spark, catalog(d), "ev", "user_top").select(F.to_date("bucket").cast("string").alias("day"), "event_type", "user_id", "value")


@_fn("A20_property_merge", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS label, 'GOLD' AS segment FROM customer")
def _a20(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    r = c.get(Kind.PROPERTY, "crm", "customer")
    log = c.frame(spark, r)
    changes = log.where("mod_revision = 1").select("group", "name", "id", F.lit(9).cast("long").alias("mod_revision"), F.lit(None).cast("string").alias("label"), F.lit("GOLD").alias("segment"), F.lit(None).cast("long").alias("balance"), F.lit(None).cast("long").alias("number"))
    log = log.unionByName(property.apply(log, changes, r))
    return dedup.revisions(log).where("segment = 'GOLD'").select("id", "label", "segment")


@_fn("A21_property_delete", f"SELECT count(*) AS n FROM {PROPERTY_SQL} WHERE segment <> 'BUILDING'")
def _a21(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    log = c.frame(spark, c.get(Kind.PROPERTY, "crm", "customer"))
    ids = dedup.revisions(log).where("segment = 'BUILDING'").select("id")
    gone = property.delete(log, "customer", ids, 9, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return dedup.revisions(log.unionByName(gone)).agg(F.count(F.lit(1)).alias("n"))


@_fn("A22_ttl", "SELECT event_id FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def _a22(spark: SparkSession, d: str) -> DataFrame:
    return unexpired(spark.read.parquet(f"{d}/events.parquet"), 7, F.lit("2024-01-31").cast("date")).select("event_id")


# --- predicates -------------------------------------------------------------------------------
_ql("P1_tag_projection", "SELECT event_type, user_id FROM STREAM events IN log LIMIT 30", "event_id; event_type; user_id", "SELECT event_id, event_type, user_id FROM events ORDER BY ts, event_id LIMIT 30")
_ql("P3_star", f"SELECT * FROM MEASURE event_value IN ev {SPAN} LIMIT 25", "user_id; event_type; kind; value; amount; version", f"SELECT user_id, event_type, kind, value, amount, event_id AS version FROM {EVENT_SQL} WHERE {SPAN_SQL} ORDER BY ts, user_id, event_type LIMIT 25")
_ql("P5_hidden_tags", "SELECT user_id FROM STREAM events IN log WHERE event_type = 'purchase' AND amount > 100 LIMIT 4294967295", "event_id; user_id", f"SELECT event_id, user_id FROM {ELEMENT_SQL} WHERE event_type = 'purchase' AND amount > 100")
_events("P6_eq", "event_type = 'click'", "event_type = 'click'")
_events("P6_eq_null", "kind = NULL", "false")
_events("P7_ne_null", "kind != 'click'", "NOT coalesce(kind = 'click', false)")
_events("P8_range_int", "amount >= 100 AND amount < 120", "amount >= 100 AND amount < 120")
_events("P8_range_string", "kind > 'click' AND kind <= 'signup'", "coalesce(kind > 'click' AND kind <= 'signup', false)")
_events("P9_in", "kind IN ('click', 'view')", "coalesce(kind IN ('click', 'view'), false)")
_events("P9_not_in", "kind NOT IN ('click', 'view')", "NOT coalesce(kind IN ('click', 'view'), false)")
_docs("P10_having", "words HAVING ('the', 'of')", "list_has_all(string_split(text, ' '), ['the', 'of'])")
_docs("P10_not_having", "words NOT HAVING ('the', 'of')", "NOT list_has_all(string_split(text, ' '), ['the', 'of'])")
_docs("P10_having_scalar", "source HAVING 'src3'", "source = 'src3'")
_TOKENS = "string_split_regex(lower(text), '[^\\p{L}]+')"
_docs("P11_match_and", "text MATCH(('the', 'thing'), 'simple', 'AND')", f"list_contains({_TOKENS}, 'the') AND list_contains({_TOKENS}, 'thing')")
_docs("P11_match_or", "text MATCH(('thing', 'licensed'), 'simple', 'OR')", f"list_has_any({_TOKENS}, ['thing', 'licensed'])")
_docs("P11_match_phrase", "text MATCH('licensed under the')", f"list_has_all({_TOKENS}, ['licensed', 'under', 'the'])")
_docs("P11_match_standard", "text MATCH('4', 'standard')", "list_contains(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), '4')")
_docs("P11_match_url", "text MATCH('License', 'url')", "list_contains(string_split_regex(text, '[^\\p{L}\\p{N}]+'), 'License')")
_docs("P11_match_keyword", "source MATCH('src5', 'keyword')", "source = 'src5'")
_events("P12_tree", "(event_type = 'click' OR event_type = 'view') AND (amount < 50 OR user_id = 7) OR amount > 480", "(event_type = 'click' OR event_type = 'view') AND (amount < 50 OR user_id = 7) OR amount > 480")
_ql("P13_time_inclusive", "SELECT user_id FROM STREAM events IN log TIME <= '2024-01-03T12:00:00Z' LIMIT 4294967295", "event_id", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-03 12:00:00'")
_ql("P14_entity_contradiction", f"SELECT user_id, value::field FROM MEASURE event_value IN ev {SPAN} WHERE event_type = 'click' AND event_type = 'view'", "user_id; value", "SELECT user_id, value FROM events WHERE false")
_ql("P20_trace_any_span", "SELECT state FROM TRACE orders IN shop WHERE state = 'P' ORDER BY duration DESC LIMIT 12", "o_custkey; o_orderkey; state", f"WITH t AS (SELECT o_custkey FROM {ORDER_SQL} WHERE o_orderstatus = 'P' GROUP BY 1 ORDER BY max(duration) DESC, o_custkey LIMIT 12) SELECT o_custkey, o_orderkey, o_orderstatus AS state FROM orders JOIN t USING (o_custkey)")
_ql("P21_trace_id_and_tag", "SELECT duration FROM TRACE orders IN shop WHERE o_custkey IN (1, 2, 4, 5, 7) AND duration > 200000", "o_custkey; o_orderkey", f"SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM {ORDER_SQL} WHERE o_custkey IN (1, 2, 4, 5, 7) AND duration > 200000)")
_ql("P26_property_ids", "SELECT label FROM PROPERTY customer IN crm WHERE id IN ('3', '7', '12', '500') AND balance > 0", "id; label", f"SELECT id, label FROM {PROPERTY_SQL} WHERE id IN ('3', '7', '12', '500') AND balance > 0")
_ql("P28_stages", f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN staged ON (hot, cold) STAGES {ALL} WHERE user_id = 5 LIMIT 4294967295", "user_id; event_type; value", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE user_id = 5")
_ql("P28_default_stage", f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN staged {ALL} WHERE user_id = 5 LIMIT 4294967295", "user_id; event_type; value", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE user_id = 5 AND ts >= TIMESTAMP '2024-01-20'")

# --- aggregates -------------------------------------------------------------------------------
_agg("D1_sum_int", "SUM", "amount", "CAST(sum(amount) AS BIGINT)")
_agg("D1_sum_float", "SUM", "value", "round(sum(value), 2)", "round({}, 2)")
_agg("D2_count_int", "COUNT", "amount", "count(amount)")
_agg("D2_count_float", "COUNT", "value", "CAST(count(value) AS DOUBLE)")
_agg("D3_max", "MAX", "value", "max(value)")
_agg("D4_min", "MIN", "value", "min(value)")
_agg("D5_mean_int", "MEAN", "amount", "CASE WHEN count(amount) = 0 THEN 0 ELSE greatest(1, CAST(sum(amount) // count(amount) AS BIGINT)) END")
_agg("D5_mean_float", "AVG", "value", "round(greatest(1, avg(value)), 4)", "round({}, 4)")
_ql("D5_mean_floor", f"SELECT l_returnflag, discount::field, MEAN(discount) FROM MEASURE lineitem IN tpch {ALL} GROUP BY l_returnflag, discount", "l_returnflag; discount", "SELECT l_returnflag, greatest(1.0::DOUBLE, avg(l_discount)) AS discount FROM lineitem GROUP BY 1")
_ql("D6_scalar", f"SELECT SUM(quantity_i) FROM MEASURE lineitem IN tpch {ALL}", "quantity_i", "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity_i FROM lineitem")
_ql("D6_scalar_empty", "SELECT SUM(quantity_i) FROM MEASURE lineitem IN tpch TIME BETWEEN '1980-01-01T00:00:00Z' AND '1981-01-01T00:00:00Z'", "quantity_i", "SELECT CAST(0 AS BIGINT) AS quantity_i WHERE false")
_ql("D7_group_two_keys", f"SELECT l_returnflag, l_linestatus, extendedprice::field, SUM(extendedprice) FROM MEASURE lineitem IN tpch {ALL} GROUP BY l_returnflag, l_linestatus, extendedprice", "l_returnflag; l_linestatus; round(extendedprice, 1) AS extendedprice", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 1) AS extendedprice FROM lineitem GROUP BY 1, 2")
_ql("D9_group_by_entity", f"SELECT user_id, event_type, amount::field, MAX(amount) FROM MEASURE event_value IN ev {SPAN} GROUP BY user_id, event_type, amount LIMIT 4294967295", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} GROUP BY 1, 2")
_ql("D10_raw_group", f"SELECT event_type FROM MEASURE event_value IN ev {SPAN} GROUP BY event_type", "event_type; version", f"SELECT event_type, event_id AS version FROM {EVENT_SQL} WHERE {SPAN_SQL} QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, user_id) = 1")
_ql("D14_first_seen_tags", f"SELECT event_type, user_id, amount::field, SUM(amount) FROM MEASURE event_value IN ev {SPAN} GROUP BY event_type, amount", "event_type; user_id; amount", f"SELECT event_type, arg_min(user_id, (ts, user_id)) AS user_id, CAST(sum(amount) AS BIGINT) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} GROUP BY 1")
_ql("D15_null_group", f"SELECT kind, amount::field, COUNT(amount) FROM MEASURE event_value IN ev {SPAN} GROUP BY kind, amount", "kind; amount", f"SELECT kind, count(amount) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} GROUP BY 1")


@_fn("D11_partial_final", f"SELECT event_type, CASE WHEN count(amount) = 0 THEN 0 ELSE greatest(1, CAST(sum(amount) // count(amount) AS BIGINT)) END AS amount FROM {EVENT_SQL} GROUP BY 1")
def _d11(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    from .functions.timeparse import time_range

    begin, end = time_range("BETWEEN", "1990-01-01T00:00:00Z", "2030-01-01T00:00:00Z")
    q = MeasureQuery(("ev",), "event_value", begin, end, group_by=("event_type",), aggregate=("MEAN", "amount"))
    parts = measure.partials(spark, c, q, shards=4)
    # A replica sends each shard's partials again.
    return measure.reduced(parts.unionByName(parts), "MEAN", Field("amount", Type.INT), ["event_type"])


@_fn("D3_strict_max_of_nulls", "SELECT event_type, CASE WHEN event_type = 'error' THEN CAST(-9223372036854775808 AS BIGINT) ELSE max(CAST(trunc(value) AS BIGINT)) END AS amount FROM events GROUP BY 1")
def _d3(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type", "CASE WHEN event_type <> 'error' THEN cast(value AS bigint) END AS amount")
    return df.groupBy("event_type").agg(aggregate("MAX", Field("amount", Type.INT), strict=True).alias("amount"))


@_fn("D5_mean_truncates", "SELECT user_id, event_type, greatest(1, CAST(trunc(CAST(sum(x) AS DOUBLE) / count(x)) AS BIGINT)) AS m FROM (SELECT user_id, event_type, CAST(trunc(value) AS BIGINT) - 250 AS x FROM events) GROUP BY 1, 2")
def _d5(spark: SparkSession, d: str) -> DataFrame:
    """Means of values on both sides of 0 truncate toward 0, and are at least 1."""
    df = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id", "event_type", "cast(value AS bigint) - 250 AS x")
    return df.groupBy("user_id", "event_type").agg(mean(F.sum("x"), F.count("x"), Type.INT).alias("m"))


# --- dedup, order, limits ---------------------------------------------------------------------
_ql("F1_version_dedup", f"SELECT l_suppkey, quantity_i::field, SUM(quantity_i) FROM MEASURE supply IN tpch {ALL} GROUP BY l_suppkey, quantity_i LIMIT 4294967295", "l_suppkey; quantity_i", "SELECT l_suppkey, CAST(sum(q) AS BIGINT) AS quantity_i FROM (SELECT l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey * 8 + l_linenumber DESC) = 1) GROUP BY 1")
_ql("F3_element_dedup", "SELECT user_id FROM STREAM events IN log_copy LIMIT 4294967295", "event_id; user_id", "SELECT event_id, user_id FROM events")
_ql("F5_property_latest", "SELECT balance FROM PROPERTY customer IN crm ORDER BY balance DESC LIMIT 30", "balance", f"SELECT balance FROM {PROPERTY_SQL} ORDER BY balance DESC LIMIT 30")
_ql("F7_order_time", f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN ev {SPAN} ORDER BY TIME DESC LIMIT 40", "user_id; event_type; value", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE {SPAN_SQL} ORDER BY ts DESC, user_id, event_type LIMIT 40")
_ql("F8_order_tag", f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN ev {SPAN} ORDER BY kind ASC LIMIT 40", "user_id; event_type; value", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE {SPAN_SQL} ORDER BY kind ASC NULLS FIRST, ts, user_id, event_type LIMIT 40")
_ql("F14_trace_default_order", "SELECT duration FROM TRACE orders IN shop WHERE o_custkey IN (10, 4, 7, 2, 8) LIMIT 3", "o_custkey; o_orderkey", "WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IN (10, 4, 7, 2, 8) ORDER BY 1 LIMIT 3) SELECT o_custkey, o_orderkey FROM orders JOIN t USING (o_custkey)")
_ql("F15_top", f"SELECT TOP 15 extendedprice DESC, l_orderkey, l_linenumber FROM MEASURE lineitem IN tpch {ALL}", "l_orderkey; l_linenumber; extendedprice", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice AS extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber LIMIT 15")
_ql("F15_bottom", f"SELECT TOP 15 extendedprice, l_orderkey, l_linenumber FROM MEASURE lineitem IN tpch {ALL}", "l_orderkey; l_linenumber; extendedprice", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice AS extendedprice FROM lineitem ORDER BY l_extendedprice, l_shipdate, l_orderkey, l_linenumber LIMIT 15")
_ql("F17_top_after_group", f"SELECT TOP 3 amount DESC, event_type, amount::field, MEAN(amount) FROM MEASURE event_value IN ev {SPAN} WHERE event_type != 'error' GROUP BY event_type, amount LIMIT 2", "event_type; amount", f"SELECT event_type, greatest(1, CAST(sum(amount) // count(amount) AS BIGINT)) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} AND event_type <> 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
_ql("F18_offset_limit", f"SELECT user_id, event_type FROM MEASURE event_value IN ev {SPAN} LIMIT 10 OFFSET 35", "user_id; event_type; version", f"SELECT user_id, event_type, event_id AS version FROM {EVENT_SQL} WHERE {SPAN_SQL} ORDER BY ts, user_id, event_type LIMIT 10 OFFSET 35")
_ql("F19_stream_offset", "SELECT user_id FROM STREAM events IN log LIMIT 10 OFFSET 15", "event_id", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 10 OFFSET 15")
_ql("F20_trace_offset", "SELECT duration FROM TRACE orders IN shop ORDER BY duration ASC LIMIT 5 OFFSET 5", "o_custkey; o_orderkey", f"WITH t AS (SELECT o_custkey FROM {ORDER_SQL} GROUP BY 1 ORDER BY min(duration), o_custkey LIMIT 5 OFFSET 5) SELECT o_custkey, o_orderkey FROM orders JOIN t USING (o_custkey)")

# --- several groups ---------------------------------------------------------------------------
_ql("G1_multi_group", f"SELECT event_type, amount::field, SUM(amount) FROM MEASURE event_value IN (ev, ev_old) {ALL} GROUP BY event_type, amount", "event_type; amount", f"SELECT event_type, CAST(2 * sum(amount) AS BIGINT) AS amount FROM {EVENT_SQL} GROUP BY 1")
_ql("G1_missing_tags", f"SELECT user_id, event_type, kind, extra FROM MEASURE event_value IN (ev, ev_old) {ALL} WHERE user_id = 3 LIMIT 4294967295", "user_id; event_type; kind; extra", f"SELECT user_id, event_type, kind, CAST(NULL AS VARCHAR) AS extra FROM {EVENT_SQL} WHERE user_id = 3 UNION ALL SELECT user_id, event_type, NULL, 'x3' FROM {EVENT_SQL} WHERE user_id = 3")
_ql("G2_stream_groups", "SELECT user_id FROM STREAM events IN (log, log_copy) WHERE user_id = 70 LIMIT 4294967295", "event_id; user_id", "SELECT event_id, user_id FROM events WHERE user_id = 70")
_ql("G3_trace_type_conflict", "SELECT state FROM TRACE orders IN (shop, shop_new) WHERE o_custkey IN (1, 10000001)", "o_orderkey; state", "SELECT o_orderkey, o_orderstatus AS state FROM orders WHERE o_custkey = 1 UNION ALL SELECT o_orderkey, CAST(ascii(o_orderstatus) AS VARCHAR) FROM orders WHERE o_custkey = 1")

# --- joins inside, sampling -------------------------------------------------------------------
_ql("C3_trace_spans", "SELECT role FROM TRACE conversations IN chat ORDER BY turn DESC LIMIT 8", "conv_id; turn; role; span", "WITH t AS (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 8) SELECT conv_id, turn, role, text AS span FROM conversations JOIN t USING (conv_id)")


@_fn("C5_span_merge", "SELECT conv_id, count(DISTINCT turn) AS spans FROM conversations GROUP BY 1")
def _c5(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/conversations.parquet")
    both = c.unionByName(c).dropDuplicates(["conv_id", "turn"])
    return trace.assembled(both, "conv_id", "turn").select("conv_id", F.size("spans").cast("long").alias("spans"))


SAMPLER_SQL = "(SELECT o_custkey FROM orders GROUP BY 1 HAVING max(epoch(o_orderdate) + o_totalprice::BIGINT) - min(epoch(o_orderdate)) >= 150000000 OR bool_or(o_orderstatus = 'P'))"


def _sampler() -> sampling.Sampler:
    return sampling.Sampler(threshold=150_000_000, error="o_orderstatus = 'P'")


def _order_spans(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").withColumn("start", F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).withColumn("duration", F.round("o_totalprice").cast("long"))


@_fn("U4_sampler", f"SELECT o_custkey FROM {SAMPLER_SQL}")
def _u4(spark: SparkSession, d: str) -> DataFrame:
    return sampling.decisions(_order_spans(spark, d), "o_custkey", _sampler()).where("keep").select("o_custkey")


@_fn("U4_tag_rules", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' OR regexp_matches(o_orderstatus, '^P')")
def _u4b(spark: SparkSession, d: str) -> DataFrame:
    s = sampling.Sampler(rules=(sampling.TagRule("o_orderpriority", "equals", "1-URGENT"), sampling.TagRule("o_orderstatus", "regex", "^P")))
    return sampling.decisions(_order_spans(spark, d), "o_custkey", s).where("keep").select("o_custkey")


@_fn("U3_chain", f"SELECT o_custkey FROM {SAMPLER_SQL} JOIN orders USING (o_custkey) GROUP BY 1 HAVING count(*) >= 5")
def _u3(spark: SparkSession, d: str) -> DataFrame:
    links = [_sampler(), lambda spans: len(spans) >= 5]
    # As in SQL, whose join drops orders without a customer.
    return sampling.chain(_order_spans(spark, d), "o_custkey", links).where("keep AND o_custkey IS NOT NULL").select("o_custkey")


@_fn("C6_dropped_traces", f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM {SAMPLER_SQL})")
def _c6(spark: SparkSession, d: str) -> DataFrame:
    spans = _order_spans(spark, d)
    dropped = sampling.decisions(spans, "o_custkey", _sampler()).where("NOT keep")
    return trace.without(spans, dropped, "o_custkey").select("o_orderkey")


# --- rankings ---------------------------------------------------------------------------------
def _lists_sql(where: str = "true", by: str = "event_type", desc: str = "DESC") -> str:
    keys = "d, " + by if by else "d"
    return f"(WITH v AS (SELECT date_trunc('day', ts) AS d, user_id, event_type, amount FROM {EVENT_SQL} WHERE {where} QUALIFY row_number() OVER (PARTITION BY d, user_id, event_type ORDER BY ts DESC, event_id DESC) = 1) SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY amount {desc}, user_id, event_type) <= 20)"


_RANGE = "d BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
_ql("I14_topn_query", f"SHOW TOP 10 FROM MEASURE user_top IN ev {SPAN} ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
_ql("I14_topn_condition", f"SHOW TOP 7 FROM MEASURE user_top IN ev {SPAN} WHERE event_type = 'click' ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} AND event_type = 'click' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 7")
_ql("I10_bottom_n", f"SHOW TOP 10 FROM MEASURE user_both IN ev {SPAN} ORDER BY ASC", "user_id; event_type; amount", f"SELECT user_id, event_type, min(amount) AS amount FROM {_lists_sql(by='', desc='ASC')} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 10")
_ql("D18_topn_count", f"SHOW TOP 5 FROM MEASURE user_top IN ev {SPAN} AGGREGATE BY COUNT ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, CAST(1 AS BIGINT) AS amount FROM (SELECT user_id, event_type, max(amount) AS a FROM {_lists_sql()} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5)")
_ql("D18_topn_sum", f"SHOW TOP 5 FROM MEASURE user_top IN ev {SPAN} AGGREGATE BY SUM ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 5")
_ql("P25_topn_criteria", f"SHOW TOP 6 FROM MEASURE buyers IN ev {SPAN} ORDER BY DESC", "user_id; event_type; amount", f"""SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql(where="event_type = 'purchase'", by='')} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 6""")
_ql("P25_topn_not_in", f"SHOW TOP 6 FROM MEASURE others IN ev {SPAN} ORDER BY ASC", "user_id; event_type; amount", f"""SELECT user_id, event_type, min(amount) AS amount FROM {_lists_sql(where="event_type NOT IN ('click', 'view')", desc='ASC')} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3, 1, 2 LIMIT 6""")


@_fn("I14_topn_per_bucket", f"SELECT strftime(d, '%Y-%m-%d') AS day, user_id, event_type, amount FROM {_lists_sql()} QUALIFY row_number() OVER (PARTITION BY d ORDER BY amount DESC, user_id, event_type) <= 3")
def _i14(spark: SparkSession, d: str) -> DataFrame:
    from .model import TopNQuery

    out = topn.run(spark, catalog(d), TopNQuery(("ev",), "user_top", n=3, desc=True), per_bucket=True)
    return out.select(F.to_date("bucket").cast("string").alias("day"), "user_id", "event_type", "amount")


@_fn("I8_topn_streaming", f"SELECT strftime(d, '%Y-%m-%d') AS day, event_type, user_id, amount AS value FROM {_lists_sql()}")
def _i8(spark: SparkSession, d: str) -> DataFrame:
    """The streaming form over the events as a stream of files, run to its end."""
    import uuid

    from .sources.storage import shared_root
    from .streaming.topn import RankingStream

    job = RankingStream(spark, catalog(d), "ev", "user_top", f"{shared_root(spark)}/ranking-{uuid.uuid4().hex}")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    points = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").selectExpr("user_id", "event_type", "nullif(event_type, 'error') AS kind", "value", "cast(value AS bigint) AS amount", "cast(ts AS timestamp) AS ts", "event_id AS version")
    job.start(points, availableNow=True).awaitTermination()
    return job.lists().select(F.to_date("bucket").cast("string").alias("day"), "event_type", "user_id", "value")


# --- language ---------------------------------------------------------------------------------
_ql("L1_parameters", "SELECT user_id FROM STREAM events IN log TIME BETWEEN ? AND ? WHERE event_type IN (?) AND amount > ? LIMIT ?", "event_id; user_id", f"SELECT event_id, user_id FROM {ELEMENT_SQL} WHERE {SPAN_SQL} AND event_type IN ('click', 'view', 'signup') AND amount > 250 ORDER BY ts, event_id LIMIT 500", ("2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z", ["click", "view", "signup"], 250, 500))
_ql("L2_keyword_case", f"select event_type, amount::field, sum(amount) from measure event_value in ev {SPAN} where event_type = 'view' group by event_type, amount", "event_type; amount", f"SELECT event_type, CAST(sum(amount) AS BIGINT) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} AND event_type = 'view' GROUP BY 1")


# --- storage, time, functions and streams -----------------------------------------------------
def _root(spark: SparkSession, name: str) -> str:
    import uuid

    from .sources.storage import shared_root

    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _stored_events(spark: SparkSession, d: str):
    """The event measure written by day to a fresh store, and its resource."""
    from .sources.storage import Store

    c = catalog(d)
    r = c.get(Kind.MEASURE, "ev", "event_value")
    store = Store(_root(spark, "store"))
    store.append(c.frame(spark, r), r, bloom=("event_type",))
    return c, r, store


@_fn("A12_key_scan", f"SELECT o_custkey, o_orderkey, duration FROM {ORDER_SQL} WHERE duration BETWEEN 150000 AND 160000")
def _a12(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    r = c.get(Kind.TRACE, "shop", "orders")
    return trace.key_scan(c.frame(spark, r), r, "duration", 150000, 160000)


_ql("A17_segments", "SELECT duration FROM TRACE orders IN shop TIME BETWEEN '1996-01-01T10:00:00Z' AND '1996-01-31T10:00:00Z' ORDER BY duration DESC LIMIT 10", "o_custkey; o_orderkey; duration", f"WITH s AS (SELECT * FROM {ORDER_SQL} WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'), t AS (SELECT o_custkey FROM s GROUP BY 1 ORDER BY max(duration) DESC, o_custkey LIMIT 10) SELECT o_custkey, o_orderkey, duration FROM s JOIN t USING (o_custkey)")
_ql("F13_trace_order_timestamp", "SELECT state FROM TRACE orders IN shop TIME BETWEEN '1996-01-01T00:00:00Z' AND '1996-01-31T00:00:00Z' ORDER BY timestamp DESC LIMIT 10", "o_custkey; o_orderkey; state", "WITH s AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'), t AS (SELECT o_custkey FROM s WHERE o_orderdate <= TIMESTAMP '1996-01-31' GROUP BY 1 ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 10) SELECT o_custkey, o_orderkey, o_orderstatus AS state FROM s JOIN t USING (o_custkey)")


@_fn("A19_write_read", f"SELECT user_id, event_type, value FROM {EVENT_SQL} WHERE {SPAN_SQL} AND event_type = 'click'")
def _a19(spark: SparkSession, d: str) -> DataFrame:
    from .catalog import Catalog

    _, r, store = _stored_events(spark, d)
    own = Catalog()
    own.add(r, store.loader(r))
    return Engine(spark, own).query(f"SELECT user_id, event_type, value::field FROM MEASURE event_value IN ev {SPAN} WHERE event_type = 'click' LIMIT 4294967295").select("user_id", "event_type", "value")


@_fn("A22_expire", "SELECT event_id AS version FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def _a22b(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    _, r, store = _stored_events(spark, d)
    store.expire(spark, r, 11, date(2024, 1, 31))
    return store.read(spark, r).select("version")


@_fn("A23_compaction", "SELECT user_id, event_type, event_id + CASE WHEN user_id % 2 = 0 THEN 1000000000 ELSE 0 END AS version, CASE WHEN user_id % 2 = 0 THEN -value ELSE value END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1")
def _a23(spark: SparkSession, d: str) -> DataFrame:
    """All days hold two versions of some points; all are compacted in one job."""
    c, r, store = _stored_events(spark, d)
    newer = c.frame(spark, r).where("user_id % 2 = 0").withColumn("version", F.col("version") + 1_000_000_000).withColumn("value", -F.col("value"))
    store.append(newer, r)
    store.compact(spark, r, store.days(spark, r))
    return store.read(spark, r).select("user_id", "event_type", "version", "value")


@_fn("A26_dump", "SELECT CAST(event_id AS VARCHAR) AS version, event_type FROM events")
def _a26(spark: SparkSession, d: str) -> DataFrame:
    _, r, store = _stored_events(spark, d)
    path = _root(spark, "dump")
    store.dump(store.read(spark, r), path)
    return spark.read.option("header", True).csv(path).select("version", "event_type")


@_fn("U5_finalize", "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 6)")
def _u5(spark: SparkSession, d: str) -> DataFrame:
    """Stored traces, their spans written twice, compacted and sampled when their day is over."""
    from datetime import date

    from .sources.storage import Store

    c = catalog(d)
    r = c.get(Kind.TRACE, "chat", "conversations")
    store = Store(_root(spark, "store"))
    for _ in range(2):
        store.append(c.frame(spark, r), r)
    store.finalize(spark, r, [lambda spans: len(spans) >= 6], date(2024, 1, 3), grace_days=1)
    return store.read(spark, r).select("conv_id", "turn")


@_fn("A27_backup_restore", "SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def _a27(spark: SparkSession, d: str) -> DataFrame:
    from .sources.storage import Store

    _, r, store = _stored_events(spark, d)
    copy, back = Store(_root(spark, "backup")), Store(_root(spark, "back"))
    store.backup(spark, r, copy)
    back.restore(spark, r, copy)
    return back.read(spark, r).agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("total"))


@_fn("A28_stage_migration", "SELECT CASE WHEN ts < TIMESTAMP '2024-01-04' THEN 'cold' ELSE 'hot' END AS stage, count(*) AS n FROM events GROUP BY 1")
def _a28(spark: SparkSession, d: str) -> DataFrame:
    from datetime import date

    _, r, store = _stored_events(spark, d)
    store.migrate(spark, r, [day for day in store.days(spark, r) if day < date(2024, 1, 4)], "hot", "cold")
    both = [store.read(spark, r, s).groupBy(F.lit(s).alias("stage")).agg(F.count(F.lit(1)).alias("n")) for s in ("hot", "cold")]
    return both[0].unionByName(both[1])


@_fn("A29_retype", "SELECT event_id AS version, CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS amount FROM events")
def _a29(spark: SparkSession, d: str) -> DataFrame:
    from .sources.storage import Store

    _, r, store = _stored_events(spark, d)
    new = Store(_root(spark, "retyped"))
    store.resegment(spark, r, new, {"amount": "string"})
    return new.read(spark, r).select("version", "amount")


@_fn("P27_clamp", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def _p27(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace
    from datetime import datetime, timezone

    c = catalog(d)
    r = replace(c.get(Kind.STREAM, "log", "events"), created=datetime(2024, 1, 15, tzinfo=timezone.utc))
    c.resources[Kind.STREAM, "log", "events"] = r
    return Engine(spark, c).query(f"SELECT user_id FROM STREAM events IN log {ALL} LIMIT 4294967295").select("event_id")


def _quoted(s: str) -> str:
    return "'" + s + "'"


def _token_counts(key: str, analyzer: str, text: str, split: str | None) -> None:
    from .functions.analyzers import tokens

    QUERIES[key] = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(tokens(F.col("text"), analyzer)).cast("long").alias("n"))
    ORACLE_SQL[key] = f"SELECT doc_id, CAST({'1' if split is None else f'len(list_filter(string_split_regex({text}, {_quoted(split)}), lambda x: len(x) > 0))'} AS BIGINT) AS n FROM documents"


_token_counts("S1_keyword", "keyword", "text", None)
_token_counts("S2_simple", "simple", "lower(text)", "[^\\p{L}]+")
_token_counts("S3_standard", "standard", "lower(text)", "[^\\p{L}\\p{N}_]+")
_token_counts("S4_url", "url", "text", "[^\\p{L}\\p{N}]+")


@_fn("S6_time_bucket", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS n FROM events GROUP BY 1")
def _s6(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 hour")["start"].alias("b")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("b", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "n")


@_fn("S7_group_key", f"SELECT event_id, coalesce(kind, '') AS kind, CAST(user_id AS VARCHAR) AS who FROM {ELEMENT_SQL}")
def _s7(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    r = c.get(Kind.STREAM, "log", "events")
    return c.frame(spark, r).select("event_id", topn.text_of(r, "kind").alias("kind"), topn.text_of(r, "user_id").alias("who"))


@_fn("S8_series", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _s8(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    r = c.get(Kind.MEASURE, "ev", "event_value")
    return dedup.series(c.frame(spark, r), r.name, r.entity).agg(F.countDistinct("sid").alias("n"))


_ql("G4_ranking_groups", f"SHOW TOP 8 FROM MEASURE user_top IN (ev, ev_old) {ALL} ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8")
_ql("G5_property_groups", "SELECT label FROM PROPERTY customer IN (crm, crm_new) WHERE id IN ('1', '2', '3') LIMIT 100", "group; id; label", f"SELECT g AS \"group\", id, label FROM {PROPERTY_SQL} CROSS JOIN (VALUES ('crm'), ('crm_new')) v(g) WHERE id IN ('1', '2', '3')")


@_fn("U2_plugin", "SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1500000")
def _u2(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return sampling.chain(orders, "o_custkey", [lambda spans: spans["o_totalprice"].sum() > 1_500_000], ["o_totalprice"]).where("keep").select("o_custkey")


@_fn("I3_tumbling_stream", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def _i3(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows over the events as a stream of files, run to its end."""
    from .streaming.topn import windowed

    root = _root(spark, "windows")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    points = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").selectExpr("cast(ts AS timestamp) AS ts", "event_type", "cast(value AS bigint) AS amount")
    out = windowed(points, "ts", "1 day", ["event_type"], "amount", "1 day").writeStream.outputMode("complete")
    out.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.to_date("bucket").cast("string").alias("day"), "event_type", "total", "n")


@_fn("I13_snapshots", f"SELECT strftime(d, '%Y-%m-%d') AS day, event_type, user_id, amount AS value FROM {_lists_sql()}")
def _i13(spark: SparkSession, d: str) -> DataFrame:
    """An early snapshot of every list is replaced by the later one."""
    full = topn.lists(spark, catalog(d), "ev", "user_top").drop("version")
    early = full.where("rank <= 5").withColumn("value", F.col("value") + 1).withColumn("version", F.lit(1).cast("long"))
    both = early.unionByName(full.withColumn("version", F.lit(2).cast("long")))
    return topn.newest(both, ["event_type", "user_id"]).select(F.to_date("bucket").cast("string").alias("day"), "event_type", "user_id", "value")


# --- operators that other queries only touch --------------------------------------------------
_ql("A8_stream_limit_sort", f"SELECT event_type, amount FROM STREAM events IN log {SPAN} WHERE amount > 100 ORDER BY amount ASC LIMIT 33 OFFSET 7", "event_id; amount", f"SELECT event_id, amount FROM {ELEMENT_SQL} WHERE {SPAN_SQL} AND amount > 100 ORDER BY amount, event_id LIMIT 33 OFFSET 7")
_ql("A18_block_skip", "SELECT l_orderkey, l_linenumber FROM MEASURE lineitem IN tpch TIME BETWEEN '1997-05-05T00:00:00Z' AND '1997-05-06T00:00:00Z' LIMIT 4294967295", "l_orderkey; l_linenumber", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-05-05' AND TIMESTAMP '1997-05-06'")
_ql("P2_field_projection", f"SELECT value::field, amount::field FROM MEASURE event_value IN ev {ALL} LIMIT 4294967295", "version; value; amount", f"SELECT event_id AS version, value, amount FROM {EVENT_SQL}")
_ql("P4_group_union", f"SELECT user_id, kind, extra FROM MEASURE event_value IN (ev, ev_old) {ALL} LIMIT 4294967295", "version; user_id; kind; extra", f"SELECT event_id AS version, user_id, kind, CAST(NULL AS VARCHAR) AS extra FROM {EVENT_SQL} UNION ALL SELECT event_id, user_id, NULL, 'x' || user_id FROM {EVENT_SQL}")
_events("P15_posting_tree", "(amount > 300 OR user_id IN (1, 2, 3)) AND (kind != 'view' AND amount < 400)", "(amount > 300 OR user_id IN (1, 2, 3)) AND NOT coalesce(kind = 'view', false) AND amount < 400")
_ql("P17_indexed_criteria", f"SELECT user_id, value::field FROM MEASURE event_value IN ev {ALL} WHERE kind = 'click' AND user_id < 50 LIMIT 4294967295", "version; user_id; value", f"SELECT event_id AS version, user_id, value FROM {EVENT_SQL} WHERE coalesce(kind = 'click', false) AND user_id < 50")
_ql("P18_index_mode_criteria", "SELECT n_name FROM MEASURE nation IN geo WHERE n_name >= 'C' AND n_regionkey IN (1, 2, 3) ORDER BY name DESC", "n_name", "SELECT n_name FROM nation WHERE n_name >= 'C' AND n_regionkey IN (1, 2, 3)")
_events("P19_row_filter", "kind = 'view' AND props != '{}'", "coalesce(kind = 'view', false) AND NOT coalesce(props = '{}', false)")
_ql("P22_key_bounds", "SELECT duration FROM TRACE orders IN shop WHERE duration > 150000 ORDER BY duration DESC LIMIT 10", "o_custkey; o_orderkey; duration", f"WITH t AS (SELECT o_custkey FROM {ORDER_SQL} WHERE duration > 150000 GROUP BY 1 ORDER BY max(duration) DESC, o_custkey LIMIT 10) SELECT o_custkey, o_orderkey, duration FROM {ORDER_SQL} JOIN t USING (o_custkey)")
_ql("P24_ranking_condition", f"SHOW TOP 9 FROM MEASURE user_top IN ev {SPAN} WHERE event_type = 'view' ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} AND event_type = 'view' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 9")
_ql("C2_index_values", f"SELECT kind, user_id FROM MEASURE event_value IN ev {SPAN} ORDER BY kind DESC LIMIT 60", "version; kind; user_id", f"SELECT event_id AS version, kind, user_id FROM {EVENT_SQL} WHERE {SPAN_SQL} ORDER BY kind DESC NULLS LAST, ts, user_id, event_type LIMIT 60")
_events("C4_intersection", "amount >= 300 AND user_id < 60 AND event_type IN ('click', 'signup')", "amount >= 300 AND user_id < 60 AND event_type IN ('click', 'signup')")
_events("G6_set_operations", "amount < 20 OR amount >= 470 OR (user_id = 5 AND kind NOT IN ('click', 'view'))", "amount < 20 OR amount >= 470 OR (user_id = 5 AND NOT coalesce(kind IN ('click', 'view'), false))")
_ql("G7_filters_over_segments", f"SELECT user_id, value::field FROM MEASURE event_value IN staged ON (hot, cold) STAGES {ALL} WHERE kind = 'view' LIMIT 4294967295", "version; user_id; value", f"SELECT event_id AS version, user_id, value FROM {EVENT_SQL} WHERE coalesce(kind = 'view', false)")
_ql("D8_hash_group", f"SELECT l_partkey, quantity_i::field, COUNT(quantity_i) FROM MEASURE lineitem IN tpch {ALL} GROUP BY l_partkey, quantity_i LIMIT 4294967295", "l_partkey; quantity_i", "SELECT l_partkey, count(*) AS quantity_i FROM lineitem GROUP BY 1")
_ql("D16_extended_projection", f"SELECT SUM(amount) FROM MEASURE event_value IN ev {SPAN} WHERE user_id < 100", "amount", f"SELECT CAST(sum(amount) AS BIGINT) AS amount FROM {EVENT_SQL} WHERE {SPAN_SQL} AND user_id < 100 HAVING count(*) > 0")
_ql("D19_aggregate_columns", f"SELECT event_type, value::field, MIN(value) FROM MEASURE event_value IN ev {SPAN} GROUP BY event_type, value", "*", f"SELECT event_type, min(value) AS value FROM {EVENT_SQL} WHERE {SPAN_SQL} GROUP BY 1")
_ql("F12_distinct_elements", "SELECT amount FROM STREAM events IN log_copy ORDER BY amount DESC LIMIT 60", "event_id; amount", f"SELECT event_id, amount FROM {ELEMENT_SQL} ORDER BY amount DESC, event_id LIMIT 60")
_ql("F21_distinct_entities", f"SHOW TOP 100000 FROM MEASURE user_top IN ev {SPAN} ORDER BY DESC", "user_id; event_type; amount", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} GROUP BY 1, 2")
_docs("S9_arrays", "words HAVING ('the') AND words NOT HAVING ('of')", "list_contains(string_split(text, ' '), 'the') AND NOT list_contains(string_split(text, ' '), 'of')")


def _partials(spark: SparkSession, d: str, function: str) -> DataFrame:
    from .functions.timeparse import time_range

    begin, end = time_range("BETWEEN", "1990-01-01T00:00:00Z", "2030-01-01T00:00:00Z")
    q = MeasureQuery(("ev",), "event_value", begin, end, group_by=("event_type",), aggregate=(function, "amount"))
    return measure.partials(spark, catalog(d), q, shards=5)


def _reduced(key: str, function: str, sql: str, copies: int) -> None:
    """Final results of partial ones, which some nodes send more than once."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        parts = sent = _partials(spark, d, function)
        for _ in range(copies - 1):
            sent = sent.unionByName(parts)
        return measure.reduced(sent, function, Field("amount", Type.INT), ["event_type"])

    QUERIES[key] = run
    ORACLE_SQL[key] = f"SELECT event_type, {sql} AS amount FROM {EVENT_SQL} GROUP BY 1"


_reduced("D12_reduce", "SUM", "CAST(sum(amount) AS BIGINT)", 1)
_reduced("D13_replicas", "COUNT", "count(amount)", 3)
_reduced("K2_distributed_max", "MAX", "max(amount)", 2)


@_fn("F2_versions_across_groups", "SELECT user_id, event_type, event_id + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS version, CASE WHEN user_id % 2 = 0 THEN 2 * value ELSE value END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id DESC) = 1")
def _f2(spark: SparkSession, d: str) -> DataFrame:
    """Two groups hold the same points; the higher version stays."""
    c = catalog(d)
    r = c.get(Kind.MEASURE, "ev", "event_value")
    one = c.frame(spark, r)
    two = one.where("user_id % 2 = 0").withColumn("version", F.col("version") + 1).withColumn("value", 2 * F.col("value"))
    return dedup.versions(one.unionByName(two), r.entity, r.timestamp).select("user_id", "event_type", "version", "value")


@_fn("F4_trace_ids_once", f"SELECT o_custkey, max(duration) AS rank FROM {ORDER_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def _f4(spark: SparkSession, d: str) -> DataFrame:
    from .model import Order, TraceQuery

    c = catalog(d)
    r = c.get(Kind.TRACE, "shop", "orders")
    q = TraceQuery(("shop",), "orders", order=Order("duration", True), limit=25)
    return trace.selected(c.frame(spark, r), q, r, None).select("o_custkey", F.col("_rank").alias("rank"))


@_fn("F6_entries_once", f"SELECT DISTINCT o_custkey, o_orderkey, duration FROM {ORDER_SQL}")
def _f6(spark: SparkSession, d: str) -> DataFrame:
    """Index entries that two parts hold count once."""
    c = catalog(d)
    r = c.get(Kind.TRACE, "shop", "orders")
    both = c.frame(spark, r).unionByName(c.frame(spark, r).where("duration > 100000"))
    return dedup.first(trace.key_scan(both, r, "duration"), ["o_custkey", "o_orderkey"], ["duration"])


@_fn("S5_relative_time", f"SELECT event_id FROM {ELEMENT_SQL} WHERE ts BETWEEN TIMESTAMP '2024-01-18 12:00:00' AND TIMESTAMP '2024-01-20'")
def _s5(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime, timezone

    now = datetime(2024, 1, 20, tzinfo=timezone.utc)
    return engine(spark, d).query("SELECT user_id FROM STREAM events IN log TIME > '-1d12h' LIMIT 4294967295", now=now).select("event_id")


@_fn("I11_group_keys", "SELECT event_type AS group_key, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def _i11(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(d)
    r = c.get(Kind.MEASURE, "ev", "event_value")
    points = topn.prepared(c.frame(spark, r), c.rankings["ev", "user_top"], r)
    return points.groupBy("group_key", F.to_date("bucket").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@_fn("I12_last_write_counts", f"SELECT strftime(d, '%Y-%m-%d') AS day, user_id, event_type, amount AS value FROM {_lists_sql(by='')}")
def _i12(spark: SparkSession, d: str) -> DataFrame:
    """A later write of a series in a bucket replaces the earlier one before the best are kept."""
    out = topn.lists(spark, catalog(d), "ev", "user_both").where("direction = 'desc'")
    return out.select(F.to_date("bucket").cast("string").alias("day"), "user_id", "event_type", "value")


@_fn("A31_stored_lists", f"SELECT user_id, event_type, max(amount) AS amount FROM {_lists_sql()} WHERE {_RANGE} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15")
def _a31(spark: SparkSession, d: str) -> DataFrame:
    """The lists written as rows, and a ranking query that reads them instead of the points."""
    from .functions.timeparse import time_range
    from .model import TopNQuery

    c = catalog(d)
    path = _root(spark, "lists")
    topn.lists(spark, c, "ev", "user_top").write.parquet(path)
    begin, end = time_range("BETWEEN", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z")
    return topn.run(spark, c, TopNQuery(("ev",), "user_top", begin, end, n=15, desc=True), stored=spark.read.parquet(path))


def _streamed(spark: SparkSession, d: str, name: str, made: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """The events as a stream of files through `made`, run to its end."""
    root = _root(spark, name)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    points = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").selectExpr("cast(ts AS timestamp) AS ts", "user_id", "event_type", "cast(value AS bigint) AS amount")
    out = made(points).writeStream.outputMode(mode)
    out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}" if mode == "append" else f"{root}/out/batch=0")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


@_fn("I4_sliding_windows", "SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, event_type, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM (SELECT event_type, CAST(trunc(value) AS BIGINT) AS amount, unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END), date_trunc('day', ts) + INTERVAL 12 HOUR * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END) - INTERVAL 12 HOUR]) AS b FROM events) GROUP BY 1, 2")
def _i4(spark: SparkSession, d: str) -> DataFrame:
    from .streaming.topn import windowed

    out = _streamed(spark, d, "sliding", lambda p: windowed(p, "ts", "1 day", ["event_type"], "amount", "1 day", "12 hours"))
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "event_type", "total", "n")


@_fn("I4_session_windows", "WITH e AS (SELECT *, CAST(trunc(value) AS BIGINT) AS amount, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e), g AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, max(ts) + INTERVAL 6 HOUR AS e, CAST(sum(amount) AS BIGINT) AS total, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, start, total, n FROM g WHERE e <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def _i4b(spark: SparkSession, d: str) -> DataFrame:
    """Sessions come out when the watermark has passed their end."""
    from .streaming.topn import sessions

    out = _streamed(spark, d, "sessions", lambda p: sessions(p, "ts", "6 hours", ["user_id"], "amount", "1 day"), "append")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "total", "n")


# --- late points, triggers, and what Spark does for indexes -----------------------------------
#: Points that count when the even users' points come first: the others' are late where their bucket
#: ended before the latest time seen less two intervals.
_IN_TIME = "(user_id % 2 = 0 OR date_trunc('day', ts) + INTERVAL 1 DAY > (SELECT max(ts) FROM events WHERE user_id % 2 = 0) - INTERVAL 2 DAY)"


def _two_batches(spark: SparkSession, d: str):
    """A ranking's stream that gets the even users' points, then the odd users', in one batch each."""
    from .streaming.topn import RankingStream

    root = _root(spark, "late")
    events = spark.read.parquet(f"{d}/events.parquet")
    job = RankingStream(spark, catalog(d), "ev", "user_top", f"{root}/ranking")
    for n in range(2):
        events.where(F.col("user_id") % 2 == n).write.parquet(f"{root}/in/part{n}")
        raw = spark.readStream.schema(events.schema).parquet(f"{root}/in/part*")
        points = raw.selectExpr("user_id", "event_type", "nullif(event_type, 'error') AS kind", "value", "cast(value AS bigint) AS amount", "cast(ts AS timestamp) AS ts", "event_id AS version")
        job.start(points, availableNow=True).awaitTermination()
    return job


@_fn("I6_late_points", f"SELECT strftime(d, '%Y-%m-%d') AS day, event_type, user_id, amount AS value FROM {_lists_sql(where=_IN_TIME)}")
def _i6(spark: SparkSession, d: str) -> DataFrame:
    """Points of buckets that the watermark has passed are dropped; open buckets take late ones."""
    return _two_batches(spark, d).lists().select(F.to_date("bucket").cast("string").alias("day"), "event_type", "user_id", "value")


@_fn("I9_changed_buckets", f"SELECT DISTINCT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type FROM events WHERE date_trunc('day', ts) IN (SELECT date_trunc('day', ts) FROM events WHERE user_id % 2 = 1 AND {_IN_TIME}) AND {_IN_TIME}")
def _i9(spark: SparkSession, d: str) -> DataFrame:
    """The lists that the second batch ranked anew: those of the buckets that it touched, no others."""
    job = _two_batches(spark, d)
    return spark.read.parquet(f"{job.root}/lists").where("version > 0").select(F.to_date("bucket").cast("string").alias("day"), "event_type").distinct()


@_fn("I5_watermark", "SELECT strftime(max(ts) - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS mark FROM events WHERE user_id % 2 = 0")
def _i5(spark: SparkSession, d: str) -> DataFrame:
    """Where the second batch finds the watermark: the latest time before it less two intervals."""
    seen = spark.read.parquet(f"{_two_batches(spark, d).root}/seen").where("batch = 0")
    return seen.select(F.date_format(F.col("ts") - F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd HH:mm:ss").alias("mark"))


@_fn("I7_on_watermark", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def _i7(spark: SparkSession, d: str) -> DataFrame:
    """Windows come out once, when the watermark has passed their end."""
    from .streaming.topn import windowed

    out = _streamed(spark, d, "passed", lambda p: windowed(p, "ts", "1 day", ["event_type"], "amount", "1 day"), "append")
    return out.select(F.to_date("bucket").cast("string").alias("day"), "event_type", "total", "n")


@_fn("C1_series_join", f"SELECT user_id, event_type, event_id AS version, value FROM {EVENT_SQL} WHERE user_id < 40 AND event_type <> 'view'")
def _c1(spark: SparkSession, d: str) -> DataFrame:
    """Series found by their entity, and the points of those series by series id."""
    c = catalog(d)
    r = c.get(Kind.MEASURE, "ev", "event_value")
    points = dedup.series(dedup.versions(c.frame(spark, r), r.entity, r.timestamp), r.name, r.entity)
    found = points.where("user_id < 40 AND event_type <> 'view'").select("sid").distinct()
    return points.join(found, "sid", "left_semi").select("user_id", "event_type", "version", "value")


@_fn("P16_skipping", f"SELECT user_id, event_id AS version, value FROM {EVENT_SQL} WHERE {SPAN_SQL} AND event_type = 'purchase' AND user_id < 60")
def _p16(spark: SparkSession, d: str) -> DataFrame:
    """Days, row-group statistics and a bloom filter skip what can't match; the rows are the same."""
    from .catalog import Catalog

    _, r, store = _stored_events(spark, d)
    stored = Catalog()
    stored.add(r, store.loader(r))
    text = f"SELECT user_id, value::field FROM MEASURE event_value IN ev {SPAN} WHERE event_type = 'purchase' AND user_id < 60 LIMIT 4294967295"
    return Engine(spark, stored).query(text).select("user_id", "version", "value")


@_fn("P23_key_entries_matched", f"SELECT o_custkey, o_orderkey, duration FROM {ORDER_SQL} WHERE duration >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def _p23(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the order key whose spans meet the remaining conditions."""
    from .model import Cond, Or
    from .operators.predicates import compile_criteria

    c = catalog(d)
    r = c.get(Kind.TRACE, "shop", "orders")
    test = compile_criteria(Or(Cond("state", "EQ", "F"), Cond("priority", "IN", ("1-URGENT", "2-HIGH"))), r)
    return trace.key_scan(c.frame(spark, r).where(test), r, "duration", 100000)


_ql("F9_index_order", f"SELECT user_id FROM STREAM events IN log {SPAN} ORDER BY user DESC LIMIT 45", "event_id; user_id", f"SELECT event_id, user_id FROM events WHERE {SPAN_SQL} ORDER BY user_id DESC, event_id LIMIT 45")
