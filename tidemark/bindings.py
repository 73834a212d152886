"""The data models over the driver's tables: what the queries and tests run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, Field, Group, IndexRule, Kind, Ranking, Resource, Stage, Tag, Type
from .model import Cond

I, S, A = Type.INT, Type.STRING, Type.STRING_ARRAY  # noqa: E741


def _read(sf_dir: str, table: str, *exprs: str):
    return lambda spark: spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*exprs)


EVENT = ("user_id", "event_type", "nullif(event_type, 'error') AS kind", "value", "cast(value AS bigint) AS amount", "ts", "event_id AS version")
EVENT_TAGS = (Tag("user_id", I), Tag("event_type"), Tag("kind"))
ELEMENT = ("event_id", "ts", "user_id", "event_type", "nullif(event_type, 'error') AS kind", "cast(value AS bigint) AS amount", "props")
ELEMENT_TAGS = (Tag("user_id", I), Tag("event_type"), Tag("kind"), Tag("amount", I), Tag("props"))
ELEMENT_RULES = (IndexRule("amount", ("amount",)), IndexRule("user", ("user_id",)), IndexRule("props", ("props",), "simple"))


def _copies(sf_dir: str):
    """Two overlapping slices of the events: elements in both have one id."""

    def load(spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*ELEMENT)
        return df.where("user_id < 100").unionByName(df.where("user_id >= 50"))

    return load


def _revisions(sf_dir: str):
    """Customers as properties: a first revision of all, a second of some, tombstones of others."""

    def load(spark: SparkSession) -> DataFrame:
        c = spark.read.parquet(f"{sf_dir}/customer.parquet")
        base = c.selectExpr("'crm' AS group", "'customer' AS name", "cast(c_custkey AS string) AS id", "cast(1 AS bigint) AS mod_revision", "cast(NULL AS timestamp) AS delete_time", "c_name AS label", "c_mktsegment AS segment", "cast(c_acctbal AS bigint) AS balance", "c_custkey AS number")
        second = base.where("number % 3 = 0").withColumn("mod_revision", F.lit(2).cast("long")).withColumn("balance", F.col("balance") + 1000)
        gone = base.where("number % 7 = 0").withColumn("mod_revision", F.lit(3).cast("long")).withColumn("delete_time", F.lit("2024-01-01 00:00:00").cast("timestamp"))
        return base.unionByName(second).unionByName(gone)

    return load


def catalog(sf_dir: str) -> Catalog:
    c = Catalog()
    for name, kind in (("ev", Kind.MEASURE), ("ev_old", Kind.MEASURE), ("tpch", Kind.MEASURE), ("geo", Kind.MEASURE), ("log", Kind.STREAM), ("log_copy", Kind.STREAM), ("docs", Kind.STREAM), ("shop", Kind.TRACE), ("shop_new", Kind.TRACE), ("chat", Kind.TRACE), ("crm", Kind.PROPERTY)):
        c.add_group(Group(name, kind))
    c.add_group(Group("staged", Kind.MEASURE, ttl_days=30, stages=(Stage("hot", 7), Stage("cold", 30)), default_stages=("hot",)))

    event_rules = (IndexRule("kind", ("kind",)), IndexRule("type", ("event_type",)))
    event = Resource(Kind.MEASURE, "ev", "event_value", EVENT_TAGS, (Field("value", Type.FLOAT), Field("amount", I)), ("user_id", "event_type"), event_rules)
    c.add(event, _read(sf_dir, "events", *EVENT))
    # The other group lacks `kind`, has a tag of its own, and holds only the first users.
    c.add(Resource(Kind.MEASURE, "ev_old", "event_value", (Tag("user_id", I), Tag("event_type"), Tag("extra")), (Field("value", Type.FLOAT), Field("amount", I)), ("user_id", "event_type")), _read(sf_dir, "events", "user_id", "event_type", "concat('x', user_id) AS extra", "value", "cast(value AS bigint) AS amount", "ts + INTERVAL 400 DAYS AS ts", "event_id AS version"))
    for stage, where in (("hot", ">="), ("cold", "<")):
        def load(spark, op=where):
            return spark.read.parquet(f"{sf_dir}/events.parquet").where(f"ts {op} '2024-01-20'").selectExpr(*EVENT)

        c.add(Resource(Kind.MEASURE, "staged", "event_value", EVENT_TAGS, (Field("value", Type.FLOAT), Field("amount", I)), ("user_id", "event_type"), event_rules), load, stage)

    line_tags = (Tag("l_orderkey", I), Tag("l_linenumber", I), Tag("l_returnflag"), Tag("l_linestatus"), Tag("l_suppkey", I), Tag("l_partkey", I))
    line_fields = (Field("quantity", Type.FLOAT), Field("extendedprice", Type.FLOAT), Field("discount", Type.FLOAT), Field("tax", Type.FLOAT), Field("quantity_i", I))
    line = ("l_orderkey", "cast(l_linenumber AS bigint) AS l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey", "l_partkey", "l_quantity AS quantity", "l_extendedprice AS extendedprice", "l_discount AS discount", "l_tax AS tax", "cast(l_quantity AS bigint) AS quantity_i", "l_shipdate AS ts")
    line_rules = (IndexRule("returnflag", ("l_returnflag",)), IndexRule("linestatus", ("l_linestatus",)), IndexRule("supplier", ("l_suppkey",)), IndexRule("part", ("l_partkey",)))
    c.add(Resource(Kind.MEASURE, "tpch", "lineitem", line_tags, line_fields, ("l_orderkey", "l_linenumber"), line_rules, unique=True), _read(sf_dir, "lineitem", *line))
    c.add(Resource(Kind.MEASURE, "tpch", "supply", (Tag("l_suppkey", I), Tag("l_returnflag")), (Field("quantity", Type.FLOAT), Field("quantity_i", I)), ("l_suppkey",), (IndexRule("returnflag", ("l_returnflag",)),)), _read(sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity AS quantity", "cast(l_quantity AS bigint) AS quantity_i", "l_shipdate AS ts", "l_orderkey * 8 + l_linenumber AS version"))
    c.add(Resource(Kind.MEASURE, "geo", "nation", (Tag("n_nationkey", I), Tag("n_name"), Tag("n_regionkey", I)), (), ("n_nationkey",), (IndexRule("region", ("n_regionkey",)), IndexRule("name", ("n_name",))), index_mode=True), _read(sf_dir, "nation", "cast(n_nationkey AS bigint) AS n_nationkey", "n_name", "cast(n_regionkey AS bigint) AS n_regionkey", "timestamp_ntz '2024-01-01 00:00:00' AS ts"))

    log = Resource(Kind.STREAM, "log", "events", ELEMENT_TAGS, entity=("event_type",), rules=ELEMENT_RULES, element_id="event_id", unique=True)
    c.add(log, _read(sf_dir, "events", *ELEMENT))
    c.add(Resource(Kind.STREAM, "log_copy", "events", ELEMENT_TAGS, entity=("event_type",), rules=ELEMENT_RULES, element_id="event_id"), _copies(sf_dir))
    c.add(Resource(Kind.STREAM, "docs", "documents", (Tag("text"), Tag("lang"), Tag("source"), Tag("n_chars", I), Tag("words", A)), entity=("lang",), rules=(IndexRule("text", ("text",), "simple"), IndexRule("chars", ("n_chars",))), element_id="doc_id", unique=True), _read(sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars", "split(text, ' ') AS words", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, doc_id % 86400) AS ts"))

    order = ("o_custkey", "o_orderkey", "o_orderdate AS ts", "cast(o_totalprice AS bigint) AS duration", "o_orderstatus AS state", "o_orderpriority AS priority")
    order_tags = (Tag("o_custkey", I), Tag("o_orderkey", I), Tag("duration", I), Tag("state"), Tag("priority"), Tag("ts", Type.TIMESTAMP))
    order_rules = (IndexRule("duration", ("duration",)), IndexRule("timestamp", ("state", "ts")))
    ids = {"trace_id": "o_custkey", "span_id": "o_orderkey", "unique": True}
    c.add(Resource(Kind.TRACE, "shop", "orders", order_tags, rules=order_rules, **ids), _read(sf_dir, "orders", *order))
    c.add(Resource(Kind.TRACE, "shop_new", "orders", (Tag("o_custkey", I), Tag("o_orderkey", I), Tag("duration", I), Tag("state", I), Tag("ts", Type.TIMESTAMP), Tag("fresh")), rules=order_rules, **ids), _read(sf_dir, "orders", "o_custkey + 10000000 AS o_custkey", "o_orderkey", "o_orderdate AS ts", "cast(o_totalprice AS bigint) AS duration", "cast(ascii(o_orderstatus) AS bigint) AS state", "'new' AS fresh"))
    c.add(Resource(Kind.TRACE, "chat", "conversations", (Tag("conv_id", I), Tag("turn", I), Tag("role")), rules=(IndexRule("turn", ("turn",)),), trace_id="conv_id", span_id="turn", unique=True), _read(sf_dir, "conversations", "conv_id", "turn", "role", "text AS span", "timestamp_ntz '2024-01-01 00:00:00' AS ts"))
    c.add(Resource(Kind.PROPERTY, "crm", "customer", (Tag("label"), Tag("segment"), Tag("balance", I), Tag("number", I))), _revisions(sf_dir))

    c.add_group(Group("crm_new", Kind.PROPERTY))
    newer = _revisions(sf_dir)
    c.add(Resource(Kind.PROPERTY, "crm_new", "customer", (Tag("label"), Tag("segment"), Tag("balance", I), Tag("number", I))), lambda spark: newer(spark).withColumn("group", F.lit("crm_new")))
    c.add_ranking(Ranking("ev_old", "user_top", "event_value", "ev_old", "amount", ("event_type",), "DESC", counters=20, interval="1 day"))
    for name, sort, by, criteria in (("user_top", "DESC", ("event_type",), None), ("user_both", None, (), None), ("buyers", "DESC", (), Cond("event_type", "EQ", "purchase")), ("others", "ASC", ("event_type",), Cond("event_type", "NOT_IN", ["click", "view"]))):
        c.add_ranking(Ranking("ev", name, "event_value", "ev", "amount", by, sort, counters=20, interval="1 day", criteria=criteria))
    return c
