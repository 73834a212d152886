"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median, every row of the
result computed (a noop sink).  rows_per_s divides the rows of the table by that time.
"""

import json
import os
import time
from statistics import median

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SPAN = "TIME BETWEEN '1990-01-01T00:00:00Z' AND '2030-01-01T00:00:00Z'"
HEADLINE = {
    "scan_all": ("lineitem", f"SELECT l_returnflag, l_linestatus, quantity::field FROM MEASURE lineitem IN tpch {SPAN} LIMIT 4294967295"),
    "group_sum": ("lineitem", f"SELECT l_returnflag, l_linestatus, extendedprice::field, SUM(extendedprice) FROM MEASURE lineitem IN tpch {SPAN} GROUP BY l_returnflag, l_linestatus, extendedprice"),
    "top_with_filter": ("lineitem", f"SELECT TOP 2 quantity_i DESC, l_suppkey, quantity_i::field, MEAN(quantity_i) FROM MEASURE lineitem IN tpch {SPAN} WHERE l_suppkey != 3 GROUP BY l_suppkey, quantity_i"),
    "version_dedup": ("lineitem", f"SELECT l_suppkey, quantity_i::field, SUM(quantity_i) FROM MEASURE supply IN tpch {SPAN} GROUP BY l_suppkey, quantity_i LIMIT 4294967295"),
    "stream_order_by_tag": ("events", f"SELECT amount FROM STREAM events IN log {SPAN} WHERE kind != 'click' ORDER BY amount DESC LIMIT 100"),
    "stream_match": ("documents", "SELECT lang FROM STREAM documents IN docs WHERE text MATCH('licensed') LIMIT 4294967295"),
    "trace_by_id": ("orders", "SELECT duration FROM TRACE orders IN shop WHERE o_custkey IN (1, 7, 100)"),
    "trace_tag_filter": ("orders", f"SELECT duration, state FROM TRACE orders IN shop {SPAN} WHERE state = 'P' ORDER BY timestamp DESC LIMIT 20"),
    "topn_query": ("events", f"SHOW TOP 10 FROM MEASURE user_top IN ev {SPAN} ORDER BY DESC"),
    "property_latest": ("customer", "SELECT label FROM PROPERTY customer IN crm WHERE segment = 'BUILDING' LIMIT 4294967295"),
}


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.queries import engine

    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run = engine(spark, SF_DIR)
    seconds, rate = {}, {}
    for name, (table, text) in HEADLINE.items():
        took = []
        for _ in range(4):
            began = time.perf_counter()
            run.query(text).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took[1:]), 4)
        rate[name] = round(spark.read.parquet(f"{SF_DIR}/{table}.parquet").count() / seconds[name])
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows_per_s": rate, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
