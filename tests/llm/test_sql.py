"""Training-data queries that SQL can express, against their SQL, also on odd tables."""

import duckdb
import pytest

from tidemark.llm.queries import ORACLE_SQL, QUERIES


def as_rows(columns, found):
    """Rows as a sorted list of texts, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in found)


def of_spark(df):
    return as_rows(df.columns, [tuple(r) for r in df.collect()])


def of_duck(relation):
    return as_rows(relation.columns, relation.fetchall())


TEXT = "".join(chr(97 + (i * i * 7 + i // 5) % 26) for i in range(900))
PAGES = [(1, "u", None), (2, "u", ""), (3, "v", "x" * 99), (4, "v", "x" * 99), (9, "w", "é" * 50), (5, None, "é" * 50), (5, None, "é" * 50), (7, "w", "é" * 49), (6, "w", "<p>long</p>" * 900)]
DOCUMENTS = [(1, None), (2, ""), (3, TEXT), (3, TEXT), (4, "head " + TEXT[100:400] + " tail"), (5, "z" * 199), (6, "z" * 200), (7, "é" * 700), (8, TEXT[:250] + TEXT[250:500] + "!" + TEXT[600:899]), (None, TEXT[:201])]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf, duck):
    assert of_spark(QUERIES[name](spark, sf)) == of_duck(duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize(("name", "table", "data", "schema"), [("op4_suffix_dedup", "documents", DOCUMENTS, "doc_id long, text string"), ("op10_warc_records", "pages", PAGES, "page_id long, url string, html string")])
def test_odd_rows(name, table, data, schema, spark, tmp_path):
    path = f"{tmp_path}/{table}.parquet"
    for part in (data, data[:0]):
        spark.createDataFrame(part, schema).write.mode("overwrite").parquet(path)
        with duckdb.connect() as c:
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
            want = of_duck(c.sql(ORACLE_SQL[name]))
        assert of_spark(QUERIES[name](spark, str(tmp_path))) == want and len(want[1]) == len(part)
