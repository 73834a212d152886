"""Grammar, binding and the errors of requests."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.bindings import catalog
from tidemark.errors import RequestError, SyntaxFault
from tidemark.functions.timeparse import duration, instant, time_range
from tidemark.model import And, Cond, MeasureQuery, Or, PropertyQuery, StreamQuery, TopNQuery
from tidemark.plans.bind import Prepared, request
from tidemark.plans.ql import Param, parse

NOW = datetime(2024, 2, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def cat(sf):
    return catalog(sf)


def test_precedence_and_parentheses():
    w = parse("SELECT a FROM STREAM s IN g WHERE a = 1 OR b = 2 AND c = 3").where
    assert w.op == "OR" and w.right.op == "AND"
    w = parse("SELECT a FROM STREAM s IN g WHERE (a = 1 OR b = 2) AND c = 3").where
    assert w.op == "AND" and w.left.op == "OR"


def test_clauses():
    s = parse("select top 3 value, `odd name`, x.y::tag from measure m-1 in (g1, g2) on hot stages time > '-15m' order by time desc with query_trace limit 5 offset ?")
    assert s.top == (3, "value", None) and s.groups == ("g1", "g2") and s.stages == ("hot",)
    assert [c.name for c in s.columns] == ["odd name", "x.y"] and s.name == "m-1"
    assert s.order == (None, "DESC") and s.trace and s.limit == 5 and s.offset == Param(0) and s.params == 1


@pytest.mark.parametrize("text", ["SELECT", "SELECT a FROM STREAM s", "SELECT a FROM TABLE s IN g", "SELECT a FROM STREAM s IN ?", "SELECT a FROM STREAM s IN g WHERE ? = 1", "SELECT a FROM STREAM s IN g WHERE a = ??", "SELECT a FROM STREAM s IN g ORDER BY ?", "SELECT limit FROM STREAM s IN g", "SELECT a FROM STREAM s IN g WHERE a MATCH('x', ?)", "SELECT a FROM STREAM s IN g LIMIT -1", "SELECT a FROM STREAM s IN g extra", "SELECT a FROM STREAM s IN g WHERE a # 1", "SHOW TOP 3 FROM MEASURE m IN g WHERE a = 1 OR b = 2"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxFault):
        parse(text)


def test_question_mark_in_text_is_no_parameter():
    assert parse("SELECT a FROM STREAM s IN g WHERE a = 'why?'").params == 0


@given(st.text(max_size=60))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse(text)
    except SyntaxFault:
        pass


def test_request_forms(cat):
    q = request("SELECT event_type FROM STREAM events IN log TIME > '-1d' WHERE amount > 3 AND (kind = 'a' OR kind = 'b')", cat, now=NOW)
    assert isinstance(q, StreamQuery) and q.begin == NOW - timedelta(days=1) and q.end == NOW
    assert q.criteria == And(Cond("amount", "GT", 3), Or(Cond("kind", "EQ", "a"), Cond("kind", "EQ", "b")))
    q = request("SELECT TOP 2 value, event_type, value::field, AVG(value) FROM MEASURE event_value IN ev GROUP BY event_type, value", cat)
    assert isinstance(q, MeasureQuery) and q.aggregate == ("MEAN", "value") and q.top.desc is False
    q = request("SELECT label FROM PROPERTY customer IN crm WHERE id = '5' AND segment = 'X'", cat)
    assert isinstance(q, PropertyQuery) and q.ids == ("5",) and q.criteria == Cond("segment", "EQ", "X")
    q = request("SHOW TOP ? FROM MEASURE user_top IN ev AGGREGATE BY AVG ORDER BY DESC", cat, (4,))
    assert isinstance(q, TopNQuery) and (q.n, q.desc, q.aggregate) == (4, True, "MEAN")


BAD = [
    "SELECT nope FROM STREAM events IN log",
    "SELECT event_type FROM STREAM nope IN log",
    "SELECT SUM(amount) FROM STREAM events IN log",
    "SELECT event_type FROM STREAM events IN log GROUP BY event_type",
    "SELECT SUM(value), MAX(value) FROM MEASURE event_value IN ev",
    "SELECT event_type, SUM(value) FROM MEASURE event_value IN ev GROUP BY event_type",
    "SELECT () FROM STREAM events IN log",
    "SELECT event_type FROM STREAM events IN log WHERE amount = 'many'",
    "SELECT event_type FROM STREAM events IN log WHERE kind IN ('a', NULL)",
    "SELECT event_type FROM STREAM events IN log WHERE event_type != 'click'",
    "SELECT event_type FROM STREAM events IN log ORDER BY event_type",
    "SELECT text FROM STREAM documents IN docs WHERE words IN ('a')",
    "SELECT state FROM TRACE orders IN shop",
    "SELECT state FROM TRACE orders IN shop WHERE state = 'P'",
    "SELECT state FROM TRACE orders IN shop WHERE o_custkey = 1 OR state = 'P'",
    "SELECT state FROM TRACE orders IN shop WHERE ts = 1 ORDER BY duration DESC",
    "SELECT label FROM PROPERTY customer IN crm WHERE id > '5'",
    "SELECT value::field FROM MEASURE event_value IN ev TIME > '-1d' WHERE kind = NULL",
    "SELECT l_orderkey FROM MEASURE lineitem IN tpch TIME > '-1d' ORDER BY timestamp",
    "SHOW TOP 3 FROM MEASURE user_top IN ev",
    "SHOW TOP 3 FROM MEASURE user_top IN ev ORDER BY ASC",
    "SHOW TOP 3 FROM MEASURE user_top IN ev WHERE user_id = 3 ORDER BY DESC",
    "SHOW TOP 3 FROM MEASURE user_top IN ev WHERE event_type > 'a' ORDER BY DESC",
    "SELECT event_type FROM MEASURE event_value IN ev TIME > 5",
]


@pytest.mark.parametrize("text", BAD)
def test_request_errors(text, cat, spark):
    from tidemark.plans.engine import Engine

    with pytest.raises(RequestError):
        Engine(spark, cat).query(text, now=NOW)


def test_parameters(cat):
    p = Prepared("SELECT event_type FROM STREAM events IN log WHERE kind IN (?, 'z') AND amount > ? LIMIT ?")
    assert p.params == 3
    q = p.bind(cat, ["a", "b"], 3, 10)
    assert q.criteria == And(Cond("kind", "IN", ["a", "b", "z"]), Cond("amount", "GT", 3)) and q.limit == 10
    for bad in [(), (["a"], 3), ([], 3, 1), (b"x", 3, 1), ("a", [1], 1), ("a", 1, "x"), ("a", 1, 2**33)]:
        with pytest.raises(RequestError):
            p.bind(cat, *bad)


def test_times():
    assert duration("-1h30m") == timedelta(minutes=-90)
    assert instant("2024-01-01T00:00:00.1239Z").microsecond == 123000
    assert time_range(">", "-1d", now=NOW) == time_range(">=", "-1d", now=NOW)
    assert time_range("<", "now", now=NOW)[0].year == 1970
    assert time_range("=", "now", now=NOW) == (NOW, NOW)
    for bad in ("soon", "2024-01-01", 5):
        with pytest.raises(RequestError):
            instant(bad)


def test_top_needs_a_number(spark):
    from tidemark.catalog import Catalog, Field, Group, Kind, Resource, Tag, Type
    from tidemark.plans.engine import Engine

    c = Catalog()
    c.add_group(Group("g", Kind.MEASURE))
    rows = "'a' AS id, timestamp '2024-01-01' AS ts, cast(1 AS bigint) AS version, 'x' AS note, cast(2 AS bigint) AS n"
    c.add(Resource(Kind.MEASURE, "g", "m", (Tag("id"),), (Field("note", Type.STRING), Field("n", Type.INT)), ("id",)), lambda s: s.sql(f"SELECT {rows}"))
    time = "TIME BETWEEN '2023-01-01T00:00:00Z' AND '2025-01-01T00:00:00Z'"
    assert Engine(spark, c).query(f"SELECT TOP 1 n DESC, id, n::field FROM MEASURE m IN g {time}").count() == 1
    with pytest.raises(RequestError, match="INT or FLOAT"):
        Engine(spark, c).query(f"SELECT TOP 1 note DESC, id, note::field FROM MEASURE m IN g {time}")
