"""Criteria as column expressions, with the null rules of the data model.

A comparison with null is false, and its negation true: every positive test gives true or
false, and NE, NOT IN and NOT HAVING negate it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Kind, Resource, Tag, Type
from ..errors import RequestError
from ..functions.analyzers import match
from ..model import And, Cond, Criteria, Or

RANGES: dict[str, Callable[[Column, Column], Column]] = {
    "LT": lambda a, b: a < b,
    "LE": lambda a, b: a <= b,
    "GT": lambda a, b: a > b,
    "GE": lambda a, b: a >= b,
}


def conditions(c: Criteria | None) -> Iterator[Cond]:
    """The leaves, left to right."""
    if isinstance(c, (And, Or)):
        yield from conditions(c.left)
        yield from conditions(c.right)
    elif c is not None:
        yield c


def has_or(c: Criteria | None) -> bool:
    return isinstance(c, Or) or isinstance(c, And) and (has_or(c.left) or has_or(c.right))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _known(name: Column, c: Column) -> Column:
    """A test of one column that is false for null.  Unlike coalesce, this form reaches the scan."""
    return name.isNotNull() & c


def _literal(tag: Tag, value: object) -> object:
    """The value in the tag's type; None if it cannot be equal to any value of the tag."""
    kind = Type.STRING if tag.type in (Type.STRING, Type.STRING_ARRAY) else tag.type
    if value is None:
        return None
    if kind is Type.STRING:
        return str(value)
    if kind in (Type.INT, Type.INT_ARRAY):
        try:
            return int(value)
        except (TypeError, ValueError):
            raise RequestError(f"{tag.name} is {tag.type.value}; {value!r} is not") from None
    raise RequestError(f"{tag.name} is {tag.type.value}, which conditions don't take")


def _values(tag: Tag, value: object) -> list:
    return [_literal(tag, v) for v in (value if isinstance(value, (list, tuple)) else [value])]


def _equal(tag: Tag, value: object) -> Column:
    c = F.col(f"`{tag.name}`")
    if tag.type.array:
        values = _values(tag, value)
        if any(v is None for v in values):
            return F.lit(False)
        return _true(c == F.array(*[F.lit(v) for v in values]).cast(tag.type.spark))
    v = _literal(tag, value)
    return F.lit(False) if v is None else _known(c, c == F.lit(v))


def _contains(tag: Tag, value: object) -> Column:
    values = _values(tag, value)
    if any(v is None for v in values):
        return F.lit(False)
    c = F.col(f"`{tag.name}`")
    if not tag.type.array:
        return _known(c, c == F.lit(values[0])) if len(set(values)) == 1 else F.lit(False)
    return _true(F.size(F.array_except(F.array(*[F.lit(v) for v in values]).cast(tag.type.spark), c)) == 0)


def _leaf(c: Cond, r: Resource, row_filter: bool) -> Column:
    tag = r.tag(c.name)
    if tag is None:
        raise RequestError(f"{r.name} has no tag {c.name}")
    name = F.col(f"`{tag.name}`")
    if c.op in ("EQ", "NE"):
        e = _equal(tag, c.value)
        return e if c.op == "EQ" else ~e
    if c.op in RANGES:
        if tag.type.array:
            raise RequestError(f"{c.op} does not apply to the array {tag.name}")
        v = _literal(tag, c.value)
        return F.lit(False) if v is None else _known(name, RANGES[c.op](name, F.lit(v)))
    if c.op in ("IN", "NOT_IN"):
        if tag.type.array:
            raise RequestError(f"IN does not apply to the array {tag.name}")
        values = [v for v in _values(tag, c.value) if v is not None]
        e = _known(name, name.isin(values)) if values else F.lit(False)
        return e if c.op == "IN" else ~e
    if c.op in ("HAVING", "NOT_HAVING"):
        e = _contains(tag, c.value)
        return e if c.op == "HAVING" else ~e
    if c.op == "MATCH":
        if tag.type is not Type.STRING:
            raise RequestError(f"MATCH needs a STRING tag; {tag.name} is {tag.type.value}")
        rule = next((x for x in r.rules if tag.name in x.tags and x.analyzer), None)
        analyzer = (c.match and c.match.analyzer) or (rule.analyzer if rule else "keyword")
        values = [str(v) for v in (c.value if isinstance(c.value, (list, tuple)) else [c.value])]
        return match(name, values, analyzer, c.match.operator if c.match else "AND", row_filter)
    raise RequestError(f"unknown condition {c.op}")


def compile_criteria(c: Criteria | None, r: Resource, skip: Callable[[Cond], bool] = lambda c: False) -> Column | None:
    """One boolean column, never null; None if nothing is asked.

    A missing side of AND or OR leaves the other one; both missing is an error.
    """
    if c is None:
        return None
    if isinstance(c, Cond):
        return None if skip(c) else _leaf(c, r, r.kind is Kind.STREAM)
    if c.left is None and c.right is None:
        raise RequestError("a logical expression needs a side")
    sides = [x for x in (compile_criteria(c.left, r, skip), compile_criteria(c.right, r, skip)) if x is not None]
    if not sides:
        return None
    return reduce((lambda a, b: a & b) if isinstance(c, And) else (lambda a, b: a | b), sides)


def check_measure(c: Criteria | None, r: Resource) -> None:
    """Every non-entity tag in the criteria needs an index rule; indexed terms are single values."""
    for x in conditions(c):
        tag = r.tag(x.name)
        if tag is None:
            raise RequestError(f"{r.name} has no tag {x.name}")
        if not r.indexed(tag.name) and tag.name not in r.entity:
            raise RequestError(f"tag {tag.name} of measure {r.name} is not indexed")
        if x.op in ("EQ", "NE", "LT", "LE", "GT", "GE") and (x.value is None or isinstance(x.value, (list, tuple))):
            raise RequestError(f"{x.op} on the indexed tag {tag.name} needs one value that is not null")


def check_stream(c: Criteria | None, r: Resource) -> None:
    for x in conditions(c):
        tag = r.tag(x.name)
        if tag and tag.name in r.entity and x.op not in ("EQ", "IN"):
            raise RequestError(f"entity tag {tag.name} of stream {r.name} takes = and IN only")


def trace_ids(c: Criteria | None, r: Resource) -> list[str] | None:
    """Trace ids that EQ and IN conditions name; None without such a condition."""
    found: set[str] | None = None
    for x in conditions(c):
        if x.name == r.trace_id and x.op in ("EQ", "IN"):
            own = {str(v) for v in (x.value if isinstance(x.value, (list, tuple)) else [x.value])}
            found = own if found is None else found & own
    if found is not None and has_or(c):
        raise RequestError("a trace id condition does not combine with OR")
    return None if found is None else sorted(found)
