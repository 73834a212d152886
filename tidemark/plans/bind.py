"""Statement and parameters -> typed request, checked against the catalog."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from ..catalog import Catalog, Kind, Resource, Type, merged
from ..errors import RequestError
from ..functions.timeparse import time_range
from ..model import And, Cond, Criteria, Match, MeasureQuery, Or, Order, PropertyQuery, Request, StreamQuery, Top, TopNQuery, TraceQuery
from .ql import Logical, Param, Predicate, Statement, parse

#: The largest counts of the positions.
MOST_ROWS, MOST_TOP = 2**32 - 1, 2**31 - 1


@dataclass
class Bound:
    """A statement with its parameters."""

    s: Statement
    params: Sequence[object] = ()
    now: datetime | None = None

    def __post_init__(self) -> None:
        if len(self.params) != self.s.params:
            raise RequestError(f"the query has {self.s.params} parameters, {len(self.params)} were given")
        for i, p in enumerate(self.params):
            if isinstance(p, (bytes, bytearray)):
                raise RequestError(f"parameter {i + 1}: bytes are not accepted")
            if isinstance(p, (list, tuple)) and (not p or any(x is None for x in p)):
                raise RequestError(f"parameter {i + 1}: an array needs values")

    def scalar(self, v: object) -> object:
        if not isinstance(v, Param):
            return v
        p = self.params[v.index]
        if isinstance(p, (list, tuple, datetime)) or isinstance(p, bool):
            raise RequestError(f"parameter {v.index + 1}: {type(p).__name__} is not accepted here")
        return p

    def listed(self, values: list) -> list:
        """Array parameters expand in place."""
        out: list = []
        for v in values:
            p = self.params[v.index] if isinstance(v, Param) else None
            if isinstance(p, (list, tuple)):
                out += p
            else:
                out.append(self.scalar(v))
        return out

    def count(self, v: object, most: int, default: int = 0) -> int:
        if v is None:
            return default
        n = self.scalar(v)
        if not isinstance(n, int) or not 0 <= n <= most:
            raise RequestError(f"a count from 0 to {most} is needed, not {n!r}")
        return n

    def moment(self, v: object) -> object:
        if isinstance(v, Param):
            p = self.params[v.index]
            if not isinstance(p, (str, datetime)):
                raise RequestError(f"parameter {v.index + 1}: a time is text or a timestamp")
            return p
        return v


def _criteria(e: object, b: Bound, r: Resource) -> Criteria | None:
    if e is None:
        return None
    if isinstance(e, Logical):
        return (And if e.op == "AND" else Or)(_criteria(e.left, b, r), _criteria(e.right, b, r))
    assert isinstance(e, Predicate)
    tag = r.tag(e.name)
    if tag is None and not (r.kind is Kind.PROPERTY and e.name == "id"):
        raise RequestError(f"{r.name} has no tag {e.name}")
    if tag and tag.type in (Type.TIMESTAMP, Type.DATA_BINARY):
        raise RequestError(f"{e.name} is {tag.type.value}, which conditions don't take")
    name = tag.name if tag else e.name
    if e.op == "MATCH":
        operator = (e.operator or "AND").upper()
        if operator not in ("AND", "OR"):
            raise RequestError(f"MATCH combines by AND or OR, not {e.operator}")
        return Cond(name, "MATCH", [str(v) for v in b.listed(e.values)], Match(e.analyzer, operator))
    if e.op in ("IN", "NOT_IN"):
        values = b.listed(e.values)
        if any(v is None for v in values):
            raise RequestError(f"{e.name}: NULL is not accepted in a list")
        return Cond(name, e.op, values)
    if e.op in ("HAVING", "NOT_HAVING"):
        return Cond(name, e.op, b.listed(e.values))
    return Cond(name, e.op, b.scalar(e.values[0]))


def _range(b: Bound) -> tuple[datetime | None, datetime | None]:
    if b.s.time is None:
        return None, None
    op, begin, end = b.s.time
    return time_range(op, b.moment(begin), b.moment(end), b.now)


def _split(s: Statement, r: Resource) -> tuple[tuple[str, ...] | None, tuple[str, ...] | None]:
    """The asked tags and fields, in order; None for all."""
    if s.star:
        return None, None
    tags, fields = [], []
    for c in s.columns:
        if c.function:
            continue
        tag, f = r.tag(c.name), r.field_(c.name)
        if c.spec == "TAG" or (c.spec is None and tag and not f):
            if not tag:
                raise RequestError(f"{r.name} has no tag {c.name}")
            tags.append(tag.name)
        elif c.spec == "FIELD" or (c.spec is None and f and not tag):
            if not f:
                raise RequestError(f"{r.name} has no field {c.name}")
            fields.append(f.name)
        elif tag and f:
            raise RequestError(f"{c.name} is a tag and a field; add ::TAG or ::FIELD")
        else:
            raise RequestError(f"{r.name} has no column {c.name}")
    return tuple(tags), tuple(fields)


def _order(s: Statement) -> Order | None:
    return None if s.order is None else Order(s.order[0], s.order[1] == "DESC")


def request(text: str, catalog: Catalog, params: Sequence[object] = (), now: datetime | None = None) -> Request:
    s = parse(text)
    b = Bound(s, params, now)
    kind = Kind(s.kind)
    begin, end = _range(b)
    common = {"groups": s.groups, "name": s.name, "begin": begin, "end": end, "stages": s.stages, "explain": s.trace}
    if s.show_top is not None:
        return _ranking(s, b, kind, catalog, common)
    r, _ = merged([catalog.get(kind, g, s.name) for g in s.groups])
    common |= {"criteria": _criteria(s.where, b, r), "order": _order(s), "limit": b.count(s.limit, MOST_ROWS), "offset": b.count(s.offset, MOST_ROWS)}
    tags, fields = _split(s, r)
    if kind is not Kind.MEASURE:
        for wrong, what in ((any(c.function for c in s.columns), "aggregates"), (s.group_by, "GROUP BY"), (s.top, "TOP"), (fields, "fields")):
            if wrong:
                raise RequestError(f"a {kind.value.lower()} query has no {what}")
    if s.empty:
        if kind is not Kind.TRACE:
            raise RequestError("only a trace query may ask for no columns")
        tags = ()
    if kind is Kind.STREAM:
        return StreamQuery(tags=tags, **common)
    if kind is Kind.TRACE:
        return TraceQuery(tags=tags, **common)
    if kind is Kind.PROPERTY:
        if s.time:
            raise RequestError("a property query has no TIME")
        ids, rest = _ids(common["criteria"])
        return PropertyQuery(tags=tags, ids=ids, **(common | {"criteria": rest}))
    return _measure(s, b, r, tags, fields, common)


def _measure(s: Statement, b: Bound, r: Resource, tags, fields, common: dict) -> MeasureQuery:
    calls = [c for c in s.columns if c.function]
    if len(calls) > 1:
        raise RequestError("a query has one aggregate")
    keys, field = [], None
    for c in s.group_by:
        tag, f = r.tag(c.name), r.field_(c.name)
        if c.spec != "FIELD" and tag and not (c.spec is None and f):
            keys.append(tag.name)
        elif c.spec != "TAG" and f and not (c.spec is None and tag):
            if field:
                raise RequestError("GROUP BY takes one field")
            field = f.name
        else:
            raise RequestError(f"GROUP BY {c.name}: no such column, or it needs ::TAG or ::FIELD")
    aggregate = (calls[0].function, calls[0].name) if calls else None
    if aggregate and s.group_by and field != aggregate[1]:
        raise RequestError(f"GROUP BY must list the aggregated field {aggregate[1]}")
    top = None
    if s.top:
        n, name, direction = s.top
        if not r.field_(name):
            raise RequestError(f"{r.name} has no field {name}")
        # Without a direction, the text form means ascending.
        top = Top(b.count(n, MOST_TOP), name, direction == "DESC")
        fields = fields if fields is None or name in fields or aggregate else (*fields, name)
    return MeasureQuery(tags=tags, fields=fields, group_by=tuple(keys) or None, group_field=field, aggregate=aggregate, top=top, **common)


def _ranking(s: Statement, b: Bound, kind: Kind, catalog: Catalog, common: dict) -> TopNQuery:
    if kind is not Kind.MEASURE:
        raise RequestError("SHOW TOP reads a measure's ranking")
    conds: list[Cond] = []

    def walk(e: object) -> None:
        if isinstance(e, Logical):
            if e.op != "AND":
                raise RequestError("SHOW TOP combines conditions by AND")
            walk(e.left)
            walk(e.right)
        elif isinstance(e, Predicate):
            conds.append(Cond(e.name, e.op, b.scalar(e.values[0]) if not e.listed else b.listed(e.values)))

    walk(s.where)
    if s.order is None:
        raise RequestError("SHOW TOP needs ORDER BY")
    return TopNQuery(n=b.count(s.show_top, MOST_TOP), desc=s.order[1] == "DESC", aggregate=s.aggregate_by, conditions=tuple(conds), **common)


def _ids(c: Criteria | None) -> tuple[tuple[str, ...], Criteria | None]:
    """Ids that AND-ed conditions on id name, and what is left."""
    if isinstance(c, Cond) and c.name == "id":
        if c.op not in ("EQ", "IN"):
            raise RequestError("id takes = and IN only")
        return tuple(str(v) for v in (c.value if isinstance(c.value, list) else [c.value])), None
    if isinstance(c, And):
        (a, left), (b, right) = _ids(c.left), _ids(c.right)
        ids = tuple(x for x in a if x in b) if a and b else a or b
        if a and b and not ids:
            ids = ("",)  # contradictory: no id is empty
        return ids, And(left, right) if left and right else left or right
    if isinstance(c, Or) and any(x.name == "id" for x in _leaves(c)):
        raise RequestError("a condition on id does not combine with OR")
    return (), c


def _leaves(c):
    from ..operators.predicates import conditions

    return conditions(c)


class Prepared:
    """A parsed statement to run again with other parameters."""

    def __init__(self, text: str):
        self.text, self.params = text, parse(text).params

    def bind(self, catalog: Catalog, *params: object, now: datetime | None = None) -> Request:
        return request(self.text, catalog, params, now)
