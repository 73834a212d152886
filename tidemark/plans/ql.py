"""The query language: text -> statement.  Hand-written recursive descent, parsed texts are kept."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from ..errors import SyntaxFault

#: Fixed values of the language.
KEYWORDS = frozenset("SELECT SHOW TOP FROM STREAM MEASURE TRACE PROPERTY IN ON STAGES TIME BETWEEN AND OR WHERE GROUP BY ORDER ASC DESC LIMIT OFFSET WITH QUERY_TRACE MATCH HAVING NOT NULL AGGREGATE TAG FIELD SUM MEAN AVG COUNT MAX MIN".split())
AGGREGATES = frozenset({"SUM", "MEAN", "AVG", "COUNT", "MAX", "MIN"})
COMPARISONS = {"=": "EQ", "!=": "NE", "<": "LT", "<=": "LE", ">": "GT", ">=": "GE"}

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<comment>--[^\n]*)
    | (?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")
    | (?P<quoted>`[^`]+`)
    | (?P<int>-?\d+(?![\w]))
    | (?P<ident>[A-Za-z_][\w*]*(?:-[\w*]+)*)
    | (?P<op>::|!=|>=|<=|[=<>(),.*?])
    )""",
    re.X,
)


@dataclass(frozen=True)
class Param:
    """A placeholder, by position from 0."""

    index: int


@dataclass(frozen=True)
class Column:
    name: str
    spec: str | None = None  # TAG or FIELD
    function: str | None = None
    quoted: bool = False


@dataclass
class Predicate:
    name: str
    op: str
    values: list
    listed: bool = False
    analyzer: str | None = None
    operator: str | None = None


@dataclass
class Logical:
    op: str
    left: object
    right: object


@dataclass
class Statement:
    kind: str = ""
    name: str = ""
    groups: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    columns: list[Column] = field(default_factory=list)
    star: bool = False
    empty: bool = False
    top: tuple[object, str, str | None] | None = None  # (n, field, direction)
    show_top: object = None
    time: tuple[str, object, object] | None = None
    where: object = None
    group_by: list[Column] = field(default_factory=list)
    order: tuple[str | None, str | None] | None = None  # (name, direction)
    aggregate_by: str | None = None
    trace: bool = False
    limit: object = None
    offset: object = None
    params: int = 0


class _Reader:
    def __init__(self, text: str):
        self.items: list[tuple[str, str, int]] = []
        at = 0
        end = len(text.rstrip())
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxFault(f"unexpected {text[at:].lstrip()[:1]!r} at {at}")
            if m.lastgroup != "comment":
                self.items.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.at, self.params = 0, 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k][:2] if self.at + k < len(self.items) else ("end", "")

    def is_word(self, *words: str, k: int = 0) -> bool:
        kind, v = self.peek(k)
        return kind == "ident" and v.upper() in words

    def fail(self, wanted: str):
        kind, v = self.peek()
        where = f"at {self.items[self.at][2]}" if kind != "end" else "at the end"
        raise SyntaxFault(f"expected {wanted}, found {v or 'nothing'!r} {where}")

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            self.at += 1
            return self.items[self.at - 1][1].upper()
        return None

    def need(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def op(self, *ops: str) -> str | None:
        kind, v = self.peek()
        if kind == "op" and v in ops:
            self.at += 1
            return v
        return None

    def need_op(self, op: str) -> None:
        self.op(op) or self.fail(repr(op))

    def name(self) -> str:
        """A resource, group or stage."""
        kind, v = self.peek()
        if kind != "ident" or v.upper() in KEYWORDS:
            self.fail("a name")
        self.at += 1
        return v

    def names(self) -> tuple[str, ...]:
        paren = self.op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        if paren:
            self.need_op(")")
        return tuple(out)

    def path(self) -> tuple[str, bool]:
        """A column: parts joined by dots; a keyword needs company, a type or quotes."""
        kind, v = self.peek()
        if kind == "string":
            self.at += 1
            return _unquoted(v), True
        if kind == "quoted":
            self.at += 1
            return v[1:-1], True
        if kind != "ident":
            self.fail("a column")
        self.at += 1
        parts = [v]
        while self.op("."):
            if self.peek()[0] != "ident":
                self.fail("a column part")
            parts.append(self.peek()[1])
            self.at += 1
        if len(parts) == 1 and v.upper() in KEYWORDS and self.peek()[1] != "::":
            self.at -= 1
            self.fail("a column")
        return ".".join(parts), False

    def param(self) -> Param:
        self.params += 1
        return Param(self.params - 1)

    def count(self, what: str) -> object:
        kind, v = self.peek()
        if kind == "int" and not v.startswith("-"):
            self.at += 1
            return int(v)
        return self.param() if self.op("?") else self.fail(what)

    def value(self) -> object:
        kind, v = self.peek()
        if kind == "string":
            self.at += 1
            return _unquoted(v)
        if kind == "int":
            self.at += 1
            return int(v)
        if self.word("NULL"):
            return None
        return self.param() if self.op("?") else self.fail("a value")


def _unquoted(v: str) -> str:
    body = v[1:-1]
    if v[0] == "'":
        body = body.replace("''", "'")
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)


def _column(r: _Reader) -> Column:
    kind, v = r.peek()
    if kind == "ident" and v.upper() in AGGREGATES and r.peek(1)[1] == "(":
        r.at += 2
        name, quoted = r.path()
        r.need_op(")")
        return Column(name, None, "MEAN" if v.upper() == "AVG" else v.upper(), quoted)
    name, quoted = r.path()
    return Column(name, r.need("TAG", "FIELD") if r.op("::") else None, None, quoted)


def _from(r: _Reader, s: Statement) -> None:
    r.need("FROM")
    s.kind = r.need("STREAM", "MEASURE", "TRACE", "PROPERTY")
    s.name = r.name()
    r.need("IN")
    s.groups = r.names()
    if r.word("ON"):
        s.stages = r.names()
        r.need("STAGES")


def _time(r: _Reader, s: Statement) -> None:
    if not r.word("TIME"):
        return
    if r.word("BETWEEN"):
        begin = r.value()
        r.need("AND")
        s.time = ("BETWEEN", begin, r.value())
    else:
        s.time = (r.op("=", ">", "<", ">=", "<=") or r.fail("a comparison"), r.value(), None)


def _or(r: _Reader) -> object:
    left = _and(r)
    while r.word("OR"):
        left = Logical("OR", left, _and(r))
    return left


def _and(r: _Reader) -> object:
    left = _predicate(r)
    while r.word("AND"):
        left = Logical("AND", left, _predicate(r))
    return left


def _list(r: _Reader) -> list:
    out = []
    r.need_op("(")
    while not r.op(")"):
        if out:
            r.need_op(",")
        out.append(r.value())
    return out


def _predicate(r: _Reader) -> object:
    if r.op("("):
        inner = _or(r)
        r.need_op(")")
        return inner
    name, _ = r.path()
    if r.word("MATCH"):
        r.need_op("(")
        listed = r.peek()[1] == "("
        values = _list(r) if listed else [r.value()]
        options = []
        while len(options) < 2 and r.op(","):
            kind, v = r.peek()
            if kind != "string":
                r.fail("a quoted option")
            r.at += 1
            options.append(_unquoted(v))
        r.need_op(")")
        return Predicate(name, "MATCH", values, listed, *[*options, None, None][:2])
    negated = bool(r.word("NOT"))
    if r.word("IN"):
        return Predicate(name, "NOT_IN" if negated else "IN", _list(r), True)
    if r.word("HAVING"):
        listed = r.peek()[1] == "("
        return Predicate(name, "NOT_HAVING" if negated else "HAVING", _list(r) if listed else [r.value()], listed)
    if negated:
        r.fail("IN or HAVING")
    op = r.op(*COMPARISONS) or r.fail("a comparison")
    return Predicate(name, COMPARISONS[op], [r.value()])


def _tail(r: _Reader, s: Statement) -> None:
    if r.word("WITH"):
        r.need("QUERY_TRACE")
        s.trace = True


def _select(r: _Reader, s: Statement) -> None:
    if r.op("*"):
        s.star = True
    elif r.peek()[1] == "(":
        r.need_op("(")
        r.need_op(")")
        s.empty = True
    elif r.word("TOP"):
        n = r.count("a count")
        name, _ = r.path()
        s.top = (n, name, r.word("ASC", "DESC"))
        while r.op(","):
            s.columns.append(_column(r))
    else:
        s.columns.append(_column(r))
        while r.op(","):
            s.columns.append(_column(r))
    _from(r, s)
    _time(r, s)
    if r.word("WHERE"):
        s.where = _or(r)
    if r.word("GROUP"):
        r.need("BY")
        s.group_by.append(_column(r))
        while r.op(","):
            s.group_by.append(_column(r))
    if r.word("ORDER"):
        r.need("BY")
        direction = r.word("ASC", "DESC")
        if direction:
            s.order = (None, direction)
        elif r.is_word("TIME"):
            r.at += 1
            s.order = (None, r.word("ASC", "DESC") or "ASC")
        else:
            name, _ = r.path()
            s.order = (name, r.word("ASC", "DESC") or "ASC")
    _tail(r, s)
    if r.word("LIMIT"):
        s.limit = r.count("a count")
    if r.word("OFFSET"):
        s.offset = r.count("a count")


def _show(r: _Reader, s: Statement) -> None:
    r.need("TOP")
    s.show_top = r.count("a count")
    _from(r, s)
    _time(r, s)
    if r.word("WHERE"):
        s.where = _and(r)
    if r.word("AGGREGATE"):
        r.need("BY")
        f = r.need(*sorted(AGGREGATES))
        s.aggregate_by = "MEAN" if f == "AVG" else f
    if r.word("ORDER"):
        r.need("BY")
        s.order = (None, r.word("ASC", "DESC") or "ASC")
    _tail(r, s)


@lru_cache(maxsize=1024)
def parse(text: str) -> Statement:
    """The statement of a text; equal texts give one shared statement, which nobody changes."""
    r, s = _Reader(text), Statement()
    if r.need("SELECT", "SHOW") == "SELECT":
        _select(r, s)
    else:
        _show(r, s)
    if r.peek()[0] != "end":
        r.fail("the end")
    s.params = r.params
    return s
