"""Typed requests, one class for each data model."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Match:
    """Full-text options of a MATCH condition."""

    analyzer: str | None = None
    operator: str = "AND"


@dataclass(frozen=True)
class Cond:
    """A comparison.  op: EQ NE LT LE GT GE IN NOT_IN HAVING NOT_HAVING MATCH."""

    name: str
    op: str
    value: object
    match: Match | None = None


@dataclass(frozen=True)
class And:
    left: object | None
    right: object | None


@dataclass(frozen=True)
class Or:
    left: object | None
    right: object | None


Criteria = Cond | And | Or


@dataclass(frozen=True)
class Order:
    """by: an index rule (stream, measure, trace), a tag (property), or None for time."""

    by: str | None = None
    desc: bool = False


@dataclass(frozen=True)
class Top:
    n: int
    field: str
    desc: bool = True


@dataclass(frozen=True)
class Request:
    groups: tuple[str, ...]
    name: str
    begin: datetime | None = None
    end: datetime | None = None
    criteria: Criteria | None = None
    order: Order | None = None
    offset: int = 0
    limit: int = 0  # 0: the model's default
    stages: tuple[str, ...] = ()
    explain: bool = False


@dataclass(frozen=True)
class MeasureQuery(Request):
    tags: tuple[str, ...] | None = None  # None: all
    fields: tuple[str, ...] | None = None
    group_by: tuple[str, ...] | None = None
    group_field: str | None = None
    aggregate: tuple[str, str] | None = None  # (function, field)
    top: Top | None = None


@dataclass(frozen=True)
class StreamQuery(Request):
    tags: tuple[str, ...] | None = None


@dataclass(frozen=True)
class TraceQuery(Request):
    tags: tuple[str, ...] | None = None
    exact_time: bool = False


@dataclass(frozen=True)
class PropertyQuery(Request):
    tags: tuple[str, ...] | None = None
    ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class TopNQuery(Request):
    n: int = 10
    desc: bool | None = None
    aggregate: str | None = None
    conditions: tuple[Cond, ...] = field(default=())
