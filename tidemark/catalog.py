"""Declared resources: groups, measures, streams, traces, properties, index rules, rankings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import RequestError


class Kind(str, Enum):
    STREAM = "STREAM"
    MEASURE = "MEASURE"
    TRACE = "TRACE"
    PROPERTY = "PROPERTY"


class Type(str, Enum):
    STRING = "STRING"
    INT = "INT"
    STRING_ARRAY = "STRING_ARRAY"
    INT_ARRAY = "INT_ARRAY"
    DATA_BINARY = "DATA_BINARY"
    TIMESTAMP = "TIMESTAMP"
    FLOAT = "FLOAT"

    @property
    def array(self) -> bool:
        return self in (Type.STRING_ARRAY, Type.INT_ARRAY)

    @property
    def spark(self) -> T.DataType:
        return {
            Type.STRING: T.StringType(),
            Type.INT: T.LongType(),
            Type.STRING_ARRAY: T.ArrayType(T.StringType()),
            Type.INT_ARRAY: T.ArrayType(T.LongType()),
            Type.DATA_BINARY: T.BinaryType(),
            Type.TIMESTAMP: T.TimestampType(),
            Type.FLOAT: T.DoubleType(),
        }[self]


@dataclass(frozen=True)
class Tag:
    name: str
    type: Type = Type.STRING
    family: str = "default"


@dataclass(frozen=True)
class Field:
    name: str
    type: Type = Type.INT


@dataclass(frozen=True)
class IndexRule:
    """Which tags are indexed.  For a trace the last tag is the order key, those before the series."""

    name: str
    tags: tuple[str, ...]
    analyzer: str | None = None
    sortable: bool = True


@dataclass(frozen=True)
class Resource:
    kind: Kind
    group: str
    name: str
    tags: tuple[Tag, ...]
    fields: tuple[Field, ...] = ()
    entity: tuple[str, ...] = ()
    rules: tuple[IndexRule, ...] = ()
    sharding_key: tuple[str, ...] = ()
    index_mode: bool = False
    #: The source never holds two versions of a point or two copies of an element: no dedup is needed.
    unique: bool = False
    element_id: str = "element_id"
    trace_id: str = "trace_id"
    span_id: str = "span_id"
    timestamp: str = "ts"
    created: datetime | None = None

    def tag(self, name: str) -> Tag | None:
        return next((t for t in self.tags if name in (t.name, f"{t.family}.{t.name}")), None)

    def field_(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def rule(self, name: str) -> IndexRule | None:
        return next((r for r in self.rules if r.name == name), None)

    def indexed(self, tag: str) -> bool:
        return any(tag in r.tags for r in self.rules)


@dataclass(frozen=True)
class Ranking:
    """A continuous ranking (TopN) over a measure."""

    group: str
    name: str
    source: str
    source_group: str
    field: str
    group_by: tuple[str, ...] = ()
    sort: str | None = None  # None: both directions are kept
    counters: int = 1000
    interval: str = "1 minute"
    criteria: object | None = None
    lru: int = 2


@dataclass(frozen=True)
class Stage:
    name: str
    ttl_days: int | None = None


@dataclass(frozen=True)
class Group:
    name: str
    kind: Kind
    segment_days: int = 1
    ttl_days: int | None = None
    stages: tuple[Stage, ...] = ()
    default_stages: tuple[str, ...] = ()


Loader = Callable[[SparkSession], DataFrame]


@dataclass
class Catalog:
    """Registered resources and where their rows come from.

    A loader gives a DataFrame with one column for each tag and field, `ts` and, by kind,
    `version` (measures), the element id (streams), ids and `span` (traces), or
    `id`, `mod_revision` and `delete_time` (properties).
    """

    groups: dict[str, Group] = field(default_factory=dict)
    resources: dict[tuple[Kind, str, str], Resource] = field(default_factory=dict)
    rankings: dict[tuple[str, str], Ranking] = field(default_factory=dict)
    loaders: dict[tuple[Kind, str, str, str | None], Loader] = field(default_factory=dict)
    revision: int = 0

    def add_group(self, group: Group) -> None:
        self.groups[group.name] = group
        self.revision += 1

    def add(self, resource: Resource, loader: Loader, stage: str | None = None) -> None:
        names = [t.name for t in resource.tags] + [f.name for f in resource.fields]
        if len(set(names)) != len(names):
            raise RequestError(f"{resource.name}: a tag and a field share a name; give one another column")
        for e in resource.entity:
            if not resource.tag(e):
                raise RequestError(f"{resource.name}: entity tag {e} is not declared")
        self.resources[resource.kind, resource.group, resource.name] = resource
        self.loaders[resource.kind, resource.group, resource.name, stage] = loader
        self.revision += 1

    def add_ranking(self, ranking: Ranking) -> None:
        self.get(Kind.MEASURE, ranking.source_group, ranking.source)
        self.rankings[ranking.group, ranking.name] = ranking
        self.revision += 1

    def drop(self, kind: Kind, group: str, name: str) -> bool:
        for key in [k for k in self.loaders if k[:3] == (kind, group, name)]:
            del self.loaders[key]
        self.revision += 1
        return self.resources.pop((kind, group, name), None) is not None

    def list(self, kind: Kind, group: str) -> list[Resource]:
        return [r for (k, g, _), r in sorted(self.resources.items()) if (k, g) == (kind, group)]

    def get(self, kind: Kind, group: str, name: str) -> Resource:
        try:
            return self.resources[kind, group, name]
        except KeyError:
            raise RequestError(f"no {kind.value.lower()} {name} in group {group}") from None

    def bind(self, kind: Kind, group: str, name: str, *rules: IndexRule) -> Resource:
        """Index rule binding: the rules from now on apply to the resource."""
        r = self.get(kind, group, name)
        r = replace(r, rules=tuple({x.name: x for x in (*r.rules, *rules)}.values()))
        self.resources[kind, group, name] = r
        self.revision += 1
        return r

    def frame(self, spark: SparkSession, r: Resource, stages: tuple[str, ...] = ()) -> DataFrame:
        """Rows of the selected stages; the group's default stages, or all, if none are selected."""
        have = {s: f for (k, g, n, s), f in self.loaders.items() if (k, g, n) == (r.kind, r.group, r.name)}
        wanted = stages or self.groups.get(r.group, Group(r.group, r.kind)).default_stages or tuple(have)
        chosen = [have[s] for s in wanted if s in have]
        if not chosen:
            raise RequestError(f"group {r.group} has no stage {', '.join(map(str, wanted))}")
        frames = [f(spark) for f in chosen]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out


def merged(resources: list[Resource]) -> tuple[Resource, set[str]]:
    """One schema for several groups, by name; the second value has the tags whose types conflict.

    Entities must be equal, and rules of one name must cover the same tags.
    """
    first = resources[0]
    tags: dict[str, Tag] = {}
    fields: dict[str, Field] = {}
    rules: dict[str, IndexRule] = {}
    conflicts: set[str] = set()
    for r in resources:
        if r.entity != first.entity:
            raise RequestError(f"{r.name}: groups {first.group} and {r.group} have different entities")
        for t in r.tags:
            if t.name in tags and tags[t.name].type != t.type:
                conflicts.add(t.name)
            tags.setdefault(t.name, t)
        for f in r.fields:
            if f.name in fields and fields[f.name].type != f.type:
                conflicts.add(f.name)
            fields.setdefault(f.name, f)
        for x in r.rules:
            if x.name in rules and rules[x.name].tags != x.tags:
                raise RequestError(f"index rule {x.name} covers different tags in different groups")
            rules.setdefault(x.name, x)
    tags = {n: replace(t, type=Type.STRING) if n in conflicts else t for n, t in tags.items()}
    fields = {n: replace(f, type=Type.STRING) if n in conflicts else f for n, f in fields.items()}
    return replace(first, tags=tuple(tags.values()), fields=tuple(fields.values()), rules=tuple(rules.values()), unique=len(resources) == 1 and first.unique), conflicts


def aligned(df: DataFrame, r: Resource, to: Resource, conflicts: set[str]) -> DataFrame:
    """The rows with the merged schema: missing tags are null, conflicting ones text."""
    own = {t.name for t in r.tags} | {f.name for f in r.fields}
    cols = []
    for x in (*to.tags, *to.fields):
        if x.name not in own:
            cols.append(F.lit(None).cast(x.type.spark).alias(x.name))
        elif x.name in conflicts:
            cols.append(F.col(f"`{x.name}`").cast("string").alias(x.name))
        else:
            cols.append(F.col(f"`{x.name}`"))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in {x.name for x in (*to.tags, *to.fields)}]
    return df.select(*cols, *rest)
