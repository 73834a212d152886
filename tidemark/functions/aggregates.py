"""The five aggregates, whole and in partial and final form.

Results keep the type of their field: a count of a FLOAT is a FLOAT, a mean of an INT an INT that
truncates toward zero.  A mean is at least 1; a mean of nothing is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import Field, Type
from ..errors import RequestError

FUNCTIONS = ("SUM", "COUNT", "MAX", "MIN", "MEAN")
#: What MAX and MIN give for a group without values under strict parity.
_LEAST = {Type.INT: -(2**63), Type.FLOAT: -1.7976931348623157e308}
_MOST = {Type.INT: 2**63 - 1, Type.FLOAT: 1.7976931348623157e308}


def numeric(f: Field | None, name: str) -> Field:
    if f is None:
        raise RequestError(f"no field {name}")
    if f.type not in (Type.INT, Type.FLOAT):
        raise RequestError(f"field {name} is {f.type.value}; INT or FLOAT is needed")
    return f


def mean(total: Column, count: Column, type_: Type) -> Column:
    if type_ is Type.INT:
        value = F.greatest(F.lit(1).cast("long"), _div(total, count))
        return F.when(count == 0, F.lit(0).cast("long")).otherwise(value)
    return F.when(count == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), total / count))


def _div(total: Column, count: Column) -> Column:
    """Integer division that truncates toward zero; null for a zero divisor, and exact at 64 bits."""
    return F.call_function("div", total, F.nullif(count, F.lit(0).cast("long")))


def aggregate(function: str, f: Field, strict: bool = False) -> Column:
    c, t = F.col(f"`{f.name}`"), f.type
    if function == "SUM":
        return F.coalesce(F.sum(c), F.lit(0)).cast(t.spark)
    if function == "COUNT":
        return F.count(c).cast(t.spark)
    if function in ("MAX", "MIN"):
        out = F.max(c) if function == "MAX" else F.min(c)
        return F.coalesce(out, F.lit((_LEAST if function == "MAX" else _MOST)[t])).cast(t.spark) if strict else out
    if function in ("MEAN", "AVG"):
        return mean(F.sum(c), F.count(c), t)
    raise RequestError(f"unknown aggregate {function}")


def partial(function: str, f: Field) -> list[Column]:
    """What a node would send: __value, and __count where the mean needs it."""
    c = F.col(f"`{f.name}`")
    value = {"SUM": F.sum(c), "COUNT": F.count(c).cast(f.type.spark), "MAX": F.max(c), "MIN": F.min(c), "MEAN": F.sum(c)}[function]
    return [value.alias("__value"), F.count(c).alias("__count")]


def final(function: str, f: Field) -> Column:
    v, n = F.col("__value"), F.col("__count")
    if function in ("SUM", "COUNT"):
        return F.coalesce(F.sum(v), F.lit(0)).cast(f.type.spark)
    if function == "MEAN":
        return mean(F.sum(v), F.coalesce(F.sum(n), F.lit(0).cast("long")), f.type)
    return F.max(v) if function == "MAX" else F.min(v)
