"""Full-text analyzers as column expressions: text -> array of tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import RequestError

#: What splits tokens, and whether case is folded, by analyzer.
ANALYZERS = {
    "keyword": (None, False),
    "simple": (r"[^\p{L}]+", True),
    "standard": (r"[^\p{L}\p{N}_]+", True),
    "url": (r"[^\p{L}\p{N}]+", False),
}


def tokens(text: Column, analyzer: str) -> Column:
    """Non-empty tokens of a text; null for null."""
    if analyzer not in ANALYZERS:
        raise RequestError(f"unknown analyzer {analyzer!r}")
    split, fold = ANALYZERS[analyzer]
    if split is None:
        return F.when(text.isNotNull(), F.array(text))
    return F.filter(F.split(F.lower(text) if fold else text, split), lambda t: t != "")


def match(text: Column, values: list[str], analyzer: str, operator: str, every_token: bool) -> Column:
    """Whether a text matches the query values.

    Inside one value any token suffices, unless every_token (stream rows must hold all of a
    value's tokens); several values are combined by the operator.
    """
    own = tokens(text, analyzer)
    plain = F.lower(text) if ANALYZERS[analyzer][1] else text
    each = []
    for v in values:
        asked = tokens(F.lit(str(v)), analyzer)
        # A token is part of its text: texts without it needn't be split.
        if every_token:
            found = F.forall(asked, lambda t: plain.contains(t)) & (F.size(F.array_except(asked, own)) == 0)
        else:
            found = F.exists(asked, lambda t: plain.contains(t)) & F.arrays_overlap(asked, own)
        each.append(F.coalesce(found & (F.size(asked) > 0), F.lit(False)))
    out = each[0]
    for e in each[1:]:
        out = out & e if operator == "AND" else out | e
    return out
