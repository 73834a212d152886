"""Personal data by weak supervision, on built-in SQL functions only.

Candidates come from regular expressions.  Labelers (check, strict pattern, gazetteer, context words,
counter-evidence) vote for or against each, or abstain; expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability without labels.  Its posteriors train a logistic
span classifier on features of the span itself (length, share of digits, the characters beside it)
and of its context (which cues are there).  Only counts by kind, votes and features reach the driver,
at most len(KINDS) x VOTES x FEATURES rows.  Spans of the four base kinds that pass their checks
always stay.

Defined results: null and empty texts have no spans; of overlapping matches of one kind the leftmost
counts, spans of different kinds may overlap; repeated rows give repeated results; an empty table
gives an empty result and default reliabilities; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table, texts

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """One kind of span: its pattern, a cheap test that must hold for a match to exist, and the
    labelers' conditions as SQL over m (the match) and b (lower-case text before it)."""

    name: str
    pattern: str
    guard: str
    valid: str
    strict: str
    gazetteer: str
    cue: str
    against: str
    base: bool = False


#: Given names that the gazetteer of persons knows.
NAMES = "Adam Alex Alice Amelie Ana Andrea Anna Antoine Antonio Barbara Bernd Carlos Carmen Charles Charlotte Chris Claire Clara Daniel David Diego Elena Elizabeth Emily Emma Eric Eva Felix Francois Frank George Hannah Hans Heike Helen Henry Ines Isabel Jack Jakob James Jan Jane Javier Jean Jennifer John Jonas Jorge Jose Joseph Juan Julia Julien Karl Kate Katharina Klaus Laura Lea Leon Linda Lisa Louis Lucas Lucia Luis Luise Manuel Marc Marco Maria Marie Mark Markus Marta Martin Mary Matthew Max Michael Michel Miguel Nadia Nicolas Nina Olivia Oscar Pablo Patricia Paul Pedro Peter Philipp Pierre Robert Rosa Sabine Sam Sarah Sofia Sophie Stefan Steven Susan Teresa Thomas Tom Ursula Victor Walter William".split()
#: Possessive forms and look-behinds find the same leftmost matches as the plain patterns, without
#: rescanning a long run from each of its characters: a run that fails from its start fails from any
#: later point, and \\G lets a match begin where the last one ended.
KINDS: tuple[Kind, ...] = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')", "true", r"rlike(m, '^[A-Za-z0-9].*\\.[A-Za-z]{2,}$')", r"rlike(m, '(?i)\\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$')", r"rlike(b, '(?:mail|contact|write|reach|e-mail|courriel|correo)')", r"rlike(m, '\\.(?:png|jpg|gif)$')", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "contains(text, '.')", rf"rlike(m, '^{_OCTET}(?:\\.{_OCTET}){{3}}$')", r"not rlike(m, '(?:^|\\.)0[0-9]')", r"rlike(m, '^(?:10\\.|127\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.)')", r"rlike(b, '(?:\\bip\\b|host|server|address|from|client)')", r"rlike(b, '(?:version|section|release|\\bv) ?$')", True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "rlike(text, '[0-9]')", "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19 and luhn_check(regexp_replace(m, '[^0-9]', ''))", r"length(regexp_replace(m, '[^0-9]', '')) in (15, 16)", r"rlike(m, '^(?:4|5[1-5]|3[47]|6011|2[2-7])')", r"rlike(b, '(?:card|visa|master|credit|payment|karte|carte|tarjeta)')", r"rlike(b, '(?:isbn|serial|order|invoice)')", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15", r"length(regexp_replace(m, '[^0-9]', '')) between 10 and 13", r"rlike(m, '^\\+(?:1|3[0-9]|4[0-9]|7|8[16])')", r"rlike(b, '(?:call|phone|tel|mobile|fax|cell|whatsapp)')", r"rlike(m, '\\.[0-9]+\\.[0-9]+\\.')", True),
    Kind("phone_national", r"(?<![0-9+() .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "rlike(text, '[0-9]{3}[ .-][0-9]{4}')", "true", r"rlike(m, '^\\(?[2-9][0-9]{2}\\)?[ .-][2-9]')", r"rlike(m, '^\\(?(?:2(?:0[1-9]|1[0-9]|48)|3(?:0[1-9]|1[0-9])|4(?:0[1-9]|1[0-9]|15)|5(?:0[1-9]|1[0-9])|6(?:0[1-9]|1[0-9])|7(?:0[1-9]|1[0-9])|8(?:0[1-9]|1[0-9])|9(?:0[1-9]|1[0-9]))')", r"rlike(b, '(?:call|phone|tel|mobile|fax|cell|whatsapp)')", r"rlike(b, '(?:isbn|serial|order|invoice|part|model|no\\.) ?$')"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "rlike(text, '[0-9]-[0-9]{2}-[0-9]')", "true", r"not rlike(m, '^(?:000|666|9)|-00-|-0000$')", r"rlike(m, '^[0-7]')", r"rlike(b, '(?:ssn|social|security|taxpayer)')", r"rlike(b, '(?:isbn|serial|order|invoice|part|model)')"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "rlike(text, '[A-Z]{2}[0-9]{2}')", "true", r"length(replace(m, ' ', '')) between 15 and 34 and rlike(m, '[0-9]{4}')", r"rlike(m, '^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)')", r"rlike(b, '(?:iban|account|konto|compte|cuenta|bank)')", r"rlike(b, '(?:serial|order|invoice|part|model|key)')"),
    Kind("secret", r"(?i)(?<![a-z0-9_])(?:api[_-]?key|secret|token|passwo?r?d)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}+", "rlike(text, '[=:]')", "true", r"rlike(m, '[0-9a-fA-F]{32,}$|[A-Za-z0-9+/_-]{24,}$')", r"rlike(m, '(?i)^(?:token|secret|api)')", r"rlike(m, '[0-9]')", r"rlike(m, '(?i)(?:example|placeholder|changeme)')"),
    Kind("person", r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?", r"rlike(text, '(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\\.? ')", "true", r"rlike(m, '\\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+$')", r"rlike(m, ' (?:" + "|".join(NAMES) + r")\\b')", r"rlike(b, '(?:name|contact|signed|dear|with|by) ?$')", r"rlike(b, '(?:street|avenue|university|institute) ?$')"),
)
BASE = tuple(k for k in KINDS if k.base)
#: The labelers in the order of their votes, with what they say when their condition holds and when
#: it doesn't: 1 for, 0 against, - nothing.
LABELERS = {"valid": "10", "strict": "10", "gazetteer": "1-", "cue": "1-", "against": "0-"}
#: How often a labeler that speaks is right, before any data, and the weight of that belief.
PRIOR = {"valid": 0.6, "strict": 0.7, "gazetteer": 0.75, "cue": 0.85, "against": 0.9}
PRIOR_WEIGHT = 20.0
VOTES = 2 ** len(LABELERS)
#: Features as one digit each: length, share of digits, character before and after (none, white space,
#: letter or digit, other).
SHAPE = (
    "CASE WHEN length(c.m) < 10 THEN '0' WHEN length(c.m) < 16 THEN '1' WHEN length(c.m) < 32 THEN '2' ELSE '3' END",
    "cast(least(2, 3 * length(regexp_replace(c.m, '[^0-9]', '')) div greatest(1, length(c.m))) AS string)",
    *(f"CASE WHEN {c} = '' THEN '0' WHEN rlike({c}, '\\\\s') THEN '1' WHEN rlike({c}, '[\\\\p{{L}}\\\\p{{N}}]') THEN '2' ELSE '3' END" for c in ("right(c.b, 1)", "c.r")),
)
LEVELS = (4, 3, 4, 4)
FEATURES = math.prod(LEVELS)
#: What keeps the classifier's weights small.
RIDGE = 1.0
_BLOCK = 128


def _quote(s: str) -> str:
    """A SQL string literal; Spark's parser reads backslash escapes."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _candidates(df: DataFrame, kinds: Sequence[Kind]) -> DataFrame:
    """Adds c_<kind>: array of (s, e, m, b) for each match, in order.

    Matches and the pieces between them come from the same scan rule, so their lengths give the
    positions; prefix sums are taken in blocks, and blocks of blocks, to stay near linear in the
    number of matches.
    """
    keep = list(df.columns)
    for k in kinds:
        pat = _quote(k.pattern)
        df = df.select("*", F.expr(f"CASE WHEN {k.guard} THEN regexp_extract_all(text, {pat}, 0) ELSE array() END").alias("_m"))
        df = df.select("*", F.expr(f"CASE WHEN size(_m) > 0 THEN split(text, {pat}, -1) ELSE array('') END").alias("_p"))
        df = df.select("*", F.expr("transform(_m, (m, i) -> length(_p[i]) + length(m))").alias("_l"))
        df = df.select("*", F.expr(f"CASE WHEN size(_l) > {_BLOCK} THEN transform(sequence(0, (size(_l) - 1) div {_BLOCK}), j -> aggregate(slice(_l, j * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x)) ELSE array(0) END").alias("_s"))
        df = df.select("*", F.expr(f"CASE WHEN size(_s) > {_BLOCK} THEN transform(sequence(0, (size(_s) - 1) div {_BLOCK}), j -> aggregate(slice(_s, j * {_BLOCK} + 1, {_BLOCK}), 0, (a, x) -> a + x)) ELSE array(0) END").alias("_u"))
        df = df.select("*", F.expr("transform(_u, (x, j) -> aggregate(slice(_u, 1, j), 0, (a, y) -> a + y))").alias("_v"))
        df = df.select("*", F.expr(f"transform(_s, (x, j) -> _v[j div {_BLOCK}] + aggregate(slice(_s, (j div {_BLOCK}) * {_BLOCK} + 1, j % {_BLOCK}), 0, (a, y) -> a + y))").alias("_o"))
        df = df.select("*", F.expr(f"transform(_m, (m, i) -> _o[i div {_BLOCK}] + aggregate(slice(_l, (i div {_BLOCK}) * {_BLOCK} + 1, i % {_BLOCK}), 0, (a, x) -> a + x))").alias("_f"))
        df = df.select(*keep, F.expr("transform(_m, (m, i) -> named_struct('s', _f[i] + length(_p[i]), 'e', _f[i] + length(_p[i]) + length(m), 'm', m, 'b', lower(right(_p[i], 40)), 'r', left(_p[i + 1], 1)))").alias("_c"))
        said = zip(LABELERS.values(), (k.valid, k.strict, k.gazetteer, k.cue, k.against), strict=True)
        votes = ", ".join(f"CASE WHEN {_over(c)} THEN '{v[0]}' ELSE '{v[1]}' END" for v, c in said)
        # Base spans need no classifier, so their features aren't taken.
        shape = "''" if k.base else f"concat({', '.join(SHAPE)})"
        lifted = f"transform(_c, c -> named_struct('s', c.s, 'e', c.e, 'ok', {_over(k.valid)}, 'v', concat({votes}), 'f', {shape}))"
        df = df.select(*keep, F.expr(lifted).alias(f"c_{k.name}"))
        keep.append(f"c_{k.name}")
    return df


def _over(condition: str) -> str:
    """A labeler's condition with m and b read from the lambda variable c."""
    return re.sub(r"(?<=\()(m|b)(?=,)", r"c.\1", condition)


def found(docs: DataFrame, *more: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The candidates of every text, written once as a table in the shared folder and read again:
    both the counts of votes and the final spans come from it, so texts are scanned once."""
    path = fresh_path(docs.sparkSession, "pii")
    df = _candidates(texts(docs, *more, text=text), KINDS)
    (df if keep_text else df.drop("text")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


Counts = dict[tuple[str, str, str], int]
Model = dict[str, np.ndarray]


def vote_counts(candidates: DataFrame) -> Counts:
    """How often each (kind, votes, features) occurs in all texts: a table of bounded size."""
    each = F.concat(*[F.expr(f"transform(c_{k.name}, c -> concat('{k.name}:', c.v, ':', c.f))") for k in KINDS])
    rows = candidates.select(F.explode(each).alias("p")).groupBy("p").count().collect()
    return {tuple(r["p"].split(":")): r["count"] for r in rows}


def reliabilities(votes: dict[str, int], rounds: int = 50) -> tuple[list[float], dict[str, float]]:
    """How often each labeler is right when it speaks, and the posterior of each vote pattern.

    EM on a model of independent labelers; silence says nothing.  Beta priors keep reliabilities off
    0 and 1.
    """
    total = sum(votes.values())
    prior = list(PRIOR.values())
    share, right = 0.5, list(prior)
    post: dict[str, float] = {}
    for _ in range(rounds):
        for v in votes:
            odds = math.log(share / (1 - share))
            odds += sum(math.log(r / (1 - r)) * (1 if x == "1" else -1) for r, x in zip(right, v, strict=True) if x != "-")
            post[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        yes = sum(n * post[v] for v, n in votes.items())
        share = (yes + PRIOR_WEIGHT / 2) / (total + PRIOR_WEIGHT)
        for j, p in enumerate(prior):
            spoke = sum(n for v, n in votes.items() if v[j] != "-")
            agreed = sum(n * (post[v] if v[j] == "1" else 1 - post[v]) for v, n in votes.items() if v[j] != "-")
            right[j] = (agreed + PRIOR_WEIGHT * p) / (spoke + PRIOR_WEIGHT)
    return right, post


def _inputs(votes: str, shape: str) -> np.ndarray:
    """The classifier's inputs: a constant, what each labeler found, and each level of each feature."""
    x = [1.0, *(float(v == said[0]) for v, said in zip(votes, LABELERS.values(), strict=True))]
    for digit, levels in zip(shape, LEVELS, strict=True):
        x += [float(int(digit) == k) for k in range(levels)]
    return np.array(x)


def fit(counts: Counts) -> Model:
    """kind -> weights of the span classifier, by Newton steps on the posteriors, with a ridge.

    Without candidates of a kind all weights are 0, and nothing is accepted.
    """
    out = {}
    for kind in KINDS:
        rows = sorted((v, f, n) for (k, v, f), n in counts.items() if k == kind.name)
        if kind.base or not rows:
            out[kind.name] = np.zeros(1 + len(LABELERS) + sum(LEVELS))
            continue
        votes: dict[str, int] = {}
        for v, _, n in rows:
            votes[v] = votes.get(v, 0) + n
        _, post = reliabilities(votes)
        x = np.array([_inputs(v, f) for v, f, _ in rows])
        y, n = np.array([post[v] for v, _, _ in rows]), np.array([float(n) for _, _, n in rows])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - RIDGE * w
            w = w + np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        out[kind.name] = w
    return out


def _accepted(kind: Kind, model: Model) -> Column:
    """Spans of a kind that stay: valid base matches, and others that the classifier takes."""
    c = F.col(f"c_{kind.name}")
    if kind.base:
        return F.filter(c, lambda x: x["ok"])
    w = iter(model[kind.name].tolist())
    bias = next(w)
    tests = [("v", i + 1, said[0]) for i, said in enumerate(LABELERS.values())]
    tests += [("f", i + 1, str(k)) for i, levels in enumerate(LEVELS) for k in range(levels)]
    terms = list(zip(tests, w, strict=True))
    return F.filter(c, lambda x: sum((F.when(F.substring(x[a], i, 1) == is_, weight).otherwise(0.0) for (a, i, is_), weight in terms), F.lit(bias)) > 0)


def spans(candidates: DataFrame, model: Model | None = None) -> DataFrame:
    """k_<kind> in place of c_<kind>: array of (s, e) of the spans that stay, by code points."""
    model = model or fit(vote_counts(candidates))
    rest = [c for c in candidates.columns if c not in {f"c_{k.name}" for k in KINDS}]
    return candidates.select(*rest, *[F.transform(_accepted(k, model), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(f"k_{k.name}") for k in KINDS])


def _joined(kinds: Sequence[Kind]) -> Column:
    """kind:start:end of all kinds; concat_ws of empty lists would leave stray commas."""
    parts = F.flatten(F.array(*[F.expr(f"transform(k_{k.name}, x -> concat_ws(':', '{k.name}', cast(x.s as string), cast(x.e as string)))") for k in kinds]))
    return F.concat_ws(",", parts)


def digest(docs: DataFrame) -> DataFrame:
    df = spans(found(docs, "doc_id"))
    counts = {k.name: F.size(f"k_{k.name}").cast("long") for k in KINDS}
    base = F.sha2(_joined(BASE), 256).alias("base_sha256")
    more = [counts[k.name].alias(f"n_{k.name}") for k in KINDS if not k.base]
    return df.select("doc_id", *[counts[k.name].alias(f"n_{k.name}") for k in BASE], base, _joined(KINDS).alias("spans"), *more, sum(counts.values(), F.lit(0).cast("long")).alias("n_spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns; each accepted span becomes <KIND>, overlapping spans one mark (the first kind).

    Null texts stay null.
    """
    cols = docs.columns
    rest = F.struct(F.col(f"`{text}`").isNull().alias("_null"), *[F.col(f"`{c}`") for c in cols if c != text])
    df = docs.select(rest.alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    df = spans(found(df, "_row", keep_text=True))
    every = F.array_sort(F.flatten(F.array(*[F.expr(f"transform(k_{k.name}, x -> named_struct('s', x.s, 'e', x.e, 'k', {i}))") for i, k in enumerate(KINDS)])))
    df = df.select("_row", "text", every.alias("_a"))
    # Runs of overlapping spans: a span opens a run if it starts at or after the furthest end so far.
    df = df.select("_row", "text", F.expr("aggregate(_a, named_struct('p', 0, 'o', cast(array() as array<string>)), (t, x) -> CASE WHEN x.s >= t.p THEN named_struct('p', x.e, 'o', concat(t.o, array(substring(text, t.p + 1, x.s - t.p), element_at(array(" + ", ".join(f"'<{k.name.upper()}>'" for k in KINDS) + "), x.k + 1)))) ELSE named_struct('p', greatest(t.p, x.e), 'o', t.o) END)").alias("_t"))
    new = F.when(F.size("_t.o") == 0, F.col("text")).otherwise(F.concat(F.array_join("_t.o", ""), F.expr("substring(text, _t.p + 1)")))
    df = df.select("_row", F.when(~F.col("_row._null"), new).alias("_new"))
    return df.select(*[(F.col("_new") if c == text else F.length("_new").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
