"""Personal data by weak supervision.

Base rules give spans that always stand. Wider rules give further candidates, and several
labelers - the base rule, a check of the value, gazetteers, words before the span, its shape -
vote on every candidate: for, against or not at all. Expectation-maximisation over the counts
of vote patterns estimates how far each labeler can be trusted, and its posteriors train a
logistic classifier of spans, which decides on the candidates that are not base.

Only counts of vote patterns go to the driver: at most four kinds times 3 to the power of the
number of labelers, whatever the corpus holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import weak
from .common import column, cut, free_name, located

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns. A match starts where the last one ended or at the start of a run of its
#: first class, so no run is scanned twice; possessive groups keep the stack flat.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Fixed patterns of the wider candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{1,7}(?![0-9.])",
    "phone": r"(?<![0-9A-Za-z+.])(?:\([0-9]{3}\) ?|00[1-9][0-9][ .-]?[0-9]{2,4}[ .-]|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must hold before a pattern is tried on it.
HINT = {("email", 0): "@", ("phone", 0): r"\+[0-9]", ("email", 1): r"[\[(]at[\])]|@"}
#: Fixed gazetteers: top-level domains, calling codes, first digits of card issuers.
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "us", "eu", "at", "ch", "it", "nl", "be", "ca", "mx", "ar")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
#: Fixed cue words before a span, for and against it.
CUES = {
    "email": r"mail|contact|kontakt|contacto|courriel|correo|write to|reach",
    "ip": r"\bip\b|address|server|host|adresse|login from|servidor|serveur",
    "card": r"card|karte|carte|tarjeta|visa|mastercard|amex|payment|kredit",
    "phone": r"phone|tel|call|fax|mobil|fon|anruf|llama|appele|whatsapp|sms",
}
AGAINST = r"version|\bv\s*$|release|isbn|issn|order|invoice|rechnung|serial|build|section|=\s*$|#\s*$|\$\s*$"
LABELERS = ("rule", "value", "gazetteer", "cue", "against", "shape")
CONTEXT = 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _matches(text: Column, pattern: str, hint: str | None) -> Column:
    """All matches as array<struct<start, end, value, before>>, in code points."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def span(m, at):
        start = at + F.length(m["b"])
        return F.struct(start.alias("start"), (start + F.length(m["v"])).alias("end"), m["v"].alias("value"), F.lower(F.right(m["b"], F.lit(CONTEXT))).alias("before"))
    pairs = F.filter(F.zip_with(between, found, lambda b, v: F.struct(b.alias("b"), v.alias("v"))), lambda m: m["v"].isNotNull())
    spans = located(pairs, lambda m: F.length(m["b"]) + F.length(m["v"]), span, "struct<start:int,end:int,value:string,before:string>")
    there = F.rlike(text, F.lit(pattern))
    if hint:
        there = (F.contains(text, F.lit(hint)) if hint == "@" else F.rlike(text, F.lit(hint))) & there
    return F.when(there, spans).otherwise(empty)


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return F.rlike(value, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(value))).otherwise(F.lit(False))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, base: bool, m: Column) -> Column:
    """Votes of LABELERS on a candidate, -1, 0 or 1 each."""
    value, before = m["value"], m["before"]
    digits = _digits(value)
    vote = lambda c, yes=1, no=-1: F.when(c, F.lit(yes)).otherwise(F.lit(no))
    plain = F.regexp_replace(F.regexp_replace(value, r" ?[\[(]at[\])] ?", "@"), r" ?[\[(]dot[\])] ?", ".")
    if kind == "email":
        good = vote(F.rlike(plain, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}$")))
        listed = vote(F.lower(F.regexp_extract(plain, r"([A-Za-z]+)$", 1)).isin(*TLDS))
        shape = vote(F.length(value) > 80, -1, 0)
    elif kind == "ip":
        good = vote(F.rlike(value, F.lit(r"^(?!0\.)(?!.*\.0[0-9])")))
        listed = vote(F.rlike(value, F.lit(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")), 1, 0)
        shape = vote(F.rlike(value, F.lit(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$")), -1, 0)
    elif kind == "card":
        good = vote(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        listed = vote(F.rlike(digits, F.lit("^[3-6]")))
        shape = vote(F.rlike(digits, F.lit(r"^([0-9])\1*$")), -1, 0)
    else:
        good = vote(F.length(digits).between(9, 15))
        listed = vote(F.rlike(value, F.lit(r"^(?:\+|00)(?:" + "|".join(CALLING) + ")")), 1, 0)
        shape = vote(F.rlike(digits, F.lit(r"([0-9])\1{5}")), -1, 0)
    return F.array(F.lit(1 if base else -1), good, listed, vote(F.rlike(before, F.lit(CUES[kind])), 1, 0),
                   vote(F.rlike(before, F.lit(AGAINST)), -1, 0), shape)


def candidates(text: Column) -> list[tuple[Column, Column]]:
    """For each kind two arrays of struct<kind, start, end, value, base, votes>: the base spans of a text and
    the wider candidates, of which the caller drops those that touch a base span. A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    for kind in KINDS:
        def spans(base: bool, rule: dict, kind=kind):
            found = _matches(text, rule[kind], HINT.get((kind, 0 if base else 1)))
            if base:
                found = F.filter(found, lambda m: _valid(kind, m["value"]))
            return F.transform(found, lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                F.lit(base).alias("base"), _votes(kind, base, m).alias("votes")))
        parts.append((spans(True, BASE), spans(False, WIDE)))
    return parts


def _candidate_columns(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the candidates, each array computed once."""
    cols = {f"{name}_{i}_{j}": c for i, two in enumerate(candidates(text)) for j, c in enumerate(two)}
    wide = df.withColumns(cols)
    joined = []
    for i in range(len(KINDS)):
        b, w = F.col(f"{name}_{i}_0"), F.col(f"{name}_{i}_1")
        free = F.when(F.size(w) > 0, F.filter(w, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))).otherwise(w)
        joined += [b, free]
    return wide.withColumn(name, F.concat(*joined)).drop(*cols)


@dataclass(frozen=True)
class Model:
    """Reliabilities (per labeler: how it votes on true and on false spans) and the weights of
    the span classifier over votes and kind."""

    prior: float
    reliability: dict[str, dict[str, list[float]]]
    weights: list[float]


def _features(kind: str, votes: list[int]) -> list[float]:
    return [1.0, *[float(kind == k) for k in KINDS], *[float(v > 0) for v in votes], *[float(v < 0) for v in votes]]


def fit(patterns: list[tuple[str, tuple[int, ...], int]]) -> Model:
    """EM over (kind, votes, count), then the classifier on its posteriors. With no
    candidates at all, the weights start from the votes alone."""
    n = len(LABELERS)
    merged: dict[tuple[int, ...], int] = {}
    for _, votes, c in patterns:
        merged[votes] = merged.get(votes, 0) + c
    prior, like, post = weak.estimate(sorted(merged.items()), [weak.EITHER_WAY] * n)
    w = [0.0] * (1 + len(KINDS) + 2 * n)
    rows = [(_features(k, v), post[v], c) for k, v, c in patterns]
    total = sum(c for *_, c in rows) or 1
    for _ in range(400):
        grad = [0.001 * x for x in w]
        for f, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, f))))))
            for i, x in enumerate(f):
                if x:
                    grad[i] += (p - y) * x * c / total
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return Model(prior, {name: {"true": like[1][i], "false": like[0][i]} for i, name in enumerate(LABELERS)}, w)


def score(model: Model, x: Column) -> Column:
    """The classifier's probability that a candidate is personal data."""
    n, k = len(LABELERS), len(KINDS)
    z = F.lit(model.weights[0])
    for i, kind in enumerate(KINDS):
        z = z + F.when(x["kind"] == kind, F.lit(model.weights[1 + i])).otherwise(F.lit(0.0))
    for i in range(n):
        vote = F.get(x["votes"], i)
        z = z + F.when(vote > 0, F.lit(model.weights[1 + k + i])).when(vote < 0, F.lit(model.weights[1 + k + n + i])).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, Model]:
    """A row per document with the columns ``keep`` and spans: array<struct<kind, start, end,
    value, base, score>> by kind as in KINDS, then start; code points, end exclusive.

    Null texts are empty and hold nothing. Equal rows give equal rows. The texts are read
    once; the candidates, which are few, are a table in the shared folder.
    """
    name = free_name(list(keep), "spans")
    rows = docs.select(*[column(docs, c) for c in keep], column(docs, text_col).alias("pii_text"))
    found = cut(_candidate_columns(rows, F.col("pii_text"), name).drop("pii_text"))
    votes = found.select(F.explode(name).alias("x")).groupBy("x.kind", "x.votes").agg(F.count(F.lit(1)).alias("n"))
    model = fit(sorted((r.kind, tuple(r.votes), r.n) for r in votes.collect()))
    kept = F.filter(F.transform(name, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["base"].alias("base"),
        score(model, x).alias("score"))), lambda x: x["base"] | (x["score"] >= 0.5))
    by_kind = F.concat(*[F.array_sort(of_kind(kept, k), lambda a, b: a["start"] - b["start"]) for k in KINDS])
    return found.withColumn(name, by_kind), model


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
