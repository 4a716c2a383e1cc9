"""Structure out of loose text: JSON answers, flags, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "yes", "1"), ("false", "no", "0", "")


def json_object(text: Column) -> Column:
    """What stands between the first { and the last }, if it is JSON."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def unfenced(text: Column) -> Column:
    """An answer without its code fence."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))


def parse(text: Column, ddl: str) -> Column:
    return F.from_json(json_object(unfenced(text)), ddl, {"mode": "PERMISSIVE"})


def strict_flag(text: Column) -> Column:
    """A flag that must be said: other words than true and false are null."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def line_boxes(text: Column) -> Column:
    """array<struct<index, box>>: boxes of four finite numbers; the malformed are dropped, and
    nothing left is null."""
    raw = F.from_json(text, "array<array<double>>", {"mode": "PERMISSIVE"})
    good = F.filter(F.transform(raw, lambda b, i: F.struct(i.alias("index"), b.alias("box"))), lambda x: (F.size(x["box"]) == 4) & F.forall(
        x["box"], lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.when(F.size(good) > 0, good)


def clean_list(values: Column, most: int) -> Column:
    """Trimmed, non-empty, distinct values, at most ``most``: a form field's limit."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), 1, most)
