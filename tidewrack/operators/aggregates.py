"""Counts, bands and top lists. Every order has an explicit last key, so ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions.dates import year_of


def entity_counts(df: DataFrame, kinds: dict[str, Column], first: Column | None = None) -> DataFrame:
    """(kind, id, n, first): how often each entity is mentioned, all kinds in one pass over
    ``df``; first is the least value of ``first``, where ties in n are settled."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("id")) for k, c in kinds.items()])
    seen = df.select(F.explode(entries).alias("e"), (F.lit(0) if first is None else first).alias("first")).select("e.*", "first")
    return seen.where("id is not null").groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))


def ref_counts(items: DataFrame, person: str | None = None) -> DataFrame:
    """(kind, id, n) over the references of people, places and themes; with a person, places
    only where they are attested to have been. Occurrences count, not items."""
    parts = None
    for kind in ("people", "places", "themes"):
        one = items.select(F.lit(kind).alias("kind"), F.explode(kind).alias("r"))
        if person is not None and kind == "places":
            one = one.where(F.coalesce(F.array_contains("r.people", person), F.lit(False)))
        one = one.select("kind", F.col("r.id").alias("id"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"))


def top_counts(counts: DataFrame, group: list[str], limit: int = 12, n: str = "n", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """The ``limit`` highest of each group with their rank; Spark keeps only ``limit`` rows of
    a group per task before the exchange."""
    w = Window.partitionBy(*group).orderBy(F.col(n).desc(), *[F.col(c) for c in tie])
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def decade_bands(df: DataFrame, date, members: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """(decade, n) and the members in order, newest first; rows without a year are left out."""
    banded = df.withColumn("decade", decade(year_of(date))).where("decade is not null")
    out = [F.count(F.lit(1)).alias("n")]
    if members:
        out.append(F.transform(F.array_sort(F.collect_list(F.struct(*order, members))), lambda x: x[members]).alias("members"))
    return banded.groupBy("decade").agg(*out).orderBy(F.desc("decade"))


def band_heads(df: DataFrame, band: str, order: list[str], cap: int = 8) -> DataFrame:
    """The first ``cap`` rows of each band, with how many more it has."""
    w = Window.partitionBy(band).orderBy(*order)
    total = df.groupBy(band).agg(F.greatest(F.lit(0), F.count(F.lit(1)) - cap).alias("remainder"))
    heads = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)
    return heads.join(total, band)


def zero_filled(dim: DataFrame, key: str, counts: DataFrame, n: str = "n") -> DataFrame:
    """Every member of the dimension with its count, 0 where it has none."""
    return dim.join(counts.select(key, n), key, "left").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))


def heat(counts: DataFrame, n: str = "n", low: float = 0.2) -> DataFrame:
    """Intensity 0.2 to 1 by share of the highest count, which is 1 at least. The highest is
    one row, joined to all."""
    top = counts.agg(F.greatest(F.lit(1).cast("long"), F.max(n)).alias("most"))
    return counts.crossJoin(F.broadcast(top)).withColumn("intensity", low + (1 - low) * F.col(n) / F.col("most"))


def pin_radius(ring: Column, n: Column, most: Column) -> Column:
    return ring * (2 + 6 * n / most)


def people_at_places(items: DataFrame) -> DataFrame:
    """(place, person, n) from the people each place reference names."""
    at = items.select(F.explode("places").alias("p")).select(F.col("p.id").alias("place"), F.explode("p.people").alias("person"))
    return at.groupBy("place", "person").agg(F.count(F.lit(1)).alias("n"))


def dominant(df: DataFrame, group: str, value: str, first: str, least: int = 2, share: float = 0.2) -> DataFrame:
    """(group, hook): the most frequent value of each group if it comes ``least`` times and
    makes ``share`` of it; ties go to the value seen first."""
    per = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    best = per.where(F.col(value).isNotNull()).groupBy(group).agg(F.max_by(F.struct(F.col(value).alias("hook"), F.col("n").alias("hook_n")), F.struct("n", (-F.col("first")).alias("f"))).alias("b"))
    total = per.groupBy(group).agg(F.sum("n").alias("total"))
    return total.join(best, group, "left").select(group, "total", F.when(
        (F.col("b.hook_n") >= least) & (F.col("b.hook_n") >= share * F.col("total")), F.col("b.hook")).alias("hook"))


def year_range(low: Column, high: Column) -> Column:
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("–", low.cast("string"), high.cast("string")))


def degrees(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, degree): edges at each node."""
    ends = edges.select(F.explode(F.array(a, b)).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def focus(degree: DataFrame, order: str = "id") -> DataFrame:
    """One row: the node of the highest degree, the first of them by ``order``."""
    return degree.agg(F.min_by(F.struct("id", "degree"), F.struct((-F.col("degree")).alias("d"), order)).alias("x")).select("x.*")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def boundary_counters(batches: DataFrame) -> DataFrame:
    """One row: documents and those not confirmed, over all batches."""
    open_ = F.size(F.filter("boundaries", lambda b: b["status"] != "confirmed"))
    return batches.agg(F.sum(F.size("boundaries")).alias("documents"), F.sum(open_).alias("unconfirmed"))


def mean_flag(flags: Column) -> Column:
    """Mean of 0/1 flags, 0 for none."""
    return F.when(F.size(flags) > 0, F.aggregate(flags, F.lit(0.0), lambda a, x: a + x) / F.size(flags)).otherwise(F.lit(0.0))


def strong_words(tsv: Column, least: int = 60) -> Column:
    """Words (level 5) of a recogniser's table with confidence ``least`` or more."""
    rows = F.transform(F.split(tsv, "\n"), lambda r: F.split(r, "\t"))
    return F.size(F.filter(rows, lambda r: F.coalesce((F.get(r, 0) == "5") & (F.get(r, 10).try_cast("double") >= least), F.lit(False))))


def argmax(df: DataFrame, group: list[str], value: str, label: str, order: str) -> DataFrame:
    """The label of the highest value in each group, the first of equals."""
    return df.groupBy(*group).agg(F.min_by(label, F.struct((-F.col(value)).alias("v"), order)).alias(label))


def histogram(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def unique_signals(df: DataFrame, key: str, group: Column, signals: Column) -> DataFrame:
    """Rows that own no signal unseen elsewhere in their group: (key)."""
    own = df.select(F.col(key), group.alias("g"), F.explode(F.array_distinct(signals)).alias("s"))
    single = own.groupBy("g", "s").agg(F.countDistinct(key).alias("n"), F.first(key).alias(key)).where("n = 1").select(key).distinct()
    return df.select(key).distinct().join(single, key, "left_anti")


def transcripts(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("transcription", F.lit("")) != "").select("id", F.col("transcription").alias("text"))


def upper_median(values: Column) -> Column:
    """The upper of the middle values."""
    s = F.array_sort(values)
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def tall_boxes(boxes: DataFrame, page: str, height: str) -> DataFrame:
    """Boxes at least a third as high as their page's upper median."""
    mid = boxes.groupBy(page).agg(upper_median(F.collect_list(height)).alias("median"))
    return boxes.join(mid, page).where(F.col(height) * 3 >= F.col("median")).drop("median")


def decision_tally(decisions: DataFrame, kinds: tuple[str, ...] = ("confirm", "estimate", "reject", "skip")) -> DataFrame:
    return decisions.agg(*[F.count_if(F.col("decision") == k).alias(k) for k in kinds])


def once(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("x"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns])
