"""Operators over order: periods, documents, attempts, moments, line boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions.dates import month_day_distance, year_of


def period_starts(years: DataFrame, target: int = 20) -> DataFrame:
    """(year, n, bucket, chunked) from (year, n): years in order are packed into buckets of
    at most ``target`` entries; a year above it stands alone and is cut into chunks.

    The fold depends on the bucket it is filling, which no window sum expresses. It runs over
    one array with an element per year, so its size is bounded by the calendar, not the data.
    """
    zero = F.struct(F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<year:int,n:bigint,bucket:int,chunked:boolean>>").alias("out"))

    def step(a, x):
        big = x["n"] > target
        opens = big | (a["held"] + x["n"] > target) | (a["held"] == 0)
        bucket = a["bucket"] + opens.cast("int")
        # after a year that stands alone the next one opens a bucket of its own
        held = F.when(big, F.lit(0).cast("long")).when(opens, x["n"]).otherwise(a["held"] + x["n"])
        row = F.struct(x["year"].alias("year"), x["n"].alias("n"), bucket.alias("bucket"), big.alias("chunked"))
        return F.struct(bucket.alias("bucket"), held.alias("held"), F.array_append(a["out"], row).alias("out"))
    whole = years.agg(F.array_sort(F.collect_list(F.struct(F.col("year").cast("int").alias("year"), F.col("n").cast("long").alias("n")))).alias("all"))
    return whole.select(F.inline(F.aggregate("all", zero, step, lambda a: a["out"])))


def bucket_periods(entries: DataFrame, year: Column, order: list[str], target: int = 20) -> DataFrame:
    """``entries`` with period_no from 1, oldest first; entries without a year are left out.
    Years are counted in parallel, packed in one small fold, and joined back by year; only
    years that are cut into chunks are numbered inside."""
    dated = entries.withColumn("_year", year.cast("int")).where("_year is not null")
    starts = period_starts(dated.groupBy(F.col("_year").alias("year")).agg(F.count(F.lit(1)).alias("n")), target)
    chunks = starts.withColumn("chunks", F.when(F.col("chunked"), F.ceil(F.col("n") / target)).otherwise(F.lit(1)))
    per = chunks.groupBy("bucket").agg(F.max("chunks").alias("chunks"))
    before = per.withColumn("before", F.coalesce(F.sum("chunks").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per bucket
    plan = chunks.select(F.col("year").alias("_year"), "bucket", "chunked").join(F.broadcast(before.select("bucket", "before")), "bucket")
    placed = dated.join(F.broadcast(plan), "_year")  # a row per year
    rank = F.row_number().over(Window.partitionBy("_year").orderBy(*order))
    small = placed.where(~F.col("chunked")).withColumn("period_no", F.col("before") + 1)
    large = placed.where("chunked").withColumn("period_no", F.col("before") + 1 + F.floor((rank - 1) / target))
    return small.unionByName(large).withColumn("period_no", F.col("period_no").cast("int")).drop("_year", "bucket", "chunked", "before")


def period_summary(periods: DataFrame, year: Column) -> DataFrame:
    return periods.groupBy("period_no").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count(F.lit(1)).alias("n"))


def group_documents(pages: DataFrame, group: list[str], order: str, starts: str, ends: str) -> DataFrame:
    """``pages`` with doc_no from 1: a page opens a document if it starts one, follows one
    that ended, or is the first."""
    w = Window.partitionBy(*group).orderBy(order)
    opens = F.coalesce(F.col(starts), F.lit(False)) | F.coalesce(F.lag(F.coalesce(F.col(ends), F.lit(False))).over(w), F.lit(True))
    return pages.withColumn("_opens", opens.cast("int")).withColumn("doc_no", F.sum("_opens").over(w).cast("int")).drop("_opens")


def documents(pages: DataFrame, group: list[str], order: str, starts: str, ends: str, greeting: str | None = None, signoff: str | None = None) -> DataFrame:
    """A row per document: pages, whether it is still open, and its greeting (only if a page
    started it) and sign-off (from the page that closes it)."""
    own = group_documents(pages, group, order, starts, ends)
    first, last = F.min_by(F.struct(*own.columns), order), F.max_by(F.struct(*own.columns), order)
    out = own.groupBy(*group, "doc_no").agg(F.count(F.lit(1)).alias("pages"), first.alias("f"), last.alias("l"))
    cols = [*group, "doc_no", "pages", (~F.coalesce(F.col(f"l.{ends}"), F.lit(False))).alias("open")]
    if greeting:
        cols.append(F.when(F.coalesce(F.col(f"f.{starts}"), F.lit(False)), F.col(f"f.{greeting}")).alias("greeting"))
    if signoff:
        cols.append(F.when(F.coalesce(F.col(f"l.{ends}"), F.lit(False)), F.col(f"l.{signoff}")).alias("signoff"))
    return out.select(*cols)


def attempts(events: DataFrame, group: list[str], order: str, last: str) -> DataFrame:
    """``events`` with attempt_no from 1: a new attempt begins after an event marked last."""
    w = Window.partitionBy(*group).orderBy(order)
    before = F.coalesce(F.sum(F.coalesce(F.col(last), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("attempt_no", (before + 1).cast("int"))


def session_current(decisions: DataFrame, group: list[str], order: str) -> DataFrame:
    """Where each session stands: the person of its latest decision, null after a last one."""
    return decisions.groupBy(*group).agg(F.max_by(F.when(~F.coalesce(F.col("last"), F.lit(False)), F.col("person_id")), order).alias("current"))


def line_boxes(lines: DataFrame, page: list[str], y: str, tie: str, low: int = 20, high: int = 200, last_gap: int = 60) -> DataFrame:
    """``lines`` with top and bottom from the gap to the next baseline, kept within bounds."""
    gap = F.lead(y).over(Window.partitionBy(*page).orderBy(y, tie)) - F.col(y)
    height = F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(gap, F.lit(last_gap))))
    return lines.withColumn("height", height).withColumns({
        "top": (F.col(y) - 0.6 * F.col("height")).cast("int"), "bottom": (F.col(y) + 0.4 * F.col("height")).cast("int")})


def positional(lines: DataFrame, boxes: DataFrame, page: list[str], line_order: str, box_order: list[str]) -> DataFrame:
    """The k-th line of a page with its k-th box."""
    a = lines.withColumn("k", F.row_number().over(Window.partitionBy(*page).orderBy(line_order)))
    b = boxes.withColumn("k", F.row_number().over(Window.partitionBy(*page).orderBy(*box_order)))
    return a.join(b, [*page, "k"])


def by_date(items: DataFrame) -> DataFrame:
    return items.orderBy("date", "id")


def recorded_at() -> Column:
    return F.coalesce("created_at", "recorded", "created", "date")


def recent(items: DataFrame, limit: int = 5) -> DataFrame:
    return items.orderBy(recorded_at().desc(), "id").limit(limit)


def today_moment(items: DataFrame, ref: Column, date, precision, groups: list[str], order: list[str], reach: int = 4) -> DataFrame:
    """For each group the row whose day of the year lies nearest to ``ref``, at most ``reach``
    days off, the first of equals; dropped afterwards if not a year has passed: another row
    does not take its place."""
    d = month_day_distance(date, precision, ref)
    near = items.withColumn("distance", d).where(F.abs("distance") <= reach)
    w = Window.partitionBy(*groups).orderBy(F.abs("distance"), *order)
    won = near.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    return won.withColumn("years", F.year(ref) - year_of(date)).where("years >= 1")


def band_anchor(lines: DataFrame, page: str, y: Column) -> DataFrame:
    """(page, line): the line that holds ``y``, else the nearest below, else the last."""
    inside = (F.col("top") <= y) & (y <= F.col("bottom"))
    rank = F.struct(F.when(inside, 0).when(F.col("top") > y, 1).otherwise(2).alias("c"), F.abs(F.col("top") - y).alias("d"), F.col("index"))
    return lines.groupBy(page).agg(F.min_by("index", rank).alias("line"))


def greedy_spans(spans: Column) -> Column:
    """Of spans (start, end, ...) those kept by taking, from the left, the longest at each
    start and skipping what overlaps it."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    zero = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, zero, lambda out, x: F.when(
        (F.size(out) == 0) | (x["start"] >= F.try_element_at(out, F.lit(-1))["end"]), F.array_append(out, x)).otherwise(out))
