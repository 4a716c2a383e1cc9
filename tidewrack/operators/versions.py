"""Append-only versions folded to what holds now, and checks of their numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.shared import checkpoints


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is highest by ``order`` (numbers as numbers: 10 beats 9). One
    aggregation with partial maxima: nothing is sorted and a hot key is combined map-side."""
    rank = F.struct(*[F.col(c) for c in order])
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"top.{c}").alias(c) for c in df.columns])


def current(df: DataFrame, keys: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The latest rows that are not tombstones."""
    return latest(df, keys, order).where(~F.coalesce(deleted, F.lit(False)))


def latest_table(df: DataFrame, name: str = "table_name", version: str = "version") -> DataFrame:
    """The rows of each table's highest version: a whole table is one version."""
    top = df.groupBy(name).agg(F.max(version).alias(version))
    return df.join(F.broadcast(top) if _few_names(df, name) else top, [name, version], "left_semi")


def _few_names(df: DataFrame, name: str, most: int = 1000) -> bool:
    return len(df.select(name).distinct().take(most + 1)) <= most


def version_gaps(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keys whose versions are not 1 to n: (keys, low, high, versions). The distinct versions
    are counted after a partial de-duplication on (keys, version)."""
    seen = df.select(*keys, version).distinct().groupBy(*keys).agg(
        F.min(version).alias("low"), F.max(version).alias("high"), F.count(version).alias("versions"))
    return seen.where((F.col("low") != 1) | (F.col("high") != F.col("versions")))


def tombstones(df: DataFrame, ids: DataFrame, key: str, version: str, status: str = "status") -> DataFrame:
    """Rows that delete ``ids``: the next version of each, with no content."""
    top = df.join(ids, key, "left_semi").groupBy(key).agg((F.max(version) + 1).alias(version))
    return top.select(*[F.lit("deleted").alias(c) if c == status else F.col(c) if c in (key, version) else F.lit(None).cast(dict(df.dtypes)[c]).alias(c) for c in df.columns])


def next_version(df: DataFrame, new: DataFrame, key: str, version: str = "version") -> DataFrame:
    """``new`` records with their version and the one they supersede (null for a first)."""
    top = df.groupBy(key).agg(F.max(version).alias("supersedes"))
    return new.drop(version).join(top, key, "left").withColumn(version, F.coalesce(F.col("supersedes"), F.lit(0)) + 1)


def upsert_content(assets: Column, kind: str, file: Column) -> Column:
    """An item's assets with the entry of a content kind replaced; a null file clears it."""
    others = F.filter(assets, lambda x: x["kind"] != kind)
    return F.when(file.isNull(), others).otherwise(F.concat(others, F.array(F.struct(F.lit(kind).alias("kind"), file.alias("file"), F.lit(None).cast("string").alias("caption")))))


def split_content(items: DataFrame) -> DataFrame:
    """(item_id, kind, text) of the long texts that live outside the record: story items
    keep both, letters and documents their transcription, other types neither."""
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("story", "transcription")])).alias("c")
    rows = items.select(F.col("id").alias("item_id"), "type", kind).select("item_id", "type", "c.*")
    allowed = (F.col("type") == "story") | (F.col("type").isin("letter", "document") & (F.col("kind") == "transcription"))
    return rows.where(allowed & (F.coalesce("text", F.lit("")) != "")).select("item_id", "kind", "text")


def content_filename(kind: Column, version: Column) -> Column:
    """story.txt, then story-2.txt and so on."""
    return F.concat(kind, F.when(version > 1, F.concat(F.lit("-"), version.cast("string"))).otherwise(F.lit("")), F.lit(".txt"))


def changes_only(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Versions that differ from the one before: a write of equal content is none."""
    mark = F.xxhash64(*payload)
    before = F.lag(mark).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_before", before).where(~F.equal_null("_before", mark)).drop("_before")


def fingerprint(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, fingerprint): the sorted SHA-256 of a pile's pages."""
    return df.select(key, F.sha2(F.col(content), 256).alias("page")).groupBy(key).agg(F.array_sort(F.collect_list("page")).alias("fingerprint"))


def duplicate_content(df: DataFrame, content: str, key: str) -> DataFrame:
    """Contents with more than one row: (fingerprint, copies, first)."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where("copies > 1")


#: Sets that hold a part are met by its others in slices of so many, so that a part of many sets is no hot key.
SLICE = 2_000


def _ranked(own: DataFrame, keys: list[str], seen: DataFrame) -> DataFrame:
    """(keys, d, set): of rows (keys, part) the number of distinct parts, and the numbers of those that
    are in ``seen`` (part, held, no), in one order of all parts, rare ones first."""
    rank = F.when(F.col("no").isNotNull(), F.struct("held", "no"))  # collect_list leaves out the nulls
    return own.join(seen, "part", "left").groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("d"), F.sort_array(F.collect_list(rank)).alias("set"))


def _numbered(parts: DataFrame) -> DataFrame:
    """(part, held, no): parts of more than one row with a number each. Written down, as the numbers
    hang on the order of the rows."""
    checkpoints(parts.sparkSession)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("held")).where("held > 1").withColumn("no", F.monotonically_increasing_id()).checkpoint()


def _sharing(x: DataFrame, y: DataFrame, may: Column) -> DataFrame:
    """Pairs of the sets x and y (set, least and columns of their own, which begin with x and y) that share at
    least ``least`` parts of either, with their number ``shared``. Such sets share a part among the first of
    each - all but what may be missing - and meet once, at the first part that they share; they are
    compared there, so no pair goes through an exchange. A row holds its set, one row a leading part."""
    def own(c: DataFrame) -> list[str]:
        return [k for k in c.columns if k not in ("set", "least")]

    def lead(c: DataFrame, n: str) -> DataFrame:
        first = F.slice("set", F.lit(1), F.greatest(F.lit(0), F.size("set") - F.col("least") + 1))
        return c.select(*own(c), F.transform("set", lambda p: p["no"]).alias(f"{n}set"), F.col("least").alias(f"{n}least"), F.explode(first).alias("p")).withColumns(
            {"no": F.col("p.no"), "slices": F.ceil(F.col("p.held") / SLICE).cast("int")}).drop("p")
    one = lead(x, "x").withColumn("slice", F.pmod(F.xxhash64(*own(x)), F.col("slices")).cast("int")).drop("slices")
    other = lead(y, "y").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
    size = (F.size("xset") >= F.col("yleast")) & (F.size("yset") >= F.col("xleast"))
    met = one.join(other, ["no", "slice"]).where(may & size).withColumn("common", F.array_intersect("xset", "yset"))
    met = met.where((F.get("common", F.lit(0)) == F.col("no")) & (F.size("common") >= F.greatest("xleast", "yleast")))
    return met.withColumn("shared", F.size("common").cast("long")).drop("common", "no", "slice", "xset", "yset", "xleast", "yleast")


def _half(n: str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.col(n) / 2)).cast("int")


def pile_overlap(parts: DataFrame, key: str, part: str) -> DataFrame:
    """Pairs of piles that share at least half of their distinct parts, rounded down but one at
    least, both ways: (a, b, shared), a < b. A moved or rescanned pile shows so.

    Parts go by half of their SHA-256, then by a number, so that no text is exchanged. Piles of the
    same parts are one class, which is met as one; only the answer itself expands classes into their piles."""
    own = parts.where(F.col(part).isNotNull()).select(F.col(key).alias("pile"), F.unhex(F.substring(F.sha2(F.col(part).cast("string"), 256), 1, 32)).alias("part")).distinct()
    piles = _ranked(own, ["pile"], _numbered(own))
    lone = piles.where(F.size("set") < F.col("d"))  # a part of its own: such a pile is a class by itself
    own_class = lone.select("d", "set", F.array("pile").alias("piles"))
    classes = piles.where(F.size("set") == F.col("d")).groupBy("d", "set").agg(F.array_sort(F.collect_list("pile")).alias("piles"))
    every = classes.unionByName(own_class).withColumn("least", _half("d")).drop("d")
    met = _sharing(every.withColumnRenamed("piles", "xp"), every.withColumnRenamed("piles", "yp"), F.get("xp", F.lit(0)) < F.get("yp", F.lit(0)))
    met = met.select(F.explode("xp").alias("a"), "yp", "shared").select("a", F.explode("yp").alias("b"), "shared")
    alike = classes.where(F.size("piles") > 1).select(F.posexplode("piles").alias("i", "a"), "piles", F.col("d").cast("long").alias("shared"))
    alike = alike.select("a", F.explode(F.slice("piles", F.col("i") + 2, F.size("piles"))).alias("b"), "shared")
    return met.unionByName(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")


#: A part of at most so many sets is met by itself; the others only together with further parts.
RARE = 64
#: (least, most, parts): sets that must share from least to most parts meet by their first so many common ones. Three frequent
#: parts are held by few sets; larger sets have more combinations than they would spare comparisons.
STEPS = ((1, 1, 1), (2, 2, 2), (3, 12, 3), (13, 40, 2), (41, 2**31 - 1, 1))


def _combined(c: DataFrame, n: str) -> DataFrame:
    """(n, step, key, least, tail) of sets (n, set, least): a row for each part of at most RARE sets by which a set may have to meet
    another (step -1), and for each combination of frequent parts by STEPS. A tail is the set from the first part of the key on."""
    c = c.where(F.size("set") >= F.col("least")).select(n, "least", F.transform("set", lambda p: p["no"]).alias("nos"), F.size("set").alias("size"), F.size(F.filter("set", lambda p: p["held"] <= RARE)).alias("rare"))

    def span(step: int, parts: int, start: Column, end: Column) -> Column:  # the parts of a key stand from start to before end, counted from 0
        return F.struct(F.lit(step).alias("step"), F.lit(parts).alias("parts"), start.alias("start"), end.cast("int").alias("end"))
    spans = [span(-1, 1, F.lit(0), F.least("rare", F.col("size") - F.col("least") + 1))]
    for step, (low, high, parts) in enumerate(STEPS):
        least = F.greatest(F.lit(low), F.col("least"))
        spans.append(span(step, parts, F.col("rare"), F.when(least <= F.least(F.lit(high), "size"), F.col("size") - least + parts).otherwise(F.lit(0))))
    none, left = F.array(F.lit(None).cast("long")), F.col("end") - F.col("i")
    c = c.select(n, "least", "nos", "size", F.explode(F.filter(F.array(*spans), lambda s: s["start"] + s["parts"] <= s["end"])).alias("s")).select(n, "least", "nos", "size", "s.*")
    c = c.withColumn("i", F.explode(F.sequence("start", F.col("end") - F.col("parts"))))
    c = c.select(n, "least", "step", "parts", left.alias("left"), F.slice("nos", F.col("i") + 1, F.col("size")).alias("tail"))
    c = c.withColumn("j", F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(1), F.col("left") - F.col("parts") + 1)).otherwise(F.array(F.lit(0)))))
    c = c.withColumn("third", F.explode(F.when(F.col("parts") > 2, F.slice("tail", F.col("j") + 2, F.col("left") - F.col("j") - 1)).otherwise(none)))
    key = F.xxhash64("step", F.get("tail", F.lit(0)), F.when(F.col("parts") > 1, F.get("tail", F.col("j"))), "third")
    return c.select(n, "least", "step", key.alias("key"), "tail")


def _most_shared(x: DataFrame, y: DataFrame) -> DataFrame:
    """(x, y, shared): of each set x (x, set, least) the set y (y, set, least) with the most common parts, at least ``least`` of either;
    of several the lowest y. Such sets meet at their first common part or parts, where all that they share is in their tails; where
    they meet besides, less is, which the most leaves out. Keys are hashes; parts are counted by their numbers."""
    one, other = (_combined(c, n).withColumnsRenamed({"least": f"{n}least", "tail": f"{n}tail"}) for c, n in ((x, "x"), (y, "y")))
    least = F.greatest("xleast", "yleast")
    step = F.coalesce(*[F.when(least <= high, F.lit(i)) for i, (_, high, _) in enumerate(STEPS)])
    met = one.hint("merge").join(other.drop("step"), "key").where(((F.col("step") == -1) | (F.col("step") == step)) & (F.least(F.size("xtail"), F.size("ytail")) >= least))
    met = met.select("x", "y", F.size(F.array_intersect("xtail", "ytail")).alias("shared"), least.alias("least")).where("shared >= least")
    return met.groupBy("x").agg(F.min(F.struct((-F.col("shared")).alias("s"), "y")).alias("top")).select("x", "top.y", (-F.col("top.s")).alias("shared"))


def register(registry: DataFrame, arriving: DataFrame) -> DataFrame:
    """Outcome of arriving batches (batch_id, fingerprint) against a registry of the same
    shape: already-registered (same id and pages), content-changed (same id, other pages, or the
    same folder and any common page, where both have a column path), re-associated (another id
    whose pages overlap best, at least half of either), or new."""
    same = registry.select("batch_id", F.col("fingerprint").alias("known"))
    first = arriving.join(same, "batch_id", "left")
    def classes(df: DataFrame) -> DataFrame:  # piles of the same pages and size are one
        pages = df.where(F.size(F.array_compact("fingerprint")) > 0).select("batch_id", F.size("fingerprint").alias("n"), F.sort_array(F.array_distinct(F.array_compact("fingerprint"))).alias("pages"))
        return pages.select(F.xxhash64("pages").alias("hash"), "*")
    cls = ["hash", "n", "pages"]  # the hash leads, so that few pages are compared
    checkpoints(arriving.sparkSession)
    left = classes(arriving.join(same, "batch_id", "left_anti"))
    one = lambda df: df.groupBy(*cls).agg(F.min("batch_id").alias("id"))
    new = one(left).select(F.monotonically_increasing_id().alias("x"), *cls).checkpoint()
    # of equal piles the first by id is the best; the numbers stand in the order of these ids
    old = one(classes(registry)).orderBy("id").select(F.monotonically_increasing_id().alias("y"), "id", "n", "pages").checkpoint()
    flat = lambda df, k: df.select(k, "n", F.explode("pages").alias("part"))
    seen = _numbered(flat(new, "x").select("part").unionByName(flat(old, "y").select("part")))
    sets = lambda df, k: _ranked(flat(df, k), [k, "n"], seen).select(k, "set", _half("n").alias("least"))
    met = _most_shared(sets(new, "x"), sets(old, "y")).join(old.select("y", "id"), "y").join(new, "x")
    best = left.join(met.select(*cls, F.struct((-F.col("shared")).alias("s"), "id").alias("top")), cls).groupBy("batch_id").agg(F.min("top")["id"].alias("moved_from"))
    if "path" in registry.columns and "path" in arriving.columns:  # a pile that stayed where it was is the same with a single page left
        home = arriving.join(same, "batch_id", "left_anti").select("batch_id", "path", F.explode("fingerprint").alias("page")).join(
            registry.select(F.col("batch_id").alias("other"), "path", F.explode("fingerprint").alias("page")), ["path", "page"])
        home = home.groupBy("batch_id", "other").agg(F.countDistinct("page").alias("shared")).groupBy("batch_id").agg(F.min_by("other", F.struct((-F.col("shared")).alias("s"), "other")).alias("stayed"))
    else:
        home = best.select("batch_id", F.lit(None).cast("string").alias("stayed")).where("false")
    best = best.join(home, "batch_id", "full")
    outcome = F.when(F.col("stayed").isNotNull(), "content-changed").when(F.col("known").isNotNull(), F.when(F.col("known") == F.col("fingerprint"), "already-registered").otherwise("content-changed")).when(
        F.col("moved_from").isNotNull(), "re-associated").otherwise("new")
    return first.join(best, "batch_id", "left").select("batch_id", "fingerprint", F.coalesce("stayed", "moved_from").alias("moved_from"), outcome.alias("outcome"))
