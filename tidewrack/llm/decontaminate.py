"""Benchmark decontamination by spaced-seed hashing.

A mask marks which of a few consecutive word positions are hashed; the others may differ.
Test and training texts are hashed under the same masks and joined; every hit proposes an
alignment without gaps, along which the words are compared: a stretch of WINDOW words, or of
the whole item if that is shorter, with at least four fifths of them equal at their places
counts as leaked. The masks of an item's length together hit every such stretch (all ways to
lose so many words were tried), so items of five words on tolerate changed words; four fifths
of fewer words are all of them.

Of every seed of the test set its longest word is the anchor. Training texts are looked
through for anchors, and only where one stands is a seed hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, words

#: Offsets of the hashed words: for stretches of WINDOW words, of 5 to 14 words, and one more for 5.
MASKS = ((0, 1, 3, 6, 7), (0, 2, 6, 8, 9))
SHORT_MASK, FIVE_MASK = (0, 1, 3), (0, 2)
WINDOW = 15
#: Test seeds, their anchors and test words are broadcast up to this many rows, about 100 MB; beyond it they are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def least_equal(n):
    """Four fifths of n words, rounded up."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks under which an item of n words is sought."""
    if n >= WINDOW:
        return MASKS
    return (tuple(range(n)),) if n < 5 else (SHORT_MASK, FIVE_MASK) if n == 5 else (SHORT_MASK,)


def _starts(w, mask):
    """The positions of an array at which a mask fits."""
    span = mask[-1] + 1
    return F.when(F.size(w) >= span, F.sequence(F.lit(0), F.size(w) - span)).otherwise(F.array().cast("array<int>"))


def _hash(k: int, mask: tuple[int, ...], w, at):
    return F.xxhash64(F.lit(k), *[F.get(w, at + o) for o in mask])


def _test_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(ik, hash, item_at, k, anchor, off) for items (ik, iw): the anchor is the hash of the longest
    word under the mask, the first of equals, off its offset."""
    def under(k: int, mask: tuple[int, ...]):
        def seed(at):
            longest = F.array_max(F.array(*[F.struct(F.length(F.get("iw", at + o)).alias("n"), F.lit(-o).alias("o")) for o in mask]))
            off = -longest["o"]
            return F.struct(F.lit(k).alias("k"), at.alias("item_at"), _hash(k, mask, F.col("iw_hash"), at).alias("hash"), off.alias("off"), F.get("iw_hash", at + off).alias("anchor"))
        lengths = [n for n in range(1, WINDOW + 1) if mask in masks_of(n)]
        wanted = F.least(F.size("iw"), F.lit(WINDOW)).isin(*lengths)
        return F.filter(F.transform(_starts(F.col("iw"), mask), seed), lambda s: wanted)
    hashed = items.withColumn("iw_hash", F.transform("iw", lambda x: F.xxhash64(x)))
    return hashed.select("ik", F.explode(F.concat(*[under(k, m) for k, m in enumerate(masks)])).alias("s")).select("ik", "s.hash", "s.item_at", "s.k", "s.anchor", "s.off").distinct()


def _hits(docs: DataFrame, text, row, seeds: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """(row, ik, shift) for every seed that a text shares with an item."""
    wide = docs.select(row, F.transform(words(F.lower(text)), lambda x: F.xxhash64(x)).alias("w"))
    anchors = cut(seeds.select("anchor", "k", "off").distinct())
    if anchors.count() <= BROADCAST_ROWS:
        placed = wide.select("row", "w", F.posexplode("w").alias("pos", "anchor")).join(F.broadcast(anchors), "anchor").withColumn("at", F.col("pos") - F.col("off"))
        hash_, fits = F.lit(None).cast("long"), F.lit(False)
        for k, mask in enumerate(masks):
            hash_ = F.when(F.col("k") == k, _hash(k, mask, F.col("w"), F.col("at"))).otherwise(hash_)
            fits = F.when(F.col("k") == k, F.col("at").between(0, F.size("w") - mask[-1] - 1)).otherwise(fits)
        found = placed.where(fits).select("row", hash_.alias("hash"), "at")
    else:  # too many anchors to send to every task: all seeds of the texts meet those of the items
        def under(k: int, mask: tuple[int, ...]):
            return F.transform(_starts(F.col("w"), mask), lambda at: F.struct(_hash(k, mask, F.col("w"), at).alias("hash"), at.alias("at")))
        found = wide.select("row", F.explode(F.concat(*[under(k, m) for k, m in enumerate(masks)])).alias("s")).select("row", "s.hash", "s.at")
    return found.join(_small(seeds.select("hash", "ik", "item_at")), "hash").select("row", "ik", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """Leaked stretches: a row for each document row, item and alignment, with the row's
    hash (of id and text), doc_start, doc_end, item_start, item_end (words from 0, end
    exclusive) and n_match, the equal words between.

    Words are runs of non-white characters in lower case. Null and empty texts hold nothing and
    items without words are in no text. Documents with a null id keep it; equal rows each give
    their rows. Other columns of either table are ignored. An empty table on either side: no rows.
    """
    items = tests.select(column(tests, item_col).alias("item_id"), words(F.lower(column(tests, item_text_col))).alias("iw"))
    items = cut(items.where(F.size("iw") > 0).distinct())
    lengths = sorted(r[0] for r in items.select(F.least(F.size("iw"), F.lit(WINDOW)).alias("n")).distinct().collect())  # fifteen at most
    masks = list(dict.fromkeys(m for n in lengths for m in masks_of(n))) or list(MASKS)
    item_words = items.withColumn("ik", F.xxhash64("item_id", "iw"))
    seeds = cut(_test_seeds(item_words, masks))
    row = F.xxhash64(column(docs, id_col), column(docs, text_col)).alias("row")
    hits = _hits(docs, column(docs, text_col), row, seeds, masks)
    per_row = cut(hits).groupBy("row").agg(F.collect_list(F.struct("ik", "shift")).alias("hits"))
    texts = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("t"), row)
    found = texts.join(per_row, "row").select("row", "doc_id", words(F.lower("t")).alias("dw"), "hits")
    found = found.select("row", "doc_id", "dw", F.inline("hits")).join(_small(item_words), "ik")
    lo, hi = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("iw"), F.size("dw") - F.col("shift"))
    found = found.withColumns({"lo": lo, "hi": hi}).where("hi > lo")
    same = F.transform(F.sequence(F.col("lo"), F.col("hi") - 1), lambda j: (F.get("iw", j) == F.get("dw", j + F.col("shift"))).cast("int"))
    width = F.least(F.size("iw"), F.lit(WINDOW))
    found = found.select("row", "doc_id", "item_id", "shift", "lo", same.alias("same"), width.alias("width"))
    least = least_equal(F.col("width"))
    at_ = F.when(F.size("same") >= F.col("width"), F.sequence(F.lit(1), F.size("same") - F.col("width") + 1)).otherwise(F.array().cast("array<int>"))
    good = F.filter(at_, lambda j: F.aggregate(F.slice("same", j, F.col("width")), F.lit(0), lambda a, x: a + x) >= least)
    found = found.withColumn("good", good).where(F.size("good") > 0)
    start, end = F.element_at("good", 1), F.element_at("good", -1) + F.col("width") - 1
    part = F.slice("same", start, end - start + 1)
    found = found.withColumns({
        "item_start": F.col("lo") + start - 1, "item_end": F.col("lo") + end,
        "n_match": F.aggregate(part, F.lit(0), lambda a, x: a + x)})
    return found.select("row", "doc_id", "item_id", (F.col("item_start") + F.col("shift")).alias("doc_start"),
                        (F.col("item_end") + F.col("shift")).alias("doc_end"), "item_start", "item_end", "n_match")


def decontaminate(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no leaked stretch, unchanged. Null and empty texts stay, rows with
    equal id and text share their fate, and an empty test set leaves all."""
    bad = leaks(docs, tests, id_col, text_col, **options).select(F.col("row").alias("leaked_row")).distinct()
    return docs.join(bad, F.xxhash64(column(docs, id_col), column(docs, text_col)) == F.col("leaked_row"), "left_anti")
