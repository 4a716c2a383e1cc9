"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target in words. Its documents stand in a seeded random order (a hash
of the document); whole rounds of the source are drawn first, then documents in that order
until the target is met. The draws of a source form blocks - ranges of the hash order -
and a binary tree over the output shards splits the block counts of all sources at once:
each node gives its left half a multivariate-hypergeometric draw of what it holds, so every
shard gets an exact share and every block goes to one shard. Inside a shard the rows are
in random order.

All passes over data are DataFrame operations. The driver holds one row per source and a
block table of at most ``MAX_BLOCKS`` rows per round, whatever the size of the corpus.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, cut, free_name, n_words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
SEED = 20_260
#: The hash order is cut into this many bins per source to find where a source's draw ends.
CUT_BITS = 12
MAX_BLOCKS = 65_536
#: Sources are categories: the driver plans with a row for each, and more than this many are refused.
MAX_SOURCES = 65_536
#: Cells of the table source by shard that the driver fills.
MAX_CELLS = 20_000_000


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Split ``share`` times all sizes by weight; what a source cannot hold (``limit``
    times its size) is shared again by weight among the others until none is above."""
    left = share * sum(sizes)
    out, free = [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / weight >= limit * sizes[i]]
        if not above:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in above:
            out[i] = float(limit * sizes[i])
        left -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def splitting_tree(blocks: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Quotas [source, shard] that add up to ``blocks`` per source and differ by at most
    one between shards in total."""
    rng = np.random.Generator(np.random.PCG64(seed))
    quota = np.zeros((len(blocks), shards), dtype=np.int64)

    def split(held: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            quota[:, first] = held
            return
        left = n // 2
        total = int(held.sum())
        take = total // n * left + min(total % n, left)
        drawn = rng.multivariate_hypergeometric(held, take, method="marginals") if total else held
        split(drawn, first, left)
        split(held - drawn, first + left, n - left)

    split(np.asarray(blocks, dtype=np.int64), 0, shards)
    return quota


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, shards: int = 16,
             seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target and shards (array<int>: one output shard for
    every time the document is drawn; empty: not drawn). Clashing names get underscores.

    Sources are ordered by code point, null last, and take ``weights`` in turn; more than
    MAX_SOURCES raise ValueError. Null or blank texts have size 0 and are drawn with their
    neighbours in hash order. Rows with equal id and text stand at the same place; where a draw
    ends among them, as many of them are drawn as the target asks for. Empty input: empty output.
    """
    spark = docs.sparkSession
    names = docs.columns
    size, total, target, where = (free_name(names, x) for x in ("size", "source_size", "target", "shards"))
    h = free_name([*names, size], "mix_hash")
    seen = docs.withColumns({
        size: n_words(column(docs, text_col)),
        h: F.xxhash64(F.lit(seed), column(docs, id_col), column(docs, text_col)),
    })
    keys = cut(seen.select(column(docs, source_col).cast("string").alias("s"), F.col(size).alias("n"), F.col(h).alias("h"), F.spark_partition_id().alias("task")))
    totals = keys.groupBy("s").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"{source_col} has more than {MAX_SOURCES} values; mix by a coarser source")
    shards = max(1, min(shards, MAX_CELLS // max(1, len(totals))))
    per = sorted(((r.s, int(r.n)) for r in totals),
                 key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    goal = targets([n for _, n in per], [weights[i % len(weights)] for i in range(len(per))], share, limit)
    table = [(i, s, n, g, min(limit, int(g // n)) if n else 0) for i, ((s, n), g) in enumerate(zip(per, goal))]
    schema = "sid int, s string, total long, target double, rounds int"
    sources = spark.createDataFrame(table, T._parse_datatype_string(schema))
    # where the last, partial round of each source ends
    at = F.shiftrightunsigned("h", 64 - CUT_BITS)
    need = sources.select("sid", "s", (F.col("target") - F.col("rounds") * F.col("total")).alias("q")).where("q > 0")
    keyed = keys.join(need, keys.s.eqNullSafe(need.s)).select("sid", "q", "n", "h", at.alias("b"))
    order = Window.partitionBy("sid").orderBy("b")
    bins = keyed.groupBy("sid", "q", "b").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(order))
    edge = cut(bins.where("upto >= q and upto - n < q").groupBy("sid", "q").agg(
        F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("below"))).alias("e")).select("sid", "q", "e.*"))
    # inside that bin: the last place drawn as a whole, and the place at which the target is crossed
    place = keyed.join(edge.select("sid", "b", "below"), ["sid", "b"]).groupBy("sid", "q", "b", "below", "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    order = Window.partitionBy("sid").orderBy(F.shiftrightunsigned("h", 1), "h")
    place = place.withColumn("c", F.col("below") + F.sum(F.col("n") * F.col("m")).over(order))
    cuts = place.groupBy("sid", "q", "b").agg(
        F.max_by("h", F.when(F.col("c") <= F.col("q"), F.struct(F.shiftrightunsigned("h", 1), F.col("h")))).alias("last"),
        F.min_by(F.struct("h", "n", "m", (F.col("c") - F.col("n") * F.col("m")).alias("c")), F.when(F.col("c") > F.col("q"), F.struct(F.shiftrightunsigned("h", 1), F.col("h")))).alias("x"),
        F.max("c").alias("full"))
    some = F.coalesce(F.floor((F.col("q") - F.col("x.c")) / F.col("x.n")), F.lit(0)).cast("int")  # of the rows at the crossing
    cuts = cut(cuts.select("sid", "q", "b", "last", F.col("x.h").alias("cross"), some.alias("some"), (F.col("q") - F.coalesce(F.col("x.c") + some * F.col("x.n"), F.col("full"))).alias("gap")))
    # one document more, if the size of some comes nearer to what is still missing than none does
    taken = _drawn(F.col("h"), F.col("b"), F.col("last"))
    apart = F.abs(F.col("gap") - F.col("n"))
    fix = keyed.drop("b", "q").join(cuts, "sid").where(~taken & (apart < F.col("gap"))).groupBy("sid").agg(F.min_by("h", F.struct(apart, "h")).alias("fix"))
    rule = cuts.join(fix, "sid", "left").select(
        "sid", "b", "last", "cross", (F.col("some") + F.coalesce((F.col("fix") == F.col("cross")).cast("int"), F.lit(0))).alias("some"),
        F.when(F.coalesce(F.col("fix") != F.col("cross"), F.lit(True)), F.col("fix")).alias("fix"))
    rules = cut(sources.join(rule, "sid", "left").withColumnRenamed("s", "rule_s"))
    # blocks: ranges of the hash order, dealt to shards by the tree
    bits = max(0, min(10, int(math.log2(MAX_BLOCKS / max(1, len(per))))))
    block = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    k = keys.join(rules, keys.s.eqNullSafe(rules.rule_s)).select("sid", block.alias("block"), _copies().alias("k"))
    held = k.where("k > 0").groupBy("sid", "block").agg(F.max("k").alias("k")).select(
        "sid", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("turn"), "block")
    held = cut(held.withColumn("rank", F.row_number().over(Window.partitionBy("sid").orderBy("turn", "block"))))
    count = {r.sid: r.n for r in held.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = np.cumsum(splitting_tree([count.get(i, 0) for i in range(len(per))], shards, seed), axis=1) if per else np.zeros((0, shards))
    quota = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(ends)], T._parse_datatype_string("sid int, ends array<long>"))
    dealt = held.join(quota, "sid").select("sid", "block", "turn", F.size(F.filter("ends", lambda e: e < F.col("rank"))).alias("shard"))
    dealt = dealt.groupBy(F.col("sid").alias("d_sid"), F.col("block").alias("d_block")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("dealt"))
    dealt = cut(dealt)
    renamed = rules.select(*[F.col(c).alias(f"mix_rule_{c}") for c in rules.columns])
    placed = seen.withColumn("mix_rule_task", F.spark_partition_id()).join(F.broadcast(renamed), column(docs, source_col).cast("string").eqNullSafe(F.col("mix_rule_rule_s")))  # a row per source
    placed = _numbered(placed, keys.join(rules, keys.s.eqNullSafe(rules.rule_s)), h)
    blk = F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long")
    placed = placed.join(F.broadcast(dealt), (F.col("mix_rule_sid") == F.col("d_sid")) & (blk == F.col("d_block")), "left")
    copies = _copies("mix_rule_", F.col(h), F.col("mix_rule_number"))
    return placed.select(
        *[column(docs, c) for c in names], F.col(size), F.col("mix_rule_total").alias(total), F.col("mix_rule_target").alias(target),
        F.when(copies > 0, F.transform(F.slice("dealt", 1, copies), lambda x: x["shard"])).otherwise(
            F.array().cast("array<int>")).alias(where))


def _drawn(h, b, last):
    """Whether the hash stands before the end of its source's partial round."""
    bin_ = F.shiftrightunsigned(h, 64 - CUT_BITS)
    low = F.shiftrightunsigned(h, 1)
    before = (low < F.shiftrightunsigned(last, 1)) | ((low == F.shiftrightunsigned(last, 1)) & (h <= last))
    return F.coalesce((bin_ < b) | ((bin_ == b) & F.coalesce(before, F.lit(False))), F.lit(False))


def _copies(prefix: str = "", h=None, number=None):
    """How often a row is drawn; without ``number``, its number among its equals, how often the first
    of them is."""
    h, number = F.col("h") if h is None else h, F.lit(1) if number is None else number
    once = _drawn(h, F.col(f"{prefix}b"), F.col(f"{prefix}last"))
    part = F.coalesce((h == F.col(f"{prefix}cross")) & (number <= F.col(f"{prefix}some")), F.lit(False))
    more = F.coalesce((h == F.col(f"{prefix}fix")) & (number <= 1), F.lit(False))
    return F.col(f"{prefix}rounds") + (once | part | more).cast("int")


def _numbered(placed: DataFrame, keys: DataFrame, h: str) -> DataFrame:
    """``placed`` with mix_rule_number: 1, 2, ... over the equal rows at a place that is drawn in part,
    and 1 elsewhere. Such rows are numbered task by task of the scan, after those of the tasks before, so equal rows
    do not meet in one task; without any, nothing moves."""
    at = F.coalesce((F.col("h") == F.col("cross")) & (F.col("some") > 0) | (F.col("h") == F.col("fix")), F.lit(False))
    tied = cut(keys.where(at).groupBy("sid", "h", "task").agg(F.count(F.lit(1)).alias("m")))
    if not tied.groupBy("sid", "h").agg(F.sum("m").alias("m")).where("m > 1").head(1):
        return placed.withColumn("mix_rule_number", F.lit(1).cast("long"))
    before = F.sum("m").over(Window.partitionBy("sid", "h").orderBy("task")) - F.col("m")
    tied = cut(tied.select(F.col("sid").alias("t_sid"), F.col("h").alias("t_h"), F.col("task").alias("t_task"), before.alias("t_before")))
    mine = F.coalesce((F.col(h) == F.col("mix_rule_cross")) & (F.col("mix_rule_some") > 0) | (F.col(h) == F.col("mix_rule_fix")), F.lit(False))
    own = F.row_number().over(Window.partitionBy("mix_rule_sid", h, "mix_rule_task").orderBy(F.lit(1)))
    some = placed.where(mine).join(tied, (F.col("mix_rule_sid") == F.col("t_sid")) & (F.col(h) == F.col("t_h")) & (F.col("mix_rule_task") == F.col("t_task")))
    some = some.withColumn("mix_rule_number", own + F.col("t_before")).drop("t_sid", "t_h", "t_task", "t_before")
    return placed.where(~mine).withColumn("mix_rule_number", F.lit(1).cast("long")).unionByName(some)


def mix(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as it is drawn, with mix_shard, in
    random order inside each shard. A shard holds about 64 MB of text unless ``shards``
    says otherwise. Nulls, equal rows and too many sources as in :func:`mix_plan`; equal rows
    are drawn each for itself. Empty input: no rows."""
    if shards is None:
        text = options.get("text_col", "text")
        all_bytes = docs.agg(F.sum(F.octet_length(column(docs, text)))).first()[0] or 0
        shards = max(1, min(MAX_BLOCKS, math.ceil(all_bytes * options.get("share", SHARE) / 64e6)))
    plan = mix_plan(docs, shards=shards, **options)
    names = docs.columns
    shard, rnd = free_name(names, "mix_shard"), free_name(names, "mix_order")
    turns = plan.select(*[column(plan, c) for c in names], F.posexplode(column(plan, plan.columns[-1])).alias(rnd, shard))
    mixed = turns.withColumn(rnd, F.xxhash64(F.lit(options.get("seed", SEED) + 1), rnd, column(turns, options.get("id_col", "doc_id")),
                                             column(turns, options.get("text_col", "text"))))
    return mixed.repartitionById(shards, F.col(shard)).sortWithinPartitions(shard, rnd).drop(rnd)
