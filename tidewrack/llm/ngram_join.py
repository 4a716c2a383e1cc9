"""N-gram Jaccard self-join with token-combination prefixes.

A document is its set of distinct word shingles. Sets are compared in one order of all
shingles: rare ones first, then the frequent ones by count. Two sets that are similar enough
share a signature of their prefixes: rare shingles are indexed alone; of frequent shingles
only pairs within the same class are indexed, and prefixes are extended until no number of
differing shingles that the threshold allows can spoil every signature. Candidates are
verified exactly, and linked documents get the smallest id of their component.

Counts cover all documents and only steer cost: any order of the shingles gives the same
links. Equal sets are joined once. Documents that share a signature are all paired while they
are few; a large group is first linked to its most central member, and only pairs that are
still in different components are compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, cut, free_name
from .shingles import mix64, shingle_sets

WORDS = 4
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A shingle of this many distinct sets is frequent ...
FREQUENT = 16
#: ... if it is among this many with the highest counts; the table of them, 12 bytes each, goes to every executor.
TABLE_ROWS = 1 << 20
#: Groups up to this size are paired in full at once.
SMALL_GROUP = 64
#: All open pairs of large unsettled groups are compared at once if they are no more than this many for each row in such a group;
#: else the groups are linked to more members first, twice as many every round, and what that has joined is not open any more.
OPEN_PAIRS = 64
#: Documents of candidate pairs are picked from the corpus by broadcast up to this many ids, 16 MB; by shuffle beyond it.
BROADCAST_IDS = 1_000_000
#: Ranges of folds in which shingles are counted: so many that one holds about this many, and at least 256.
RANGE_FOLDS = 2_000_000
#: Longs of the parity bitmap of a set: what differs between two bitmaps differs between the sets.
_BITMAP = 16


def _width(percent: int) -> float:
    """Sizes of linked sets differ by less than this factor, so they are in the same band or neighbours."""
    return 100 / (percent - 1)


def overlap(a, b, percent: int = PERCENT):
    """The smallest intersection that links sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def _key(s: np.ndarray) -> int:
    return int(mix64(s).sum().view(np.int64))


def _bitmap(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(7)).astype(np.int64) % (64 * _BITMAP), minlength=64 * _BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_rows(k: int):
    """Size, key, second hash and bitmap of every document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), _key(s), int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0, _bitmap(s)) for s in shingle_sets(batch.column(1), k)]
            n, k1, k2, bits = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                                              pa.array(list(bits), pa.list_(pa.int64()))], ["id", "n", "k1", "k2", "bits"])
    return run


def _new_sets(batches, column: int, k: int):
    """For each batch the (row, set, key) of the sets that are the first of their kind in this
    task. What it remembers is a number for each distinct set of the task's input."""
    seen: set[int] = set()
    for batch in batches:
        fresh = []
        for i, s in enumerate(shingle_sets(batch.column(column), k)):
            if len(s) and (key := _key(s)) not in seen:
                seen.add(key)
                fresh.append((i, s, key))
        yield fresh


def _folded(k: int, bits: int):
    """A row per range of 32-bit shingle folds and batch: the sorted folds as differences, one
    byte plane after another, which the shuffle's compression halves."""
    def run(batches):
        for fresh in _new_sets(batches, 0, k):
            f = np.sort((np.concatenate([s for _, s, _ in fresh]) >> np.uint64(32)).astype(np.uint32)) if fresh else np.zeros(0, np.uint32)
            own = f >> np.uint32(32 - bits)
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(f) else np.zeros(0, np.int64)
            parts = [(int(own[a]), np.diff(f[a:b], prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) for a, b in zip(start.tolist(), np.append(start[1:], len(f)).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["range", "folds"])
    return run


def _counted(least: int):
    """Counts of a partition's folds; a range is whole in one partition, ranges in order."""
    def run(batches):
        held, current = [], None

        def out():
            f, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(f[c >= least].astype(np.int64)), pa.array(c[c >= least].astype(np.int64))], ["fold", "n"])
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if r != current and held:
                    yield out()
                    held = []
                current = r
                planes = np.frombuffer(blob, np.uint8).reshape(4, -1).T
                held.append(np.cumsum(np.ascontiguousarray(planes).view("<u4").ravel(), dtype=np.uint32))
        if held:
            yield out()
    return run


def _band(n: int, percent: int) -> int:
    return int(np.log(n) / np.log(_width(percent)))


def _classes(band: int, percent: int) -> int:
    """How many classes the frequent shingles of sets in this size band have."""
    return max(1, int(_width(percent) ** band) // 16)


def signatures(s: np.ndarray, count: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, rank) of a set with the counts of its shingles (0: rare). The rank is the
    number of differing shingles that spoil all signatures before it."""
    n = len(s)
    budget = n - -(-percent * n // 100)
    rare = s[count == 0]
    if len(rare) > budget:
        return rare[:budget + 1], np.arange(budget + 1)
    sig, rank = [rare], [np.arange(len(rare))]
    often = np.flatnonzero(count > 0)
    often = often[np.lexsort((s[often], count[often]))]
    scramble = mix64(s[often])
    for band in (_band(n, percent), _band(n, percent) - 1):
        seen: dict[int, list[int]] = {}
        spoil = len(rare)
        cls = (scramble % np.uint64(_classes(band, percent))).tolist()
        new, at = [], []
        for i, c in enumerate(cls):
            if spoil > budget:
                break
            mates = seen.setdefault(c, [])
            new += [(j, i) for j in mates]
            at += [spoil] * len(mates)
            spoil += bool(mates)
            mates.append(i)
        if new:
            i, j = np.array(new).T
            both = scramble[i] + scramble[j]  # the order of the two does not matter
            sig.append(mix64(both + np.uint64((2 * band + 2001) * 0x9E3779B97F4A7C15 % 2**64)))
            rank.append(np.array(at))
    return np.concatenate(sig), np.concatenate(rank)


def _signature_rows(k: int, percent: int, table):
    def run(batches):
        fold, times = table.value
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        for fresh in _new_sets(batches, 0, k):
            sig, rank, rep, size = [], [], [], []
            for _, s, key in fresh:
                if len(s) * (100 - percent) < percent:  # links with nothing but its equal
                    continue
                f = (s >> np.uint64(32)).astype(np.uint32)
                at = np.minimum(np.searchsorted(fold, f), max(0, len(fold) - 1))
                count = np.where(fold[at] == f, times[at], 0) if len(fold) else np.zeros(len(s), np.int64)
                g, r = signatures(s, count, percent)
                sig.append(g)
                rank.append(r)
                rep.append(np.full(len(g), key, np.int64))
                size.append(np.full(len(g), len(s), np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(cat(sig, np.uint64).view(np.int64)), pa.array(cat(rep, np.int64)), pa.array(cat(size, np.int32)), pa.array(cat(rank, np.int32))],
                ["sig", "rep", "n", "rank"])
    return run


def _grouped(percent: int):
    """Pairs and members of large groups from rows sorted by (sig, rank, rep), in which equal
    rows are one. Holds at most SMALL_GROUP rows of a group across batches."""
    def fits(na, ra, nb, rb):
        o = overlap(na, nb, percent)
        return (ra <= na - o) & (rb <= nb - o)

    def rows(kind, a, b, at=None, n=None, rank=None):
        m = len(a)
        zero = np.zeros(m, np.int32)
        pick = lambda x: pa.array(zero if x is None else x.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(a), pa.array(b), pick(at), pick(n), pick(rank)],
                                          ["kind", "a", "b", "at", "n", "rank"])

    def pairs(x, y):
        """x, y: rows (sig, rep, n, rank) of equal length."""
        ok = fits(x[2], x[3], y[2], y[3]) & (x[1] != y[1])
        a, b = np.minimum(x[1], y[1])[ok], np.maximum(x[1], y[1])[ok]
        return np.stack([a, b])

    def run(batches):
        held = [np.zeros(0, np.int64)] * 4
        big, centre, done = None, None, 0  # a large group under way
        last_row = None

        def star(part):
            nonlocal done
            m = len(part[0])
            at = np.arange(done, done + m)
            done += m
            return pairs(tuple(np.full(m, v) for v in centre), part), rows(1, part[0], part[1], at, part[2], part[3])
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            if not len(new[0]):
                continue
            once = np.ones(len(new[0]), bool)
            once[1:] = (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])
            once[0] = last_row != (new[0][0], new[1][0])
            last_row = (new[0][-1], new[1][-1])
            new = [c[once] for c in new]
            found = []
            if big is not None:
                m = int(np.searchsorted(new[0], big, "right"))
                p, members = star([c[:m] for c in new])
                found.append(p)
                yield members
                new = [c[m:] for c in new]
                if not len(new[0]):
                    for p in found:
                        yield rows(0, *np.unique(p, axis=1))
                    continue
                big = None
            x = [np.concatenate([h, c]) for h, c in zip(held, new)]
            starts = np.flatnonzero(np.concatenate(([True], x[0][1:] != x[0][:-1]))) if len(x[0]) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(x[0])))
            for s, m in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist()):
                part = [c[s:s + m] for c in x]
                centre, done = tuple(c[0] for c in part), 0
                p, members = star(part)
                found.append(p)
                yield members
                if s + m == len(x[0]):
                    big = centre[0]
            last = len(x[0]) if big is not None or not len(starts) else int(starts[-1])
            small = np.repeat(sizes <= SMALL_GROUP, sizes)[:last]
            y = [c[:last][small] for c in x]
            d = 1
            while d < len(y[0]):
                same = np.flatnonzero(y[0][d:] == y[0][:-d])
                if not len(same):
                    break
                found.append(pairs([c[same] for c in y], [c[same + d] for c in y]))
                d += 1
            held = [c[last:] for c in x]
            if found and sum(p.shape[1] for p in found):
                yield rows(0, *np.unique(np.concatenate(found, axis=1), axis=1))
        d = 1
        while d < len(held[0]):
            yield rows(0, *pairs([c[d:] for c in held], [c[:-d] for c in held]))
            d += 1
    return run


def _verified(pairs: DataFrame, classes: DataFrame, plain: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of set keys those that link, as ids (u, v). Bitmaps, which never
    part a pair that links, come before the sets themselves."""
    def side(key: str):
        return classes.select(F.col("k1").alias(key), F.col("rep").alias(f"{key}_rep"), F.col("n").alias(f"{key}_n"), F.col("bits").alias(f"{key}_bits"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("a_rep <> b_rep")
    least = F.ceil(percent * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))
    apart = sum((F.bit_count(F.get("a_bits", i).bitwiseXOR(F.get("b_bits", i))) for i in range(_BITMAP)), F.lit(0))
    left = cut(both.where(apart <= F.col("a_n") + F.col("b_n") - 2 * least).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")))
    nodes = cut(left.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1), k)], pa.list_(pa.int64()))], ["rep", "s"])
    own = cut(plain.join(nodes, "rep", "left_semi").mapInArrow(sets, "rep long, s array<long>"))
    full = left.join(own.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(own.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.where((F.lit(100) + percent) * common >= percent * (F.size("sa") + F.size("sb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def link(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, n_shingles, component_id (the smallest id reachable by
    links, its own included).

    Texts are lower-cased in A-Z. Null and blank texts have no shingles and link with nothing.
    Rows with equal ids are one document. A row with a null id gets the component of its
    equals, or null. Other columns are ignored. Empty input: no rows.
    """
    spark = docs.sparkSession
    plain = docs.select(column(docs, id_col).cast("long").alias("rep"), column(docs, text_col).alias("text"))
    rows = cut(plain.mapInArrow(_set_rows(k), "id long, n long, k1 long, k2 long, bits array<long>"))
    classes = cut(rows.where("n > 0 and id is not null").groupBy("n", "k1", "k2").agg(F.min(F.struct("id", "bits")).alias("x")).select(
        "n", "k1", "k2", F.col("x.id").alias("rep"), "x.bits"))
    texts = plain.where("rep is not null").select("text")
    # counts of shingles over all sets
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(24, max(8, (shingles // RANGE_FOLDS).bit_length()))
    tasks = min(bits, 13)  # a task handles its ranges one after the other
    spread = texts.mapInArrow(_folded(k, bits), "range int, folds binary").repartitionById(1 << tasks, F.shiftright("range", bits - tasks)).sortWithinPartitions("range")
    counts = spread.mapInArrow(_counted(FREQUENT), "fold long, n long").orderBy(F.desc("n"), "fold").limit(TABLE_ROWS).toPandas().sort_values("fold")
    table = spark.sparkContext.broadcast((counts["fold"].to_numpy(np.uint32), counts["n"].to_numpy(np.int64)))
    sigs = texts.mapInArrow(_signature_rows(k, percent, table), "sig long, rep long, n int, rank int")
    sigs = sigs.repartition("sig").sortWithinPartitions("sig", "rank", "rep")
    found = cut(sigs.mapInArrow(_grouped(percent), "kind int, a long, b long, at int, n int, rank int"))
    pairs = cut(found.where("kind = 0").select("a", "b").distinct())
    edges = cut(_verified(pairs, classes, plain, k, percent))
    labels = components(edges)
    members = found.where("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("k1"), "at", "n", "rank")
    tried, done, pivots = pairs, 1, 1
    while members.head(1):
        place = classes.select("k1", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("k1", F.coalesce("component", "rep").alias("component"))
        known = cut(members.join(place, "k1"))
        # what is open: groups of several components, and in them rows that a partner of the group's smallest size could reach
        split = known.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least")).where("lo < hi")
        near = known.join(split, "sig").where(F.col("rank") <= F.col("n") - F.ceil(percent * (F.col("n") + F.col("least")) / F.lit(100 + percent)))
        open_ = cut(near.select(*known.columns))
        mixed = open_.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg((F.pow(F.sum("c"), 2) - F.sum(F.pow("c", 2))).alias("p"), F.sum("c").alias("m"))
        bound, rows_open = mixed.agg(F.coalesce(F.sum("p") / 2, F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if not bound:
            break
        last = bound <= OPEN_PAIRS * rows_open
        x, y = open_.alias("x"), open_.alias("y")
        o = F.expr(f"ceil({percent} * (x.n + y.n) / {100 + percent})")
        may = (F.col("x.component") != F.col("y.component")) & (F.col("x.rank") <= F.col("x.n") - o) & (F.col("y.rank") <= F.col("y.n") - o)
        one = F.col("x.at") >= done if last else F.col("x.at").between(done, done + pivots - 1)
        more = x.join(y, (F.col("x.sig") == F.col("y.sig")) & one & (F.col("y.at") > F.col("x.at")) & may).select(
            F.least("x.k1", "y.k1").alias("a"), F.greatest("x.k1", "y.k1").alias("b")).distinct()
        more = cut(more.join(tried, ["a", "b"], "left_anti"))
        if more.head(1):
            edges = cut(edges.unionByName(_verified(more, classes, plain, k, percent)))
            labels = components(edges)
            tried = tried.unionByName(more)
        if last:
            break
        done, pivots = done + pivots, 2 * pivots
        members = open_.where(F.col("at") >= done).drop("component")  # what is joined stays joined, and the pivots have met all
    place = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "k1", "k2", F.coalesce("component", "rep").alias("component_id"))
    full = rows.where("n > 0").join(place, ["n", "k1", "k2"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each component, that with the smallest id; rows equal to a kept one in
    id count as the same document and one of them stays. Rows with a null id stay."""
    key = free_name(docs.columns, "kept_id")
    kept = link(docs, id_col=id_col, **options).where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    named = docs.where(column(docs, id_col).isNotNull())
    stay = named.join(kept, column(named, id_col).cast("long") == F.col(key), "left_semi").dropDuplicates([id_col])
    return stay.unionByName(docs.where(column(docs, id_col).isNull()))
