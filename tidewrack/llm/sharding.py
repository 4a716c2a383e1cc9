"""Sharding by histogram sort.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand together. The
driver looks for the keys that cut the order into shards of equal bytes: it proposes
candidate boundaries, the partitions count the exact bytes and rows below each, and only the
intervals in which a splitter still lies are probed again, until every splitter is within
tolerance or no finer boundary exists. Then all rows move once, straight to their place.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import column, cut, free_name, utf8_bytes

SHARDS = 24
#: A row weighs its UTF-8 bytes and this many more.
ROW_BYTES = 8
#: A shard may end this fraction of a shard away from its exact place.
TOLERANCE = 0.01
#: A splitter inside a group of equal texts goes to the nearer end of it, if that is at most this fraction of a shard away.
WHOLE = 0.25
#: A unit that a task sorts may end this fraction of a unit away from its place.
UNIT_TOLERANCE = 0.1
#: Bits of the key that one round of probes resolves, fewer where many splitters are open: the driver sees MAX_PROBES counts a round.
STEP_BITS = 12
MAX_PROBES = 2**21
#: Inside a shard, a task sorts about this many bytes.
TASK_BYTES = 128 * 2**20
_KEY_BITS = 128  # the text's hash, then the id's


@dataclass
class _Gap:
    """A key interval: the ``bits`` first bits of the key are ``prefix``; ``below`` and
    ``rows`` are the exact bytes and rows before it; targets in it are not settled."""

    prefix: int
    bits: int
    below: int
    rows: int
    aims: list[int] = field(default_factory=list)


def _top(bits: int, step: int) -> F.Column:
    """The bits of the 128-bit key after the first ``bits``, ``step`` of them, as a long."""
    def one(name: str, start: int, n: int):
        return F.shiftrightunsigned(F.shiftleft(name, start), 64 - n)
    if bits < 64:
        return one("k1", bits, step)
    return one("k2", bits - 64, step)


def splitters(keys: DataFrame, aims_at: list[float], slack: list[float], whole: list[float]) -> list[tuple[int, int, int]]:
    """For each wanted byte position the (key, bytes below, rows below) of a boundary within
    its ``slack`` bytes of it, else of one between texts within ``whole`` bytes, else the nearest
    one that exists. ``keys`` has k1, k2, n."""
    found: dict[int, tuple[int, int, int]] = {}
    gaps = [_Gap(0, 0, 0, 0, list(range(len(aims_at))))]
    while gaps:
        bits = gaps[0].bits
        step = min(max(2, min(STEP_BITS, (MAX_PROBES // len(gaps)).bit_length() - 1)), (64 if bits < 64 else _KEY_BITS) - bits)
        bins = keys.withColumn("bin", _top(bits, step))
        if bits:
            table = [(_signed(g.prefix >> (bits - 64) if bits > 64 else g.prefix << (64 - bits)),
                      _signed((g.prefix << (_KEY_BITS - bits)) & (2**64 - 1)) if bits > 64 else 0, i) for i, g in enumerate(gaps)]
            known = keys.sparkSession.createDataFrame(table, T._parse_datatype_string("p1 long, p2 long, gap int"))
            mask1 = -1 if bits >= 64 else _signed((2**64 - 1) ^ (2 ** (64 - bits) - 1))
            mask2 = 0 if bits <= 64 else _signed((2**64 - 1) ^ (2 ** (_KEY_BITS - bits) - 1))
            bins = bins.join(F.broadcast(known), (F.col("k1").bitwiseAND(F.lit(mask1)) == F.col("p1")) & (
                F.col("k2").bitwiseAND(F.lit(mask2)) == F.col("p2")))  # one row per open splitter at most
        else:
            bins = bins.withColumn("gap", F.lit(0))
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in bins.groupBy("gap", "bin").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).collect():
            counts.setdefault(r.gap, {})[r.bin] = (r.n, r.c)
        later = []
        for i, g in enumerate(gaps):
            edges, inside = [(g.prefix << step, g.below, g.rows)], sorted(counts.get(i, {}).items())
            for b, (n, c) in inside:
                edges.append(((g.prefix << step) + b + 1, edges[-1][1] + n, edges[-1][2] + c))
            places = [e[1] for e in edges]
            open_: dict[int, _Gap] = {}
            for a in g.aims:
                k = max(0, bisect_right(places, aims_at[a]) - 1)
                near = min(edges[k:k + 2], key=lambda e: abs(e[1] - aims_at[a]))
                away = abs(near[1] - aims_at[a])
                if away <= slack[a] or bits + step == 64 and away <= whole[a] or bits + step == _KEY_BITS or k + 1 == len(edges):
                    found[a] = (near[0] << (_KEY_BITS - bits - step), near[1], near[2])
                else:
                    b = inside[k][0]
                    open_.setdefault(b, _Gap((g.prefix << step) + b, bits + step, edges[k][1], edges[k][2])).aims.append(a)
            later += open_.values()
        gaps = later
    return [found[i] for i in range(len(aims_at))]


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot (0, 1, ... without gaps in each shard), stored by
    shard and slot. Clashing names get underscores.

    Shards have equal bytes to within ``tolerance`` of a shard at either end, or to within half a
    group of equal texts that lies across the end. Equal texts share a shard unless they make
    more than half of one (twice WHOLE), when the group is cut between ids; rows equal in text and
    id are never parted. Null texts count as no bytes and stand together. Empty input: no rows.
    """
    names = docs.columns
    size, at, slot = (free_name(names, x) for x in ("size", "shard", "slot"))
    k1, k2, unit = (free_name([*names, size, at, slot], x) for x in ("shard_k1", "shard_k2", "shard_unit"))
    text = column(docs, text_col)
    keyed = docs.withColumns({
        size: utf8_bytes(text) + ROW_BYTES,
        k1: F.xxhash64(F.isnull(text), text),
        k2: F.xxhash64(F.lit(7), column(docs, id_col)),
    })
    keys = cut(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(size).alias("n")))
    total, rows = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, math.ceil(total / shards / TASK_BYTES))
    wanted = [total * i / (shards * parts) for i in range(1, shards * parts)]
    one, unit_bytes = total / shards, total / (shards * parts)
    slack = [tolerance * one if i % parts == 0 else UNIT_TOLERANCE * unit_bytes for i in range(1, shards * parts)]
    whole = [WHOLE * one if i % parts == 0 else UNIT_TOLERANCE * unit_bytes for i in range(1, shards * parts)]
    ends = splitters(keys, wanted, slack, whole) if wanted else []
    bounds = [(0, 0, 0), *ends[parts - 1::parts], (2**_KEY_BITS, total, rows)]
    ends = [min(max(e, bounds[i // parts]), bounds[i // parts + 1]) if i % parts else e for i, e in enumerate(ends, 1)]  # a shard's end may lie before units that it was to follow
    # bounds of the units a task sorts: (first key, shard, rows of the shard before it)
    starts, first = [(0, 0, 0)], 0
    for i, (key, _, below) in enumerate(ends, 1):
        if i % parts == 0:
            first = below
        starts.append((key, i // parts, below - first))
    lead: dict[int, list[tuple[int, int]]] = {}
    for i, (key, _, _) in enumerate(starts):
        lead.setdefault(key >> (_KEY_BITS - STEP_BITS), []).append((key, i))
    table, upto = [], 0
    for b in range(2**STEP_BITS):  # what each first probe interval needs to place its rows
        inside = [(_signed((key >> 64) ^ (1 << 63)), _signed((key & (2**64 - 1)) ^ (1 << 63))) for key, _ in sorted(lead.get(b, []))]
        table.append((b, upto, inside))
        upto += len(inside)
    spark = docs.sparkSession
    lut = spark.createDataFrame(table, T._parse_datatype_string("lut_bin long, lut_base int, lut_in array<struct<a:long,b:long>>"))
    units = spark.createDataFrame([(i, s, n) for i, (_, s, n) in enumerate(starts)], T._parse_datatype_string("u_id int, u_shard int, u_rows long"))
    flip = F.lit(-(2**63))
    x1, x2 = F.col(k1).bitwiseXOR(flip), F.col(k2).bitwiseXOR(flip)
    placed = keyed.join(F.broadcast(lut), F.shiftrightunsigned(k1, 64 - STEP_BITS) == F.col("lut_bin"))  # 4,096 rows
    placed = placed.withColumn(unit, F.col("lut_base") - 1 + F.size(F.filter(
        "lut_in", lambda s: (s["a"] < x1) | ((s["a"] == x1) & (s["b"] <= x2))))).drop("lut_bin", "lut_base", "lut_in")
    moved = placed.repartitionById(shards * parts, F.col(unit))
    order = Window.partitionBy(unit).orderBy(k1, k2)
    moved = moved.withColumn(slot, F.row_number().over(order).cast("long"))
    moved = moved.join(F.broadcast(units), F.col(unit) == F.col("u_id"))  # a row for each task's unit
    return moved.select(*[F.col(f"`{c}`") for c in names], F.col(size), F.col("u_shard").alias(at),
                        (F.col(slot) - 1 + F.col("u_rows")).alias(slot))
