"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into BLOCKS blocks. Two vectors at squared distance D or
less are at D / BLOCKS or less in at least one block, so each block is range-joined under its
share of the budget: a grid over the block's first GRID_DIMS coordinates brings near vectors
together, full block distances choose the candidates, and the cosine in double precision
verifies them. A pair counts in the first block that finds it.

Equal vectors are one class. Cells are dealt to tasks in chunk pairs, so no task holds more
than two chunks, and a task gives a link count and a local root per vector, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, components, cut

COSINE = 0.9
BLOCKS = 4
GRID_DIMS = 2
#: Rows of a cell that meet in a task, from either side.
CHUNK = 16_384
_TILE = 2_048
#: The grid and the block budget are this much wider than exact, for rounding.
_SLACK = 1e-3
SEED = 7


@lru_cache(8)
def _rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((dim, dim)))[0]


def _turned(raw: np.ndarray, seed: int) -> np.ndarray:
    x = raw.astype(np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ _rotation(x.shape[1], seed)).astype(np.float32)


def _edges(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).astype(int)


def _budget(cosine: float, dim: int, blocks: int) -> np.ndarray:
    """Squared-distance budget of each block, in proportion to its dimensions."""
    e = _edges(dim, blocks)
    return (2 - 2 * cosine) * np.diff(e) / dim


def _vectors(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each vector length of a batch."""
    lists = batch.column(batch.schema.get_field_index(name))
    size = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield rows, flat[start[rows][:, None] + np.arange(d)]


def _cells(cosine: float, blocks: int, grid: int, seed: int, kind: str, deal: dict | None):
    """Rows (task key, side, rep, n, v). Without ``deal`` only counts per cell and side."""
    near = [o for o in product((-1, 0, 1), repeat=grid) if o > (0,) * grid]

    def run(batches):
        for batch in batches:
            rep = batch.column(0).to_numpy(zero_copy_only=False)
            count = batch.column(1).to_numpy(zero_copy_only=False)
            for rows, raw in _vectors(batch, "v"):
                d = raw.shape[1]
                y, e, budget = _turned(raw, seed), _edges(d, blocks), _budget(cosine, d, blocks)
                out = {k: [] for k in ("key", "side", "row")}
                for b in range(len(budget)):
                    lead = y[:, e[b]:min(e[b] + grid, e[b + 1])]
                    cell = np.floor(lead / (np.sqrt(budget[b]) * (1 + _SLACK))).astype(int)
                    cell = np.pad(cell, ((0, 0), (0, grid - cell.shape[1])))
                    for side, move in [(0, (0,) * grid), *[(1, o) for o in near]]:
                        to, at = np.unique(cell + np.array(move), axis=0, return_inverse=True)
                        for i, c in enumerate(to.tolist()):
                            mine = np.flatnonzero(at.ravel() == i)
                            name = (d, b, *c)
                            if deal is None:
                                out["key"].append(":".join(map(str, name)))
                                out["side"].append(side)
                                out["row"].append(len(mine))
                                continue
                            home, guests = deal.get(name, (0, 0))
                            if not home:  # no one lives there
                                continue
                            chunk = (rep[rows[mine]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(int) % (guests if side else home)
                            for k in range(home):
                                for j in range(home if not side else guests):
                                    # task (k, j): home chunk k against home chunk j >= k, or against guest chunk j
                                    if side:
                                        pick = mine[chunk == j]
                                        out["key"].append(np.full(len(pick), f"{':'.join(map(str, name))}|g{k}.{j}", object))
                                        out["side"].append(np.ones(len(pick), np.int32))
                                        out["row"].append(pick)
                                    elif j >= k:
                                        for c2, s2 in ((k, 0), (j, 1)) if j > k else ((k, 0),):
                                            pick = mine[chunk == c2]
                                            out["key"].append(np.full(len(pick), f"{':'.join(map(str, name))}|h{k}.{j}", object))
                                            out["side"].append(np.full(len(pick), s2, np.int32))
                                            out["row"].append(pick)
                                if not side:
                                    pick = mine[chunk == k]
                                    for j in range(guests):
                                        out["key"].append(np.full(len(pick), f"{':'.join(map(str, name))}|g{k}.{j}", object))
                                        out["side"].append(np.zeros(len(pick), np.int32))
                                        out["row"].append(pick)
                if deal is None:
                    yield pa.RecordBatch.from_arrays([pa.array(out["key"]), pa.array(out["side"], pa.int32()), pa.array(out["row"], pa.int64())], ["key", "side", "n"])
                    continue
                if not out["row"]:
                    continue
                key, side, row = (np.concatenate(out[k]) for k in ("key", "side", "row"))
                for a in range(0, len(row), 20_000):
                    r = row[a:a + 20_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[a:a + 20_000], pa.string()), pa.array(side[a:a + 20_000], pa.int32()), pa.array(rep[rows[r]], pa.int64()),
                        pa.array(count[rows[r]], pa.int64()), pa.array([x.tobytes() for x in raw[r].astype(kind)], pa.binary())], ["key", "side", "rep", "n", "v"])
    return run


def _links(cosine: float, blocks: int, seed: int, kind: str):
    def run(key, table):
        name, meeting = key[0].as_py().split("|")
        d, b = map(int, name.split(":")[:2])
        side = table.column("side").to_numpy()
        rep, count = table.column("rep").to_numpy(), table.column("n").to_numpy()
        raw = np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(-1, d)
        e, budget = _edges(d, blocks), _budget(cosine, d, blocks) * (1 + _SLACK)
        y = _turned(raw, seed)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = meeting[0] == "h" and not len(right)
        if alone:
            right = left
        part = y[:, e[b]:e[b + 1]]
        half = (part * part).sum(1, keepdims=True) / 2
        one = np.ones_like(half)
        p, q = np.hstack([part, -half, one]), np.hstack([part, one, -half])
        exact = raw.astype(np.float64)
        exact /= np.abs(exact).max(axis=1, keepdims=True)
        norm = np.sqrt((exact * exact).sum(1))
        degree = np.zeros(len(rep), np.int64)
        found = []
        for s in range(0, len(left), _TILE):
            i0 = left[s:s + _TILE]
            for t in range(s if alone else 0, len(right), _TILE):
                j0 = right[t:t + _TILE]
                i, j = np.nonzero(p[i0] @ q[j0].T >= -budget[b] / 2 - 1e-5)
                if alone and s == t:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 65_536):
                    u, v = i0[i[c:c + 65_536]], j0[j[c:c + 65_536]]
                    gap = (y[u] - y[v]) ** 2
                    dist = np.add.reduceat(gap, e[:-1], axis=1)
                    first = (dist[:, b] <= budget[b]) & (dist[:, :b] > budget[:b]).all(1)
                    u, v = u[first], v[first]
                    cos = np.einsum("ij,ij->i", exact[u], exact[v]) / (norm[u] * norm[v])
                    u, v = u[cos >= cosine], v[cos >= cosine]
                    degree += np.bincount(u, count[v], len(rep)).astype(np.int64) + np.bincount(v, count[u], len(rep)).astype(np.int64)
                    found.append(_forest(u, v, len(rep)))
        if found:
            u, v = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        else:
            u = v = np.zeros(0, np.int64)
        label = _label(u, v, len(rep))
        low = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(low, label, rep)
        hit = np.flatnonzero(degree)
        return pa.table({"rep": rep[hit], "links": degree[hit], "root": low[label[hit]]})
    return run


def _label(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component label of each of n nodes."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At most one edge per node with the same components."""
    if len(u) < 1000:
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label = _label(at[:len(u)], at[len(u):], len(nodes))
    return nodes, nodes[label]


def link(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, grid: int = GRID_DIMS, seed: int = SEED,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per vector row: vec_id, n_links, component_id, kept.

    Vectors of different lengths do not link; null, empty and zero vectors and those with a
    null, NaN or infinite component link with nothing, nor do rows without an id. Ids are
    meant to be unique: vectors that share one share its links. Equal vectors are linked to
    each other. Other columns are ignored. Empty input: no rows.
    """
    kind = "<f4" if dict(vectors.select(column(vectors, vector_col).alias("v")).dtypes)["v"] == "array<float>" else "<f8"  # components keep their precision
    rows = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    sound = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.exists("v", lambda x: x != 0) & F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = cut(rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumns({
        "k1": F.when(F.col("sound"), F.xxhash64("v")), "k2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "v"))}))
    classes = cut(rows.where("sound").groupBy("k1", "k2", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    reps = classes.select("rep", "n", "v")
    counts = reps.mapInArrow(_cells(cosine, blocks, grid, seed, kind, None), "key string, side int, n long").groupBy("key", "side").agg(F.sum("n").alias("n"))
    deal: dict = {}
    for r in counts.collect():  # coordinates lie in [-1, 1], so there are at most blocks * (2 / radius + 3) ** grid cells a length
        deal.setdefault(tuple(map(int, r.key.split(":"))), [0, 0])[r.side] = -(-r.n // CHUNK)
    met = reps.mapInArrow(_cells(cosine, blocks, grid, seed, kind, deal), "key string, side int, rep long, n long, v binary")
    links = cut(met.groupBy("key").applyInArrow(_links(cosine, blocks, seed, kind), "rep long, links long, root long"))
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = classes.drop("v").join(degree, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where("sound").select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    single = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
