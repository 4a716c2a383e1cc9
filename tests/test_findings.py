"""Inputs on which a query once differed from its SQL or made rows with the square of a group."""

import datetime as dt
import random

import duckdb
import pytest

from tidewrack import bindings
from tidewrack.functions import text as X
from tidewrack.operators import versions as V


def against_sql(spark, folder, name, **tables):
    """A query's rows over small tables and those of its SQL, columns by name."""
    db = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got = bindings.queries()[name](spark, str(folder))
    cols = sorted(got.columns)
    want = db.execute(f"select {', '.join(cols)} from ({bindings.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr), sorted(want, key=repr)


def most(spark, make, metric="numOutputRows"):
    """What a query gives, and the most rows (or another metric) of a step of its plan."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = make()
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def of(node):
        held, below = node.metrics().get(metric), node.children()
        return max([held.get().value() if held.isDefined() else 0, *[of(below.apply(i)) for i in range(below.size())]])
    return got, of(df._jdf.queryExecution().executedPlan())


def orders(spark, rows):
    return spark.createDataFrame([(k, c, "O", d, "1-URGENT") for k, c, d in rows], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")


def test_a_story_of_any_day_can_be_told_on_another(spark, tmp_path):
    days = [dt.datetime(2001, 1, 1) + dt.timedelta(days=i % 3 - 1) for i in range(90)]
    got, want = against_sql(spark, tmp_path, "q_told_day", orders=orders(spark, [(k, k % 5, d) for k, d in enumerate(days)]))
    assert got == want and want


def test_stated_links_to_a_common_name_make_no_row_a_bearer(spark):
    n = 300
    people = spark.createDataFrame([(f"p{i}", "Ann Voss" if i % 2 else "Karl Stein", None, "", "wife of Ann Voss" if i % 3 else "husband of Karl Stein") for i in range(n)],
                                   "id string, name string, aliases array<string>, relation string, bio string")
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}", "spouse") for i in range(0, n - 1, 7)], "a string, b string, kind string")
    got, top = most(spark, lambda: X.attested_gaps(people, edges).select("id", "claim", "n"))
    linked = {(a, b) for i in range(0, n - 1, 7) for a, b in ((i, i + 1), (i + 1, i))}
    bears = {c: [i for i in range(n) if i % 2 == odd] for c, odd in (("ann voss", 1), ("karl stein", 0))}
    says = [(i, "ann voss" if i % 3 else "karl stein") for i in range(n)]
    want = sorted((f"p{i}", c, len(bears[c])) for i, c in says if i not in bears[c] and not any((i, j) in linked for j in bears[c]))
    assert sorted(map(tuple, got)) == want and want
    assert top <= 6 * n  # forms of names: two full, two first and two last a person at most
    lists = {r.claim: r.targets for r in X.attested_gaps(people, edges).collect()}
    assert lists == {c: sorted(f"p{i}" for i in b) for c, b in bears.items()}


def test_arriving_piles_meet_a_class_of_equal_piles_once(spark):
    n = 150
    schema = "batch_id string, fingerprint array<string>"
    pages = [f"p{i}" for i in range(10)]
    registry = spark.createDataFrame([(f"b{i:03}", pages) for i in range(n)] + [("c1", pages[2:] + ["q"]), ("c2", ["q", "q", "q", "q", None])], schema)
    arriving = spark.createDataFrame([(f"x{i:03}", pages[:8]) for i in range(n)] + [("y", pages[3:8] + ["q"]), ("z", ["q"]), ("b000", pages), ("b001", pages[1:]), ("e", []), ("u", [None])], schema)
    got, top = most(spark, lambda: V.register(registry, arriving).select("batch_id", "moved_from", "outcome"))
    want = [(f"x{i:03}", "b000", "re-associated") for i in range(n)] + [("y", "c1", "re-associated"), ("z", None, "new"), ("b000", None, "already-registered"), ("b001", None, "content-changed"), ("e", None, "new"), ("u", None, "new")]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top <= 25 * n


def moved(registry, arriving):
    """Whence each arriving pile of a new id comes, by a plain loop."""
    found = {}
    for i, f in arriving.items():
        if i not in registry:
            fit = [(-len(set(f) & set(g)), j) for j, g in registry.items() if len(set(f) & set(g)) >= max(1, len(f) // 2, len(g) // 2)]
            found[i] = min(fit)[1] if fit else None
    return found


def test_differing_piles_over_few_pages_are_rarely_compared(spark, monkeypatch):
    n, rng = 400, random.Random(7)
    registry = {f"b{i}": rng.sample(range(100), 10) for i in range(n)}
    arriving = {f"x{i}": f[1:] if i % 4 else rng.sample(range(100), 9) for i, f in enumerate(registry.values())}
    compared = spark.sparkContext.accumulator(0)

    def common(a, b):
        compared.add(1)
        return [v for v in a if v in b]
    monkeypatch.setattr(V.F, "array_intersect", V.F.udf(common, "array<bigint>"))
    df = lambda piles: spark.createDataFrame([(i, [str(v) for v in f]) for i, f in piles.items()], "batch_id string, fingerprint array<string>")
    got = V.register(df(registry), df(arriving)).select("batch_id", "moved_from").collect()
    assert dict(map(tuple, got)) == moved(registry, arriving)
    assert compared.value <= n * n // 5


@pytest.mark.parametrize("rare", [0, 5, 64])
def test_piles_of_all_sizes_meet_their_best(spark, monkeypatch, rare):
    rng = random.Random(rare)
    sizes = [1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 24, 27, 30, 50, 79, 82, 84, 90]
    registry = {f"b{i}": rng.sample(range(100 + 30 * (i % 3)), sizes[i % len(sizes)]) for i in range(180)}
    arriving = {}
    for i, f in enumerate(registry.values()):
        kept = [v for v in f if rng.random() < (0.5, 0.8, 1)[i % 3]]
        arriving[f"x{i}"] = kept + rng.sample(range(100, 500), rng.randrange(len(f) + 1)) + kept[:i % 2]
    monkeypatch.setattr(V, "RARE", rare)
    df = lambda piles: spark.createDataFrame([(i, [str(v) for v in f]) for i, f in piles.items()], "batch_id string, fingerprint array<string>")
    got = V.register(df(registry), df(arriving)).select("batch_id", "moved_from").collect()
    want = moved(registry, arriving)
    assert dict(map(tuple, got)) == want and len(got) == len(arriving)
    assert 60 < sum(v is not None for v in want.values()) < 180


def test_pairs_of_piles_carry_no_text(spark):
    n, size = 120, 4_000
    lines = spark.createDataFrame([(i, "common") for i in range(n)] + [(i, f"{i} " * size) for i in range(n)] + [(n, "common"), (n, "0 " * size), (n + 1, "lone")], "pile int, part string")
    got, held = most(spark, lambda: V.pile_overlap(lines, "pile", "part"), "dataSize")
    assert sorted(map(tuple, got)) == sorted([(a, b, 2 if (a, b) == (0, n) else 1) for a in range(n + 1) for b in range(a + 1, n + 1)])
    assert held < n * size


def test_markers_that_begin_alike_meet_few_texts(spark):
    n = 400
    texts = spark.createDataFrame([(i, f"from (Customer#{i:09}), x; (Ada-{i % 5}) {'Ada' if i % 2 else 'ada'}") for i in range(n)], "k int, t string")
    markers = spark.createDataFrame([(f"Customer#{i:09}",) for i in range(0, 2 * n, 3)] + [("Ada-3",), ("Ada Customer",), ("Customer#00000000",), ("##",)], "marker string")
    got, top = most(spark, lambda: X.offenders(texts, "k", "t", markers))
    assert sorted(map(tuple, got)) == sorted([(i, f"Customer#{i:09}") for i in range(0, n, 3)] + [(i, "Ada-3") for i in range(n) if i % 5 == 3])
    assert top <= 10 * n
