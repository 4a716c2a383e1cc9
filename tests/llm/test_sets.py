"""Hashing, near-duplicate join, substring and embedding operators against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewrack.llm import common, embedding_join, ngram_join, shingles, substring


def word_list(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall("[^\x20\x09-\x0D]+", low)


def text(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() > 0.3 else rng.choice(["the", "of", "and", "to"]) for _ in range(n))


def edited(rng, t, k):
    w = t.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_word_hashes_follow_the_words():
    texts = ["A b\x0bC", None, "", "  x  ", "b é\xa0z", "c"] * 3
    got = {}
    for row, at, h in shingles.word_hashes(pa.array(texts).slice(1)):
        for i in range(len(at) - 1):
            got[row + i] = h[at[i]:at[i + 1]].tolist()
    names = {}
    for i, t in enumerate(texts[1:]):
        own = word_list(t)
        assert len(own) == len(got[i])
        for w, x in zip(own, got[i]):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150), (7, 7)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 150: 100, 200: 100, **{x: 500 for x in range(500, 540)}}


@pytest.fixture(scope="module")
def families():
    rng = random.Random(5)
    rows, common_passage = [], text(rng, 40)
    for f in range(12):
        base = text(rng, rng.randrange(6, 300))
        rows += [base] + [edited(rng, base, min(len(base.split()) // 6, rng.randrange(0, 8))) for _ in range(rng.choice([0, 2, 5]))]
    hot = text(rng, 160)
    rows += [edited(rng, hot, rng.randrange(0, 9)) for _ in range(140)] + [hot] * 30
    rows += [text(rng, 60) + " " + common_passage for _ in range(40)] + ["a", "a b", "a b c", "A  B c", "", None, "a b c d e f", "a b c d e f g"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = word_list(t)
        sets[i] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, families, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)  # so that small fixtures have frequent shingles and large groups
    monkeypatch.setattr(ngram_join, "SMALL_GROUP", 8)
    monkeypatch.setattr(ngram_join, "OPEN_PAIRS", 0)
    df = spark.createDataFrame(families, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df, k, percent).collect()}
    assert got == brute(families, k, percent)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(6, 200))
        base = rng.choice(2**40, n, replace=False).astype(np.uint64)
        other = base.copy()
        drop = int(rng.integers(0, max(1, n // 12) + 1))
        other[:drop] = rng.choice(2**40, drop).astype(np.uint64) + np.uint64(2**41)
        common_n = len(np.intersect1d(base, other))
        if 100 * common_n < 85 * (2 * n - common_n):
            continue
        counts = {int(x): int(c) for x, c in zip(np.union1d(base, other), rng.choice([0, 20, 300], 2 * n))}
        for x in other:
            counts.setdefault(int(x), 0)
        one, two = (np.sort(s) for s in (base, other))
        sig = [ngram_join.signatures(s, np.array([counts[int(x)] for x in s])) for s in (one, two)]
        o = ngram_join.overlap(n, n)
        near = [set(g[r <= n - o].tolist()) for g, r in sig]
        assert near[0] & near[1]


@pytest.mark.parametrize("percent", [80, 85, 90])
def test_signatures_of_linked_sets_of_unequal_size_meet(percent):
    rng = np.random.default_rng(7)
    for n in list(range(5, 60)) + [80, 120, 399]:
        for m in sorted({n, n + 1, 100 * n // percent - 1, 100 * n // percent}):
            if m < n or 100 * n < percent * m:
                continue
            large = rng.choice(2**62, m, replace=False).astype(np.uint64)
            for few in (0.0, 0.3):
                count = np.where(rng.random(m) < few, 0, rng.choice([20, 300], m))
                one, two = (np.argsort(large[:c]) for c in (n, m))
                near = []
                for i in (one, two):
                    g, r = ngram_join.signatures(large[i], count[i], percent)
                    near.append(set(g[r <= len(i) - ngram_join.overlap(n, m, percent)].tolist()))
                assert near[0] & near[1], (n, m, few)


def test_copies_over_many_tasks_link_with_a_longer_version(spark):
    rng = random.Random(11)
    base = text(rng, 31)
    rows = [(i, base) for i in range(40)] + [(40, base + " " + text(rng, 6))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    assert {(r.doc_id, r.component_id) for r in ngram_join.link(df, 5, 80).collect()} == {(i, 0) for i in range(41)}


def test_smallest_sets_that_link_with_another(spark):
    words = [f"s{i}" for i in range(9)]
    rows = [(0, " ".join(words[:8])), (1, " ".join(words)), (2, " ".join(["t", *words[:8]])), (3, " ".join(words[:7]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80) == {0: (4, 0), 1: (5, 0), 2: (5, 0), 3: (3, 3)}


def test_ngram_join_edges(spark, awkward):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link(awkward).collect()}
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4), (6, 1, 6), (7, 1, 6), (None, 0, None)} <= got
    kept = ngram_join.deduplicate(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert ngram_join.link(awkward.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    shared, fuzzy = text(rng, 70), text(rng, 90)
    rows = [(i, text(rng, 120)) for i in range(40)]
    rows += [(100 + i, text(rng, 80) + " " + shared + " " + text(rng, 50)) for i in range(30)]
    rows += [(200 + i, text(rng, 60) + " " + edited(rng, fuzzy, 5) + " " + text(rng, 60)) for i in range(6)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (400, text(rng, 30) + " " + " ".join(shared.split()[:30]) + " " + text(rng, 30)), (500, None), (501, ""), (502, "x " * 400)]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    in_result = {r.doc_id for r in got} | {r.partner_id for r in got}
    assert set(range(100, 130)) <= in_result and set(range(200, 206)) <= in_result and {3, 300, 301} <= in_result
    assert not in_result & {*range(3), *range(4, 40), 400, 500, 501, 502}
    words = {i: word_list(t) for i, t in rows}
    for r in got:
        a, b = words[r.doc_id][r.start:r.end], words[r.partner_id][r.partner_start:r.partner_end]
        assert min(len(a), len(b)) >= 50 and len(set(a) & set(b)) >= 0.7 * len(set(a))
    rows_of = {tuple(r) for r in got if not r.copy}
    assert rows_of == {(p, ps, pe, d, s, e, *rest) for d, s, e, p, ps, pe, *rest in rows_of}  # each side has its row
    assert all(r.verbatim == (r.n_run >= 50) and r.n_run <= r.n_same for r in got) and all(r.verbatim for r in got if 100 <= r.doc_id < 130 or r.copy)
    assert {(r.doc_id, r.partner_id) for r in got if r.copy} == {(300, 3), (301, 3), (3, 300)}
    # every document with the shared passage is found with all of it, to within a word at either end
    for i in range(100, 130):
        spans = [(r.start, r.end) for r in got if r.doc_id == i]
        assert any(s <= 81 and e >= 149 for s, e in spans)


def test_chain_is_the_best_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        parts = [(rng.randrange(60), rng.randrange(60), rng.randrange(2, 9)) for _ in range(rng.randrange(1, 9))]
        best = 0.0

        def grow(last, gain):
            nonlocal best
            best = max(best, gain)
            for p in parts:
                if last is None:
                    grow(p, p[2])
                elif p[0] >= last[0] + last[2] and p[1] >= last[1] + last[2]:
                    gap = substring.GAP_COST * (p[0] - last[0] - last[2] + p[1] - last[1] - last[2])
                    grow(p, gain - gap + p[2])
        grow(None, 0.0)
        assert abs(substring.chain(parts)[0][0] - best) < 1e-9


def test_passages_recall_down_to_the_least_identity(spark):
    rng = random.Random(21)
    rows, kinds = [], [(n, how) for n in (50, 60, 100) for how in (5, 7, 10, 0.1, 0.15, 0.2) for _ in range(8)]
    for i, (n, how) in enumerate(kinds):
        w = [f"p{i}_{j}" for j in range(n)]
        places = range(how - 1, n, how) if how > 1 else rng.sample(range(n), int(n * how))
        v = list(w)
        for j in places:
            v[j] = f"c{i}_{j}"
        rows += [(2 * i, " ".join([text(rng, 80), *w, text(rng, 80)])), (2 * i + 1, " ".join([text(rng, 80), *v, text(rng, 80)]))]
    got = {(r.partner_id, r.doc_id) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    missed = [kinds[i] for i in range(len(kinds)) if (2 * i, 2 * i + 1) not in got]
    assert not missed
    assert got == {p for i in range(len(kinds)) for p in ((2 * i, 2 * i + 1), (2 * i + 1, 2 * i))}


def local_alignment(x, y):
    """Best local alignment of two word lists by brute force (equal 1, else -1): words on the longer side, equal words."""
    best = (0, 0, 0)
    row = [(0, 0, 0, 0)] * (len(y) + 1)  # score, words of x, words of y, equal ones
    for a in x:
        new = [(0, 0, 0, 0)]
        for j, b in enumerate(y):
            s, p, q, n = row[j]
            u, v = row[j + 1], new[j]
            new.append(max((s + (1 if a == b else -1), p + 1, q + 1, n + (a == b)), (u[0] - 1, u[1] + 1, u[2], u[3]), (v[0] - 1, v[1], v[2] + 1, v[3]), (0, 0, 0, 0)))
            s, p, q, n = new[-1]
            best = max(best, (s, max(p, q), n, min(p, q)) if s else best)
        row = new
    return best


def test_passages_recall_with_words_changed_and_left_out(spark):
    rng = random.Random(77)
    rows, due = [], set()
    kinds = [(n, share, how) for n in (55, 80, 150) for share in (0.0, 0.05, 0.1, 0.15) for how in ("changed", "left out", "both") for _ in range(4)]
    for i, (n, share, how) in enumerate(kinds):
        w = [f"p{i}_{j}" for j in range(n)]
        v = []
        for j, x in enumerate(w):
            hit = rng.random() < share
            if not hit:
                v.append(x)
            elif how == "changed" or how == "both" and rng.random() < 0.5:
                v.append(f"c{i}_{j}")
        rows += [(2 * i, " ".join([text(rng, 40), *w, text(rng, 40)])), (2 * i + 1, " ".join([text(rng, 40), *v, text(rng, 40)]))]
        _, long_side, equal, *short_side = local_alignment(w, v)
        if short_side and short_side[0] >= 50 and equal >= 0.8 * long_side:
            due.add((2 * i, 2 * i + 1))
    got = {(r.doc_id, r.partner_id) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(due) > 100 and len(due - got) <= len(due) // 100
    assert {(b, a) for a, b in got} == got and all(a // 2 == b // 2 for a, b in got)


def test_alignment_compares_the_words_of_its_seeds():
    x, y = np.arange(60, dtype=np.uint64), np.arange(60, dtype=np.uint64)
    y[10:14] += np.uint64(100)
    assert substring.align([(0, 0, 4), (10, 10, 4), (20, 20, 40)], x, y) == (0, 60, 0, 60, 56)


def test_longest_run_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = rng.integers(0, 3, 40).astype(np.uint64), rng.integers(0, 3, 40).astype(np.uint64)
        a, b = sorted(rng.integers(0, 41, 2).tolist()), sorted(rng.integers(0, 41, 2).tolist())
        off = int(rng.integers(-9, 10))
        parts = [(20, 20 + off, 4), (30, 30 + off, 2)]
        best = here = 0
        for i in range(a[0], a[1]):
            j = i + off
            here = here + 1 if b[0] <= j < b[1] and x[i] == y[j] else 0
            best = max(best, here)
        assert substring.longest_run(parts, tuple(a), tuple(b), x, y) == best


def test_packed_seeds_give_the_matches_of_their_groups():
    rng = np.random.default_rng(8)
    seed = np.sort(rng.integers(0, 2**63, 40)).astype(np.uint64) * np.uint64(2)
    texts, start, at = 30, [], 0
    rows = []  # (seed, place, text): seed i is in i texts, the first of them holds it twice
    for t in range(texts):
        start.append(at)
        own = [i for i in range(40) if t < i]
        rows += [(seed[i], at + 2 * i, t) for i in own] + [(seed[i], at + 200 + i, t) for i in own if t == 0]
        at += 300
    rows.sort(key=lambda r: r[1])
    rep = np.arange(100, 100 + texts)
    half = [r for r in rows if r[2] < 20], [r for r in rows if r[2] >= 18]  # two tasks, some texts in both
    sent = []
    for part in half:
        sent += list(substring._packed([(np.array([r[0] for r in part], np.uint64), np.array([r[1] for r in part], np.uint32), np.array(start, np.uint32), rep)], 2, False))
    sent.sort(key=lambda r: (r[0], -r[1]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[(r, k, d) for r, k, d in sent])], ["range", "kind", "data"])
    got = [r for b in substring._matches(2, False)([batch]) for r in b.to_pylist()]
    pairs = {(r["a"], r["b"], r["pa"], r["pb"]) for r in got if r["a"] < r["b"]}
    for i in range(2, 40):
        own = {(100 + s, 100 + t, 2 * i, 2 * i) for s in range(min(i, texts)) for t in range(s + 1, min(i, texts))}
        if i <= substring.FEW:
            assert own <= pairs
        else:  # all are tied together
            near = {100}
            for _ in range(40):
                near |= {x for a, b, p, q in own & pairs if a in near or b in near for x in (a, b)}
            assert len(near) == min(i, texts)
        assert any(p == 200 + i and a == 100 for a, b, p, q in pairs)  # the second place in the first text
    common = {(r["seed"], r["a"]) for r in got if r["a"] == r["b"]}
    many = [i for i in range(40) if min(i, texts) > substring.FEW]
    assert len(common) == sum(min(i, texts) for i in many)


def test_seeding_holds_few_seeds_at_once():
    rng = np.random.default_rng(12)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(100 * i, 100 * i + 100)), pa.array([" ".join(map(str, rng.integers(0, 10**6, 1000))) for _ in range(100)])], ["rep", "text"]) for i in range(20)]
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in substring._seeds(3, 50)(iter(batches))) >= 8
        assert tracemalloc.get_traced_memory()[1] < 110 << 20
    finally:
        tracemalloc.stop()


def test_passages_of_frequent_lines(spark):
    rng = random.Random(31)
    lines = [" ".join(f"l{i}_{j}" for j in range(12)) for i in range(8)]
    rows = [(i, text(rng, 40) + " " + lines[i % 8] + " " + text(rng, 40)) for i in range(160)]
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(3)]
    for (a, b), order in zip(pairs, ([0, 1, 2, 3, 4, 5, 6, 7], [3, 1, 6, 0, 7, 2, 5, 4], [7, 5, 2, 4, 1, 3, 0, 6])):
        w = " ".join(lines[i] for i in order).split()
        v = [f"c{a}_{i}" if i % 12 == 0 else x for i, x in enumerate(w)]  # so that every equal stretch is within a line
        rows += [(a, " ".join([text(rng, 30), *w, text(rng, 30)])), (b, " ".join([text(rng, 30), *v, text(rng, 30)]))]
    got = {(r.partner_id, r.doc_id) for r in substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}


def test_passages_that_share_only_seeds_of_a_frequent_line(spark):
    rng = random.Random(44)
    line = [f"l{j}" for j in range(10)]
    rows = [(i, " ".join([text(rng, 60), *line, text(rng, 60)])) for i in range(60)]
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(12)]
    for a, b in pairs:
        w = line + [f"p{a}_{j}" for j in range(40)]
        v = line + [f"c{a}_{j}" if j % 4 == 3 else x for j, x in enumerate(w[10:])]  # no 4 equal words in a row after the line
        rows += [(a, " ".join([text(rng, 60), *w, text(rng, 60)])), (b, " ".join([text(rng, 60), *v, text(rng, 60)]))]
    got = substring.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), complete=True).collect()
    assert {(r.partner_id, r.doc_id) for r in got} == {p for a, b in pairs for p in ((a, b), (b, a))}
    assert {(r.doc_id, r.class_id) for r in got} == {(x, a) for a, b in pairs for x in (a, b)}


def test_places_of_a_tile_meet_as_by_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(substring, "BITS", 512)
    base = rng.integers(0, 30_000, 132)
    rows = []  # (rep, at, class, words), all of one seed
    for i in range(300):
        w = rng.integers(0, 30_000, 132) if i % 3 else np.where(rng.random(132) < 0.1 * (i % 8), rng.integers(0, 30_000, 132), base)
        w[64:68] = base[64:68]
        rows.append((int(rng.integers(0, 250)), 64 + 1000 * i, int(rng.integers(0, 200)), w.astype("<u2")))
    tiles = [i % 2 for i in range(300)]
    sent = [(7, *sorted((t, k)), t, r, at, c, at - 64, w.tobytes()) for (r, at, c, w), t in zip(rows, tiles) for k in (0, 1)]
    sent.sort(key=lambda r: r[:3])
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sent[a:a + 77])], [f"c{i}" for i in range(9)]) for a in range(0, len(sent), 77)]
    got = {(r["a"], r["pa"], r["b"], r["pb"]) for b in substring._compared(50, 0.8)(iter(batches)) for r in b.to_pylist()}

    def alike(x, y):
        two, more = (Counter(zip(w[:-1].tolist(), w[1:].tolist())) for w in (x, y))
        same = np.cumsum([0.0, *((x == y) - 0.8)])
        return sum((two & more).values()) >= 29 and max((same[a + 50:] - same[a]).max() for a in range(83)) >= -1e-9
    due = {(r, at, s, bt) for r, at, c, w in rows for s, bt, d, v in rows if r < s and c != d and alike(w, v)}
    assert len(due) > 100 and due <= got
    words = {at: w for _, at, _, w in rows}
    assert all(alike(words[64 + 1000 * (p // 1000)], words[64 + 1000 * (q // 1000)]) for _, p, _, q in got)
    class_of = {at // 1000: c for _, at, c, _ in rows}
    assert all(a < b and class_of[p // 1000] != class_of[q // 1000] for a, p, b, q in got)


@pytest.mark.parametrize("swap", [False, True])
def test_chains_of_a_passage_held_twice(swap):
    at = [(10 + i, 20 + i) for i in range(60)] + [(200 + i, 20 + i) for i in range(60)]
    p, q = zip(*[(y, x) if swap else (x, y) for x, y in at])
    n = len(p)
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in ([1] * n, [2] * n, p, q)], ["a", "b", "pa", "pb"])
    got = [r for b in substring._chains([batch]) for r in b.to_pylist()]
    spans = sorted((r["b0"], r["b1"]) if swap else (r["a0"], r["a1"]) for r in got)
    assert spans == [(10, 73), (200, 263)]


def test_passages_edges(spark, awkward):
    assert substring.passages(awkward).count() == 0 and substring.passages(awkward.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((150, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, [float(x) for x in base[i % 10] + 0.35 * rng.standard_normal(16)]) for i in range(120)]
    rows += [(2000 + i, rows[0][1]) for i in range(20)] + [(3000, [2 * x for x in rows[1][1]])]
    bad = [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] + [1.0] * 15), (4004, [None] + [1.0] * 15), (4005, [float("inf")] + [1.0] * 15), (4006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.link(df).collect()}
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    ids = [i for i, _ in rows]
    cos = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    near = cos >= 0.9
    np.fill_diagonal(near, True)
    reach = near.copy()
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    for i, v in enumerate(ids):
        low = min(np.array(ids)[reach[i]])
        assert got[v] == (near[i].sum() - 1, low, bool(low == v))
    for v, _ in bad:
        assert got[v] == (0, v, True)
    assert embedding_join.link(df.limit(0)).count() == 0


def test_embeddings_keep_double_precision(spark):
    a = [1.0, 0.0]
    near = [0.9 + 1e-9, (1 - (0.9 + 1e-9) ** 2) ** 0.5]  # single precision cannot tell the two apart
    below = [0.9 - 1e-9, (1 - (0.9 - 1e-9) ** 2) ** 0.5]
    for v, linked in ((near, True), (below, False)):
        got = embedding_join.link(spark.createDataFrame([(1, a), (2, v)], "vec_id long, embedding array<double>")).collect()
        assert {r.n_links for r in got} == {int(linked)}


def test_embedding_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(8)
    rows = [(i, [float(x) for x in base + 0.05 * rng.standard_normal(8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(embedding_join, "CHUNK", 13)
    assert {(r.n_links, r.component_id) for r in embedding_join.link(df).collect()} == {(59, 0)}
