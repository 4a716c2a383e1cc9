"""Chat, sharding, mixing, PII and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import chat, decontaminate, mixing, pii, sharding


def test_preference_pairs(spark):
    turns = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
             (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"), (3, "chosen", 0, None, None), (4, "rejected", 0, "user", "x"), (4, "chosen", 0, "assistant", "y"),
             (None, "chosen", 0, "user", "lost"), (5, "other", 0, "user", "lost")]
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string").withColumn("t", F.lit(1))
    got = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].n_prompt_turns == 1 and got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and [tuple(s) for s in got[1].chosen_spans] == [(22, 35)] and got[1].chosen[22:35] == "yes<|im_end|>"
    assert got[1].rejected[22:34] == "no<|im_end|>" and [tuple(s) for s in got[1].rejected_spans] == [(22, 34)]
    assert got[2].n_prompt_turns == 1 and got[2].chosen == got[2].rejected == "" and got[3].n_prompt_turns == 0 and got[3].rejected == "" and got[4].prompt == ""
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_alternatives(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "user", "r"), (1, 1, "assistant", "a1"), (2, 0, "user", "alone"), (2, 1, "assistant", "a2"), (4, 0, "user", "no answer"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.formatted(chat.alternatives(df)).collect()}
    assert sorted(got) == [0, 1, 2, 4] and "a1" in got[0].rejected and "a0" in got[1].rejected and got[0].n_prompt_turns == 1
    assert got[2].rejected == "" and got[4].n_prompt_turns == 1
    assert chat.formatted(chat.alternatives(df.limit(0))).count() == 0


def test_alternatives_of_awkward_conversations(spark):
    rng = random.Random(8)
    rows = [(c, rng.choice([None, *range(5)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None])) for c in range(-6, 40) for _ in range(rng.randrange(0, 7))] + [(None, 0, "user", "x")]
    rows += rng.sample(rows, 20)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"all": F.lit(1), "chosen": F.lit("c")}).repartition(4)
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2])
    want = {}
    for c, turns in own.items():
        last = {k: max(((-1 if t is None else t, r, x) for t, r, x in own.get(k, []) if r == "assistant"), default=None) for k in (c, c ^ 1)}
        kept = [t for t in sorted(turns, key=order) if last[c] is None or (t[0] < last[c][0] if t[0] is not None else last[c][0] >= 0)]
        want[c] = (sorted(turns, key=order), kept + ([(last[c][0], *last[c ^ 1][1:])] if last[c] and last[c ^ 1] else []))
    got = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.alternatives(df).collect()}
    assert got == want


def test_spans_of_very_long_conversations(spark):
    turns = [(1, side, i, "assistant" if i % 2 else "user", side * (i % 3)) for side in ("chosen", "rejected") for i in range(1500)]
    r = chat.preference_pairs(spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")).first()
    assert r.n_prompt_turns == 1 and len(r.chosen_spans) == 750
    own = [t for _, s, i, role, t in turns if s == "chosen" and role == "assistant"]
    assert [r.chosen[s.start:s.end] for s in r.chosen_spans] == [t + "<|im_end|>" for t in own]


@pytest.mark.parametrize("shards, copies", [(24, 0), (5, 400), (1, 3)])
def test_shards(spark, shards, copies):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(0, 400) + str(rng.random())) for i in range(800)] + [(10_000 + i, "copy" * 40) for i in range(copies)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards).collect()
    size = Counter()
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    for r in got:
        assert r.size == len(r.text.encode()) + 8
        size[r.shard] += r.size
    one, group = sum(size.values()) / shards, copies * (160 + 8)
    whole = group <= 0.5 * one
    assert len(got) == len(rows) and max(size.values()) - min(size.values()) <= 0.02 * one + 2 * 420 + group * whole
    homes = {}
    for r in got:
        homes.setdefault(r.text, set()).add(r.shard)
    split = [t for t, s in homes.items() if len(s) > 1]
    assert set(split) <= (set() if whole else {"copy" * 40})


def test_groups_below_half_a_shard_stay_whole_with_many_units(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TASK_BYTES", 4000)
    rng = random.Random(6)
    rows = [(1000 * t + i, f"text {t} " * 12) for t in range(40) for i in range(rng.randrange(1, 60))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 6).collect()
    homes, size, slots = {}, Counter(), {}
    for r in got:
        homes.setdefault(r.text, set()).add(r.shard)
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in homes.values()) and max(size.values()) <= 1.5 * sum(size.values()) / 6


def test_shard_edges(spark, awkward):
    got = sharding.shard(awkward, 3)
    assert got.columns == [*awkward.columns, "size_", "shard_", "slot"] and got.count() == awkward.count()
    assert sharding.shard(awkward.limit(0)).count() == 0
    again = sharding.shard(awkward.repartition(7), 3)
    assert sorted((r.doc_id or 0, r.shard_, r.size_) for r in got.collect()) == sorted((r.doc_id or 0, r.shard_, r.size_) for r in again.collect())


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2]) == pytest.approx([200.0, 83.333333, 166.666667])
    assert mixing.targets([10, 1000], [3, 1]) == pytest.approx([20.0, 1495.0])
    assert mixing.targets([], []) == [] and mixing.targets([0, 10], [3, 1]) == pytest.approx([0.0, 15.0])


def test_splitting_tree():
    for shards in (1, 2, 7, 16):
        q = mixing.splitting_tree([40, 3, 0, 17], shards)
        assert q.sum(1).tolist() == [40, 3, 0, 17] and q.sum(0).max() - q.sum(0).min() <= 1 and (q >= 0).all()
        assert (q == mixing.splitting_tree([40, 3, 0, 17], shards)).all()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "ä", None]) if i % 3 else "a") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix_plan(df).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, mixing.targets([size[s] for s in names], [3, 1, 2, 3])))
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source]) and len(r.shards) <= 2 and r.size == len(r.text.split())
        taken[r.source] += r.size * len(r.shards)
    for s in names:
        assert abs(taken[s] - goal[s]) <= 30
    again = {r.doc_id: r.shards for r in mixing.mix_plan(df.repartition(2)).collect()}
    assert again == {r.doc_id: r.shards for r in got}
    mixed = mixing.mix(df, shards=4).collect()
    assert Counter(r.doc_id for r in mixed) == Counter({r.doc_id: len(r.shards) for r in got if r.shards})


def test_mix_of_equal_rows_meets_the_target(spark):
    # 1,000 equal rows in one source, some words in others
    rows = [(1, "a b c d", "x")] * 1000 + [(10 + i, " ".join(["w"] * (3 + i % 5)), "y") for i in range(900)] + [(5000 + i, "q r s", "z") for i in range(3)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    plan = mixing.mix_plan(df, weights=(1.7, 1, 2)).select("source", "target", "size", F.size("shards").alias("k")).collect()
    assert len(plan) == len(rows)
    for name, one in (("x", 4), ("y", 7), ("z", 3)):
        own = [r for r in plan if r.source == name]
        assert abs(sum(r.k * r["size"] for r in own) - own[0].target) <= one and max(r.k for r in own) <= 2
    assert mixing.mix(df, weights=(1.7, 1, 2)).count() == sum(r.k for r in plan)
    again = mixing.mix_plan(df, weights=(1.7, 1, 2)).select("source", "target", "size", F.size("shards").alias("k")).collect()
    assert Counter(plan) == Counter(again)


def test_mix_refuses_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    df = spark.createDataFrame([(i, "a b", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix_plan(df)


def test_mix_edges(spark, awkward):
    plan = mixing.mix_plan(awkward, shards=3)
    assert plan.columns == [*awkward.columns, "size_", "source_size", "target_", "shards"] and plan.count() == awkward.count()
    assert mixing.mix_plan(awkward.limit(0)).count() == 0 and set(awkward.columns) < set(mixing.mix(awkward).columns)


#: The contract's rules, as they stand.
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, t or "", re.ASCII):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d) if kind == "card" else True, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(3)
    bits = ["a@b.cc", "_x@d.ee", "a.b%c@d-e.f.g", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "12 34", "+1 (988) 555-2485",
            "+49 30 1234567.", "+1 2", "é", "😀", " ", ",", "-", "call ", "version ", "1", "23", ".", "\n", "(030) 555-0199", "joe [at] mail [dot] org", "2001:db8:0:0:0:0:0:1", "+", "++1 555 000 1111 2222 3333"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "x"]) for _ in range(rng.randrange(0, 25))) for _ in range(600)]
    texts += ["1" * 30_000, "1 " * 20_000, "a" * 50_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "+" + "1 (" * 5000, "é" * 10 + " x@y.de", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found, model = pii.find(df)
    rows = found.select("doc_id", pii.digest(F.filter("spans", lambda x: x["base"])).alias("base"), pii.digest(F.col("spans")).alias("every")).collect()
    assert len(rows) == len(texts) and set(model.reliability) == set(pii.LABELERS)
    extra = 0
    for r in rows:
        assert r.base == ",".join(base_spans(texts[r.doc_id])), texts[r.doc_id][:200]
        mine = r.every.split(",") if r.every else []
        assert set(base_spans(texts[r.doc_id])) <= set(mine)
        order = [(list(RULES).index(k), int(s)) for k, s, _ in (x.split(":") for x in mine)]
        assert order == sorted(order)
        extra += len(mine) - len(base_spans(texts[r.doc_id]))


def test_pii_query_shape(spark, awkward, tmp_path):
    found, _ = pii.find(awkward, keep=("doc_id", "a.b", "spans"))
    assert found.columns == ["doc_id", "a.b", "spans", "spans_"] and found.count() == awkward.count()
    assert pii.find(awkward.limit(0))[0].count() == 0
    from tidewrack.llm import queries
    awkward.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op7_pii(spark, str(tmp_path)).collect():
        assert r.n_email == r.n_ip == r.n_card == r.n_phone == 0 and r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest()
    for r in queries.op2_sharding(spark, str(tmp_path)).where("text_crc32 is not null and doc_id = 6").collect():
        assert r.text_crc32 == zlib.crc32(b"one") and r.size == 11 and r.law == "bytes" and r.grown_shard is None


def leaked(doc, item):
    """Whether some stretch of 15 words of an item, or a shorter item as a whole, stands in the text with
    four fifths of its words in their places."""
    d, q = doc.lower().split(), item.lower().split()
    n = min(15, len(q))
    return any(5 * sum(x == y for x, y in zip(q[i:i + n], d[j:j + n])) >= 4 * n for i in range(len(q) - n + 1) for j in range(len(d) - n + 1))


def test_masks_hit_every_stretch():
    for n in range(1, 16):
        lose = n - -(-4 * n // 5)
        seeds = [{at + o for o in m} for m in decontaminate.masks_of(n) for at in range(n - m[-1])]
        for lost in itertools.combinations(range(n), lose):
            assert any(not s & set(lost) for s in seeds), (n, lost)


@pytest.mark.parametrize("rows", [2_000_000, 0])
def test_short_items(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rng = random.Random(14)
    items = [(n, " ".join(f"i{n}_{j}" for j in range(n))) for n in range(1, 16)]
    docs = []
    for i in range(150):
        q = items[i % 15][1].split()
        for j in rng.sample(range(len(q)), min(len(q), rng.randrange(0, 4))):
            q[j] = "zz"
        docs.append((i, " ".join([*(f"x{j}" for j in range(rng.randrange(4))), *q, *(f"y{j}" for j in range(rng.randrange(4)))])))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, k) for i, d in docs for k, q in items if leaked(d, q)}


def test_leaks(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.5 else f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([15, 18, 30, 60, 6, 9, 3, 14])] + [(8, None), (9, "")]
    docs = []
    for i in range(120):
        own = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            q = items[rng.randrange(8)][1].split()
            part = q[rng.randrange(0, max(1, len(q) - 20)):][:rng.randrange(10, 40)]
            for j in rng.sample(range(len(part)), min(len(part), rng.randrange(0, 5))):
                part[j] = "zz"
            own[len(own) // 2:len(own) // 2] = part
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame(docs + [(500, None), (None, items[2][1])], "doc_id long, text string").withColumn("hits", F.lit(1)).repartition(3)
    got = decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r.doc_id, r.item_id) for r in got.collect()}
    want = {(i, k) for i, d in docs for k, q in items if q and leaked(d, q)} | {(None, k) for k, q in items if q and leaked(items[2][1], q)}
    assert pairs == want
    left = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, _ in docs + [(500, None)]} - {i for i, _ in want}


def test_leak_edges(spark, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog for a long while today"), (1, "the cat sat on the mat and looked at the dog for a long while today")], "item_id long, text string")
    assert decontaminate.leaks(awkward, none).count() == 0 and decontaminate.leaks(awkward.limit(0), one).count() == 0
    assert [r.doc_id for r in decontaminate.leaks(awkward, one).collect()] == [1]
    assert decontaminate.decontaminate(awkward, one).count() == awkward.count() - 1
