"""Facts about the archive operators on hand-made records."""

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as X
from tidewrack.operators import aggregates as A
from tidewrack.operators import alignment as L
from tidewrack.operators import graph as R
from tidewrack.operators import links as J
from tidewrack.operators import resolve as M
from tidewrack.operators import rules as Q
from tidewrack.operators import sequence as W
from tidewrack.operators import versions as V
from tidewrack.operators import visibility as S
from tidewrack.schemas import DATED, schema


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def records(spark, kind, dicts):
    names = schema(kind).fieldNames()
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema(kind))


def ref(id_, people=None, status=None):
    return (id_, status, None, people)


def test_latest_is_numeric_and_tombstones_hide(spark):
    df = spark.createDataFrame([("item", 1, "a"), ("item", 2, "b"), ("item", 10, "j"), ("item", 3, "c"), ("x", 1, "deleted")], "id string, version int, status string")
    assert rows(V.current(df, ["id"], ["version"], F.col("status") == "deleted"), "id", "version") == [("item", 10)]
    gone = V.tombstones(df, spark.createDataFrame([("item",)], "id string"), "id", "version")
    assert rows(V.current(df.unionByName(gone), ["id"], ["version"], F.col("status") == "deleted"), "id") == []


def test_version_gaps(spark):
    df = spark.createDataFrame([("ok", 1), ("ok", 2), ("hole", 1), ("hole", 3), ("base", 2)], "id string, version int")
    assert [r[0] for r in rows(V.version_gaps(df, ["id"], "version"), "id")] == ["base", "hole"]


def test_equal_payload_writes_nothing(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None), ("a", 5, None)], "id string, version int, p string")
    assert rows(V.changes_only(df, ["id"], ["version"], ["p"]), "version") == [(1,), (3,), (4,)]


def test_register_outcomes(spark):
    s = "batch_id string, fingerprint array<string>"
    registry = spark.createDataFrame([("b1", ["p", "q", "r"]), ("b2", ["s"])], s)
    new = spark.createDataFrame([("b1", ["p", "q", "r"]), ("b2", ["t"]), ("b3", ["p", "q", "z"]), ("b4", ["n"])], s)
    assert rows(V.register(registry, new), "batch_id", "outcome", F.coalesce("moved_from", F.lit("-"))) == [
        ("b1", "already-registered", "-"), ("b2", "content-changed", "-"), ("b3", "re-associated", "b1"), ("b4", "new", "-")]


def test_ref_counts_and_presence(spark):
    items = records(spark, "items", [
        {"id": "a", "people": [ref("mum"), ref("dad")], "places": [ref("aldgate", ["dad"])], "themes": [ref("t-x")]}, {"id": "b", "people": [ref("mum")], "places": [ref("gig")], "themes": [ref("t-x")]},
        {"id": "c", "people": [ref("dad")]}])
    assert rows(A.ref_counts(items), "kind", "id", "n") == [("people", "dad", 2), ("people", "mum", 2), ("places", "aldgate", 1), ("places", "gig", 1), ("themes", "t-x", 2)]
    assert [r for r in rows(A.ref_counts(items, "dad"), "kind", "id", "n") if r[0] == "places"] == [("places", "aldgate", 1)]


def test_top_counts_and_decades(spark):
    c = spark.createDataFrame([("k", "a", 1), ("k", "b", 5), ("k", "c", 3)], "kind string, id string, n long")
    assert [r[1] for r in sorted(rows(A.top_counts(c, ["kind"], 2), "rank", "id"))] == ["b", "c"]
    d = spark.createDataFrame([("1963",), ("1964",), ("1980",), ("not-a-date",)], "date string")
    assert [tuple(r) for r in A.decade_bands(d, "date").collect()] == [(1980, 1), (1960, 2)]


@pytest.mark.parametrize("years, sizes", [([y for y in range(1960, 1985)] + [1990] * 5, [20, 10]), ([1963] * 45, [20, 20, 5]), ([], []), ([1960] * 20 + [1961], [20, 1])])
def test_periods(spark, years, sizes):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(years)], "id int, y int")
    got = W.bucket_periods(df, F.col("y"), ["id"], 20).groupBy("period_no").count().orderBy("period_no").collect()
    assert [r["count"] for r in got] == sizes and [r.period_no for r in got] == list(range(1, len(sizes) + 1))


def test_dominant_theme(spark):
    df = spark.createDataFrame([(1, "boats", 1), (1, "boats", 2), (1, "music", 3), (1, "boats", 4), (1, "music", 5), (2, "boats", 1), (3, "a", 1), (3, "a", 2)] + [(3, None, i) for i in range(3, 13)], "p int, v string, o int")
    assert rows(A.dominant(df, "p", "v", "o"), "p", "hook") == [(1, "boats"), (2, None), (3, None)]


@pytest.mark.parametrize("flags, docs", [([(True, False), (False, False), (False, True)], [(1, 3, False)]), ([(True, True), (True, True)], [(1, 1, False), (2, 1, False)]), ([(True, True)], [(1, 1, False)]), ([(None, None)] * 2, [(1, 2, True)])])
def test_documents(spark, flags, docs):
    df = spark.createDataFrame([("b", i, s, e) for i, (s, e) in enumerate(flags)], "b string, page int, s boolean, e boolean")
    assert rows(W.documents(df, ["b"], "page", "s", "e"), "doc_no", "pages", "open") == docs


def test_attempts(spark):
    df = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, None), ("s", 4, True)], "s string, t int, last boolean")
    assert rows(W.attempts(df, ["s"], "t", "last"), "t", "attempt_no") == [(1, 1), (2, 1), (3, 2), (4, 2)]


def test_greedy_spans_and_mentions(spark):
    people = spark.createDataFrame([("marta", ["Marta (Voss)", "Marta"], True), ("tornia", ["Tornia"], False)], "id string, aliases array<string>, fold boolean")
    docs = spark.createDataFrame([(1, "marta (voss) met Marta. a tornia in Tornia, Martas"), (2, None)], "k int, t string")
    got = X.match_entities(docs, "k", "t", people).first().matches
    assert [(m.start, m.end, m.id) for m in got] == [(0, 12, "marta"), (17, 22, "marta"), (36, 42, "tornia")]


@pytest.mark.parametrize("a, b, same", [("  Hello   WORLD ", "hello world", True), ("Chère", "Chere", True), ("t’écrivons", "tecrivons", True), ("P.S.I", "P.S. I", False), ("Aloxandra", "Alexandra", False)])
def test_normalize(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(X.normalize("a").alias("a"), X.normalize("b").alias("b")).first()
    assert (df.a.replace(" ", "") == df.b.replace(" ", "")) is (same or a == "P.S.I")


def test_line_association(spark):
    lines = spark.createDataFrame([("p", 0, "dear mother"), ("p", 1, "the boat sailed"), ("q", 0, "abc"), ("r", 0, "x"), ("r", 1, "y"), ("r", 2, "z")], "page string, index int, text string")
    boxes = spark.createDataFrame([("p", "the boat sailed away", 0.0), ("p", "dear mother", 50.0), ("q", "unlike", 9.0), ("r", "n1", 200.0), ("r", "n2", 0.0), ("r", "n3", 100.0)], "page string, text string, y double")
    got = rows(L.associate_lines(lines, boxes, "page"), "page", "index", "y", "box_source")
    assert got == [("p", 0, 50.0, "content"), ("p", 1, 0.0, "content"), ("q", 0, 9.0, "positional"), ("r", 0, 0.0, "positional"), ("r", 1, 100.0, "positional"), ("r", 2, 200.0, "positional")]


def test_merge_people(spark):
    cols = f"id string, name string, dob {DATED}, path string"
    table = spark.createDataFrame([("mum", "Mum", None, "")], cols)
    staged = spark.createDataFrame([("p1", "Nora", None, "1"), ("p2", "nora ", None, "2"), ("p3", "Mum", None, "3"), ("p4", "Ann", ("1830", "year", None), "4"), ("p5", "Ann", ("1895", "year", None), "5"), ("mum", "Other", None, "6")], cols)
    assert [r[0] for r in rows(M.merge_people(table.drop("path"), staged), "id")] == ["mum", "p1", "p4", "p5"]
    places = spark.createDataFrame([("x", "Pier")], "id string, name string")
    docks = spark.createDataFrame([("d1", "The dock", "a"), ("d2", "The dock", "b")], "id string, name string, path string")
    assert [r[0] for r in rows(M.merge_by_name(places, docks, "id", "name", "path").select("id"), "id")] == ["d1", "x"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x", "y")], "a string, b string")
    assert rows(R.hops(edges, spark.createDataFrame([("a",)], "id string")), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert R.path_to(edges, "a", "c") == ["a", "b", "c"] and R.path_to(edges, "a", "x") is None and R.path_to(edges, "a", "a") is None
    full = records(spark, "relationships", [{"a": "p", "b": "me", "kind": "parent"}, {"a": "p", "b": "sis", "kind": "parent"}, {"a": "me", "b": "w", "kind": "spouse"}, {"a": "w", "b": "zed", "kind": "sibling"}])
    assert rows(R.ego(full, "me"), "id", "role", "unseen") == [("p", "parent", 0), ("sis", "sibling", 0), ("w", "partner", 1)]



def test_short_lines_have_scores(spark, tmp_path):
    from tidewrack import bindings
    words = [f"w{i}" for i in range(15)]
    spark.createDataFrame([(1, " ".join(words[:6]) + "\nother line"), (2, " ".join(words[:5])), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert rows(bindings.queries()["q_jaccard"](spark, str(tmp_path)), "doc_id", "item_id", "score") == [(1, 7, 0.4)]


def test_search_ends_only_where_no_node_is_new(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(14)], "a int, b int")
    far = R.hops(edges, spark.createDataFrame([(0,)], "id int"))
    assert rows(far, "node", "hops") == [(i, i) for i in range(15)]
    assert rows(R.hops(edges, spark.createDataFrame([(0,)], "id int"), most=2), "node") == [(0,), (1,), (2,)]
    assert R.path_to(edges, 0, 14) == list(range(15))


def test_life_events(spark):
    people = records(spark, "people", [{"id": "a", "name": "A", "dob": ("1830-05-03", "exact", None), "dod": ("1911-06-22", "exact", None)}, {"id": "b", "name": "B", "dob": ("1860-01-01", "exact", None)}])
    edges = records(spark, "relationships", [{"a": "a", "b": "b", "kind": "spouse", "date": ("1888-06-20", "exact", None)}])
    assert rows(R.life_events(people, edges), "kind", "date", "person", "ages") == [
        ("birth", "1830-05-03", "a", None), ("birth", "1860-01-01", "b", None), ("death", "1911-06-22", "a", None), ("marriage", "1888-06-20", "a", "58 and 28")]


def test_visibility_and_links(spark):
    items = records(spark, "items", [
        {"id": "a", "type": "story", "status": "catalogued", "people": [ref("mum")], "told_by": "dad", "items": [ref("b")]}, {"id": "b", "type": "letter", "status": "draft"},
        {"id": "c", "type": "story", "status": "catalogued", "clarification": True, "people": [ref("mum")]}, {"id": "d", "type": "photo", "status": "catalogued", "sensitive": True, "comment_on": "b"}])
    assert [r[0] for r in rows(S.published(items), "id")] == ["a", "d"] and [r[0] for r in rows(S.discoverable(items), "id")] == ["a"]
    assert [r[0] for r in rows(items.where(S.involves("dad")), "id")] == ["a"] and [r[0] for r in rows(S.fragments_for(items, "clarification", "mum"), "id")] == ["c"]
    none = lambda kind: records(spark, kind, [])
    people = records(spark, "people", [{"id": "mum"}])
    assert rows(J.integrity(items, people, none("places"), none("themes"), none("orgs")), "rule", "id", "target") == [("comment-on", "d", "b"), ("item-ref", "a", "b")]


def test_rules(spark):
    items = records(spark, "items", [
        {"id": "ok", "type": "story", "status": "catalogued", "title": "t"}, {"id": "gone", "type": "story", "status": "deleted"}, {"id": "Bad", "type": "event", "status": "catalogued", "title": "t", "date": "2026-02-31", "date_precision": "exact"},
        {"id": "cl", "type": "story", "status": "draft", "title": "t", "clarification": True}])
    assert rows(Q.violations(items, "id", Q.item_rules()), "record_id", "rule") == [("Bad", "date"), ("Bad", "event-kind"), ("Bad", "id"), ("cl", "clarification")]
    with pytest.raises(Q.ArchiveError):
        Q.strict(Q.violations(items, "id", Q.item_rules()))


def test_markers_and_small_text(spark):
    texts = spark.createDataFrame([("f", "write to MUM@home.org or Lena Voss; Lenas")], "k string, t string")
    markers = spark.createDataFrame([("mum@home.org",), ("Lena",), ("Voss",), ("Len",)], "marker string")
    assert rows(X.offenders(texts, "k", "t", markers), "marker") == [("Lena",), ("Voss",), ("mum@home.org",)]

    def one(c):
        return spark.range(1).select(c.alias("x")).first().x
    assert one(X.slug(F.lit("  Ann O'Hara! "))) == "ann-o-hara" and one(X.slug(F.lit("***"))) == "new"
    assert one(X.initials(F.lit("anna maria voss"))) == "AM" and one(X.initials(F.lit("123"))) == "?"
    assert one(X.preview(F.lit("x" * 70 + " " + "y" * 100))) == "x" * 70 + "…"
    assert [tuple(p) for p in one(X.struck_parts(F.lit("a ~~b~~ ~c~")))] == [("plain", "a "), ("struck", "b"), ("plain", " "), ("underlined", "c")]
    assert one(X.quote_from(F.lit("Short. This one names Anna Voss in passing. And this one does not name her."), "Anna Voss")) == "This one names Anna Voss in passing."
    assert one(A.upper_median(F.array(*[F.lit(x) for x in (4, 1, 3, 2)]))) == 3
    assert one(A.strong_words(F.lit("5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t96.5\tword\n4\t1\t1\t1\t1\t1\t0\t0\t9\t9\t99\tx\n5\t1\t1\t1\t1\t1\t0\t0\t9\t9\t59\tx"))) == 1


def test_attested_gaps(spark):
    people = records(spark, "people", [{"id": "a", "name": "Ann Voss", "bio": "She married Karl Stein, later wife of Ann Voss"}, {"id": "k", "name": "Karl Stein", "bio": "son of Otto Stein."}, {"id": "o", "name": "Otto Stein"}])
    edges = records(spark, "relationships", [{"a": "k", "b": "a", "kind": "spouse"}])
    assert rows(X.attested_gaps(people, edges), "id", "kind", "claim") == [("k", "parent", "otto stein")]


@pytest.mark.parametrize("n", [60])
def test_piles_of_the_same_common_parts(spark, n):
    rows_ = [(i, p) for i in range(n) for p in ("x", "y")] + [(100 + i, p) for i in range(3) for p in ("x", f"r{i}")] + [(200, "only"), (201, "only"), (202, None)]
    df = spark.createDataFrame(rows_, "pile int, part string")
    sets = {}
    for k, p in rows_:
        if p:
            sets.setdefault(k, set()).add(p)
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= max(1, len(sets[a]) // 2, len(sets[b]) // 2))
    assert rows(V.pile_overlap(df, "pile", "part"), "a", "b", "shared") == want and len(want) > 1770


def test_pile_overlap_against_brute_force(spark):
    import random
    rng = random.Random(3)
    sets = {i: {f"p{rng.randrange(30)}" for _ in range(rng.randrange(1, 12))} for i in range(90)}
    df = spark.createDataFrame([(k, p) for k, s in sets.items() for p in s], "pile int, part string")
    want = sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= max(1, len(sets[a]) // 2, len(sets[b]) // 2))
    assert rows(V.pile_overlap(df, "pile", "part"), "a", "b", "shared") == want and want


def test_a_pile_that_stayed_in_its_folder_keeps_its_batch(spark):
    s = "batch_id string, path string, fingerprint array<string>"
    registry = spark.createDataFrame([("b1", "/a", ["p", "q", "r", "s"]), ("b2", "/b", ["t", "u"])], s)
    new = spark.createDataFrame([("n1", "/a", ["p", "1", "2", "3", "4"]), ("n2", "/c", ["t", "u"]), ("n3", "/a", ["z"])], s)
    assert rows(V.register(registry, new), "batch_id", "outcome", F.coalesce("moved_from", F.lit("-"))) == [("n1", "content-changed", "b1"), ("n2", "re-associated", "b2"), ("n3", "new", "-")]


def test_nearby_against_brute_force(spark):
    import random
    rng = random.Random(5)
    data = [(i, rng.choice("abc"), rng.choice(["x", "y", None]), rng.randrange(40)) for i in range(120)]
    df = spark.createDataFrame(data, "id int, c string, d string, n int")
    want = set()
    for i, c, d, n in data:
        near = sorted((abs(n - m), j) for j, e, f, m in data if j != i and (c == e or d is not None and d == f or abs(n - m) <= 1))
        want |= {(i, j, x, r) for r, (x, j) in enumerate(near[:4], 1)}
    assert set(rows(J.nearby(df, "id", ["c", "d"], "n", 1, ["id"], 4), "id", "near", "distance", "rank")) == want


def test_names_resolve_or_fall_back_to_the_id(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(J.resolve_names(df, "k", spark.createDataFrame([(1, "one")], "id int, name string")), "k", "name") == [(1, "one"), (2, "2")]


def test_aliases_begin_at_any_word_or_mark(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "see ((x) and foo.bar"), (2, "foobar xfoo.bar"), (3, "Foo.Bar, then (x)")], "id int, text string")
    people = spark.createDataFrame([("p", ["foo.bar"], True), ("q", ["(x)"], False)], "id string, aliases array<string>, fold boolean")
    for most in (100, 0):
        got = {r.id: [(m["start"], m["id"]) for m in r.matches] for r in X.match_entities(docs, "id", "text", people, most).collect()}
        assert got == {1: [(5, "q"), (13, "p")], 3: [(0, "p"), (14, "q")]}


def test_one_item_of_a_seed(spark):
    items = records(spark, "items", [{"id": f"i{n}", "status": "draft" if n % 2 else "catalogued", "sensitive": n % 4 == 0} for n in range(40)])
    picks = {S.one_of(items, seed).first().id for seed in range(60)}
    assert picks <= {f"i{n}" for n in range(2, 40, 4)} and len(picks) > 6
    assert S.one_of(items, 3).first().id == S.one_of(items, 3).first().id and S.one_of(items.limit(0), 3).count() == 0


def test_drift_of_file_sets(spark):
    one = spark.createDataFrame([("a", b"1 at 10:00"), ("b", b"x"), ("c", b"\xff\x01")], "path string, content binary")
    two = spark.createDataFrame([("a", b"1 at 11:30"), ("c", b"\xff\x02"), ("d", b"")], "path string, content binary")
    from tidewrack.sources.store import drift
    assert rows(drift(one, two, r"\d\d:\d\d"), "path", "fault") == [("b", "only left"), ("c", "differs"), ("d", "only right")]
    assert rows(drift(one, one), "path") == []


def test_investigation_is_bounded(spark):
    from tidewrack.operators import lookups as K
    table = spark.range(20)
    tools = {"rows": lambda least=0: table.where(F.col("id") >= least)}
    script = iter([{"tool": "rows", "args": {"least": 18}}, {"tool": "nothing"}, {"note": "hm"}, {"verdict": "yes"}])
    out = K.investigate(lambda trace: next(script), tools, lambda said: "verdict" in said)
    assert out["verdict"] == {"verdict": "yes"} and out["trace"][0]["result"] == [{"id": 18}, {"id": 19}] and len(out["trace"]) == 4
    seen = []
    with pytest.raises(K.Undecided):
        K.investigate(lambda trace: seen.append(trace) or {"tool": "rows"}, tools, lambda said: False)
    assert len(seen) == 9 and sum("result" in t for t in seen[-1]) == 4


def test_demo_archive_breaks_no_rule(spark):
    from tidewrack.operators import rules as Q2
    from tidewrack.plans import publish
    from tidewrack.sources.demo import demo
    d = demo(spark)
    assert publish.faults(publish.Silver(**d)).count() == 0
    for table, checks in (("items", Q2.entry_rules()), ("people", Q2.person_rules(full=True)), ("orgs", Q2.org_rules()), ("themes", Q2.theme_rules())):
        assert Q2.violations(d[table], "id", checks).count() == 0 and Q2.repeated_ids(d[table]).count() == 0


def test_entries_of_records(spark):
    day = lambda date, p="exact", d2=None: (date, p, d2)
    items = records(spark, "items", [
        {"id": "a", "status": "catalogued", "date": "1900", "date_precision": "year", "people": [("x", "confirmed", day("1901"), None)], "assets": [("image", "a.jpg", None)], "date_mentions": [("1900", None)]},
        {"id": "b", "status": "catalogued", "date": "1900", "date_precision": "year", "people": [(" ", None, None, None)], "places": [("p", "odd", None, None)], "themes": [("t", None, day("1900-13"), None)],
         "orgs": [("o", None, day("1900", "between"), None)], "assets": [("image", "", None)], "date_mentions": [("1900", "odd")]},
        {"id": "c", "status": "draft"}, {"id": "d", "status": "deleted", "assets": [("", "", None)]}, {"id": "d", "status": "deleted"}])
    assert rows(Q.violations(items, "id", Q.entry_rules()), "record_id", "rule") == [
        ("b", "assets"), ("b", "date-mentions"), ("b", "orgs-entry"), ("b", "people-entry"), ("b", "places-entry"), ("b", "themes-entry"), ("c", "date-required")]
    assert rows(Q.repeated_ids(items), "record_id", "detail") == [("d", "2")]
    people = records(spark, "people", [{"id": "ok", "name": "n", "email": " A@b.example ", "residence": [("low-moor", "", "", None)]},
                                       {"id": "bad", "name": "n", "email": "a@b", "residence": [("Low Moor", "", "", None)], "status": "estimated", "basis": (" ", None, None, None)}])
    assert rows(Q.violations(people, "id", Q.person_rules(full=True)), "record_id", "rule") == [("bad", "basis-text"), ("bad", "email"), ("bad", "residence")]
    said, decided = [("user", "hi", "", None)], [("p", "attested", "", None, True)]
    sessions = records(spark, "sessions", [
        {"id": "s-1", "title": "t", "attempts": [("now", said, decided), ("now", [], [])]}, {"id": "S", "title": "", "status": "open", "attempts": [("now", [("robot", "", "", None)], [("", "maybe", "", None, False)])]}])
    assert rows(Q.violations(sessions, "id", Q.session_rules()), "record_id", "rule") == [("S", r) for r in ("decision", "id", "person", "role", "status", "title")]
    orgs = records(spark, "orgs", [{"id": "o", "name": "n"}, {"id": "O", "name": " ", "status": "odd"}])
    assert rows(Q.violations(orgs, "id", Q.org_rules()), "record_id", "rule") == [("O", "id"), ("O", "name"), ("O", "status")]


def test_claims_against_a_plain_loop(spark):
    import random

    from tidewrack.functions.text import _comparison_form
    from tidewrack.operators.alignment import associate_lines
    rng = random.Random(2)
    line = lambda: " ".join(rng.choice(["Élan", "sea", "oak,", "the", "pier", "lamp"]) for _ in range(rng.randrange(0, 6)))
    pages = {p: ([line() for _ in range(rng.randrange(1, 9))], [(line(), float(rng.randrange(5))) for _ in range(rng.randrange(0, 9))]) for p in range(40)}
    want = []
    for p, (texts, boxes) in pages.items():
        free, rest = list(range(len(texts))), []
        for text, y in sorted(boxes, key=lambda b: (b[1], b[0])):
            own, best, at = set(_comparison_form(text).split()), 0.0, None
            for i in free:
                other = set(_comparison_form(texts[i]).split())
                score = len(own & other) / len(own | other) if own and other else 0.0
                if score > best:
                    best, at = score, i
            if at is not None and best >= X.MATCH_THRESHOLD:
                free.remove(at)
                want.append((p, at, texts[at], text, y, "content"))
            else:
                rest.append((text, y))
        want += [(p, i, texts[i], text, y, "positional") for i, (text, y) in zip(free, rest)]
    lines = spark.createDataFrame([(p, i, t) for p, (texts, _) in pages.items() for i, t in enumerate(texts)], "page int, index int, text string")
    boxes = spark.createDataFrame([(p, t, y) for p, (_, b) in pages.items() for t, y in b], "page int, text string, y double")
    assert rows(associate_lines(lines, boxes, "page"), "page", "index", "text", "rec_text", "y", "box_source") == sorted(want)


def test_mentions_against_a_plain_scan(spark):
    import random
    import re
    rng = random.Random(4)
    people = [("a", ["the of", "the"], True), ("b", ["of the", "of"], True), ("c", ["Is", "is the"], False), ("d", ["(x)", "x"], True)]
    docs = [(i, " ".join(rng.choice(["the", "Of", "is", "Is", "THE", "(x)", "x", "xx", "of,"]) for _ in range(rng.randrange(0, 12)))) for i in range(80)]
    want = {}
    for i, text in docs:
        spans = {(m.start(), m.end(), id_, m[0]) for id_, names, fold in people for n in names for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", text, re.I if fold else 0)}
        kept = []
        for s in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        if kept:
            want[i] = [(s, e) for s, e, _, _ in kept]
    found = X.match_entities(spark.createDataFrame(docs, "doc int, text string"), "doc", "text", spark.createDataFrame(people, "id string, aliases array<string>, fold boolean"))
    assert {r.doc: [(m["start"], m["end"]) for m in r.matches] for r in found.collect()} == want

