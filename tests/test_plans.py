"""Publishing, interchange, ingest and streams end to end on small archives."""

import json

import pytest
from pyspark.sql import functions as F

from tidewrack.operators.rules import ArchiveError
from tidewrack.plans import ingest, publish
from tidewrack.schemas import schema
from tidewrack.sources import interchange, store
from tidewrack.streaming import state
from tests.test_operators import records, rows


def an_archive(spark, **changes):
    item = {"id": "a", "type": "story", "status": "catalogued", "title": "A", "date": "1963", "date_precision": "year", "people": [("mum", None, None, None)], "assets": [("story", "story-2.txt", None), ("image", "x.jpg", None)]}
    raw = records(spark, "items", [item | {"title": "old"}, item | changes, {"id": "z", "type": "photo", "status": "deleted"}])
    versions = raw.withColumn("version", F.when(F.col("title") == "old", 1).when(F.col("id") == "z", 1).otherwise(2))
    content = spark.createDataFrame([("a", "story", 1, "story.txt", "first"), ("a", "story", 2, "story-2.txt", "second")], schema("content"))
    none = lambda kind: records(spark, kind, [])
    s = publish.silver(versions, content, records(spark, "people", [{"id": "mum", "name": "Mum"}]), none("relationships"), none("places"), none("themes"), none("orgs"))
    return s, versions, content


def test_publish(spark, tmp_path):
    s, versions, content = an_archive(spark)
    assert rows(s.items, "id", "title", "story") == [("a", "A", "second")] and [a.kind for a in s.items.first().assets] == ["image"]
    assert publish.missing_content(versions, content).count() == 0
    first = publish.publish(s, str(tmp_path), "p1", versions)
    again = publish.publish(s, str(tmp_path), "p2", versions)
    assert publish.register_views(spark, str(tmp_path)) == "p2"
    for table in first:
        one, two = (spark.read.parquet(p[table]) for p in (first, again))
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    with pytest.raises(Exception):
        publish.publish(s, str(tmp_path), "p1", versions)


def test_publish_refuses_dangling(spark, tmp_path):
    s, versions, _ = an_archive(spark, people=[("nobody", None, None, None)])
    with pytest.raises(ArchiveError, match="people-ref"):
        publish.publish(s, str(tmp_path), "p1", versions)


def test_store(spark, tmp_path):
    for name, payload in (("b1/item.json", {"id": "b1", "title": "v1"}), ("b1/item-2.json", {"id": "b1", "title": "v2"}), ("b1/item-10.json", {"id": "b1", "title": "v10"})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(payload))
    raw = store.raw_versions(spark, str(tmp_path))
    assert rows(raw, "record_id", "version") == [("b1", 1), ("b1", 2), ("b1", 10)]
    assert rows(store.typed(raw, "items"), "version", "title") == [(1, "v1"), (2, "v2"), (10, "v10")]
    assert [r.path for r in store.listing(spark, str(tmp_path), (".json",)).collect()] == ["b1/item-10.json", "b1/item-2.json", "b1/item.json"]
    assert store.listing(spark, str(tmp_path / "none")).count() == 0
    assert store.read_prefix(spark, str(tmp_path / "b1/item.json"), 5).first().text == '{"id"'
    with pytest.raises(store.PathError):
        store.inside("/a/b", "../c")
    assert store.inside("/a/b", "c/../d") == "/a/b/d"


def test_interchange_round_trip(spark):
    people = records(spark, "people", [
        {"id": "ann", "name": "Ann Voss", "aliases": ["Annie"], "dob": ("1860-03-24", "exact", None), "occupations": ["miner"], "residence": [("pier", "1880", "1890", None)]},
        {"id": "karl", "name": "Karl Stein", "pronouns": "he/him", "dod": ("1911", "approx", None)}, {"id": "kid", "name": "Kid", "status": "estimated", "basis": ("a guess", "mum", "2026", None)},
        {"id": "nobody", "name": "N", "status": "proposed"}])
    edges = records(spark, "relationships", [
        {"a": "ann", "b": "karl", "kind": "spouse", "date": ("1880", "year", None)}, {"a": "ann", "b": "kid", "kind": "parent"}, {"a": "karl", "b": "kid", "kind": "parent"},
        {"a": "kid", "b": "ann", "kind": "inlaw"}, {"a": "nobody", "b": "kid", "kind": "parent"}])
    places = records(spark, "places", [{"id": "pier", "name": "Pier"}])
    stories = spark.createDataFrame([("ann", "A story\nin two lines")], "person string, text string")
    text = [r.line for r in interchange.export_lines(people, edges, places, stories).orderBy("section", "key", "seq", "ord", "sub").collect()]
    assert text == [r.line for r in interchange.export_lines(people, edges, places, stories).orderBy("section", "key", "seq", "ord", "sub").collect()]
    assert text[0] == "0 HEAD" and text[-1] == "0 TRLR" and "1 NOTE A story" in text and "2 CONT in two lines" in text and "1 NOTE Estimated: a guess (mum, 2026)" in text and not any("nobody" in t for t in text)
    at = text.index("0 @F1@ FAM")
    assert text[at + 1:at + 6] == ["1 HUSB @P1@", "1 HUSB @P2@", "1 MARR", "2 DATE 1880", "1 CHIL @P3@"]
    lines = interchange.parse_lines(spark.createDataFrame(list(enumerate(t.replace("1 HUSB @P1@", "1 WIFE @P1@") for t in text)), "pos int, line string"))
    table, links, unknown = interchange.import_gedcom(lines, places)
    got = {r.id: r for r in table.collect()}
    assert set(got) == {"ann", "karl", "kid"} and got["ann"].aliases == ["Annie"] and got["ann"].dob.date == "1860-03-24" and got["ann"].occupations == ["miner"] and tuple(got["ann"].residence[0]) == ("pier", "1880", "1890")
    assert got["karl"].dod.precision == "approx" and unknown.count() == 0
    assert rows(links, "a", "kind", "b") == [("ann", "parent", "kid"), ("karl", "parent", "kid"), ("karl", "spouse", "ann"), ("kid", "inlaw", "ann")]
    assert interchange.import_gedcom(lines, places.limit(0))[2].count() == 1


def test_ingest(spark):
    pages = spark.createDataFrame([("b", f"p{i}", 300 if i else 10) for i in range(7)], "batch_id string, page string, strong_words int")
    assert rows(ingest.routes(pages), "page", "route")[0] == ("p0", "handwriting")
    assert [r[1] for r in rows(ingest.chunked(pages), "page", "chunk")] == [0] * 5 + [1] * 2
    flag = lambda df: df.select("batch_id", "page", (F.col("page").isin("p0", "p3")).alias("starts"), (F.col("page") == "p6").alias("ends"), F.lit("Dear").alias("greeting"), F.lit("Yours").alias("signoff")).unionByName(
        spark.createDataFrame([("b", "made-up", True, True, "", "")], "batch_id string, page string, starts boolean, ends boolean, greeting string, signoff string"))
    docs = ingest.process(pages, lambda df: df.withColumn("text", F.col("page")), flag)
    assert rows(docs, "doc_no", "pages", "open", "greeting") == [(1, 3, True, "Dear"), (2, 4, False, "Dear")]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], "k int, v int, p string")
    for i, part in enumerate((log.where("v = 1"), log.where("v = 3"), log.where("v = 1"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    now = state.current_from_stream(spark, str(tmp_path / "log"), ["k"], ["v"], F.lit(False))
    assert rows(now, "k", "v", "p") == [(1, 3, "c"), (2, 1, "x")]
    wishes = spark.createDataFrame([("p", 1, 90), ("p", 2, 180), ("p", 2, 180), ("q", 1, 360)], "page string, at int, rotation int")
    assert rows(state.rotation_deltas(wishes, spark.createDataFrame([("p", 90)], "page string, rotation int")), "page", "delta") == [("p", 90)]
    events = spark.createDataFrame([(1, "2026-01-01 10:00:00"), (1, "2026-01-01 10:10:00"), (1, "2026-01-01 12:00:00")], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r[1] for r in rows(state.sessions(events), "start", "n")] == [2, 1]


def test_state_survives_a_restart(spark, tmp_path):
    from tidewrack.streaming.state import LatestState
    where = f"file://{tmp_path}/s"
    make = lambda rows: spark.createDataFrame(rows, "k int, v int, t string")
    LatestState(spark, ["k"], ["v"], where, buckets=4).merge(make([(i, 1, "a") for i in range(50)]), 0)
    again = LatestState(spark, ["k"], ["v"], where, buckets=4)
    again.merge(make([(1, 2, "b"), (2, 0, "old")]), 1)
    again.merge(make([(9, 9, "twice")]), 1)  # a batch that comes twice
    third = LatestState(spark, ["k"], ["v"], where, buckets=4)
    got = {r.k: (r.v, r.t) for r in third.read().collect()}
    assert got == {**{i: (1, "a") for i in range(50)}, 1: (2, "b")}
    assert LatestState(spark, ["k"], ["v"], f"file://{tmp_path}/none", schema="k int").read().count() == 0


def test_refresh_of_a_publication(spark, tmp_path):
    from tidewrack.plans import publish
    from tidewrack.sources.demo import demo
    d = demo(spark)
    s = publish.Silver(**d)
    publish.publish(s, str(tmp_path), "p1")
    story = d["items"].where("id = 'ledger'").withColumn("title", F.lit("New title"))
    more = d["people"].where("id = 'orla-quill'").unionByName(d["people"].where("id = 'orla-quill'").withColumn("id", F.lit("new-one")))
    for name in ("p2", "p3"):
        paths = publish.refresh(spark, str(tmp_path), name, story, d["items"].where("id = 'brass-lamp'").select("id"), people=more)
        assert set(paths) == {"items", "transcripts", "index", "people"}
        assert publish.register_views(spark, str(tmp_path)) == name
        assert {(r.id, r.title) for r in spark.table("items").collect()} == {("ledger", "New title"), ("story-1975-06-21-01", "The wedding on the pier")}
        assert spark.table("people").count() == 4 and spark.table("places").count() == 2
    assert publish.current_tables(spark, str(tmp_path))["places"] == "p1"
