"""Queries of the archive operators over archive records, each with its SQL where SQL can say it.

The records are made from whole driver tables: a customer is a person, an order an item, a nation
a place, a supplier an organisation, a market segment a theme; conversations are sessions. ``_PP``,
``_II``, ``_EE`` and ``_LL`` are the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.bindings import query
from tidewrack.functions import dates as D
from tidewrack.functions import payload as N
from tidewrack.functions import text as X
from tidewrack.operators import aggregates as A
from tidewrack.operators import graph as R
from tidewrack.operators import links as J
from tidewrack.operators import lookups as K
from tidewrack.operators import resolve as M
from tidewrack.operators import rules as Q
from tidewrack.operators import sequence as W
from tidewrack.operators import versions as V
from tidewrack.operators import visibility as S
from tidewrack.plans import ingest as I
from tidewrack.schemas import DATED, ITEM_TYPES
from tidewrack.shared import checkpoints
from tidewrack.sources import interchange as G
from tidewrack.sources import store as C
from tidewrack.streaming import state as T

FIRST = ("Ada", "Bela", "Cora", "Dan", "Edna", "Finn", "Gwen")
LAST = ("Ash", "Birch", "Cedar", "Elm", "Fir", "Hazel", "Larch", "Maple", "Oak", "Pine", "Rowan")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PP = f"""pp AS (SELECT c_custkey AS pos, 'c' || c_custkey AS id, {_list(FIRST)}[c_custkey % 7 + 1] || ' ' || {_list(LAST)}[c_custkey % 11 + 1] AS name, 'al' || (c_custkey % 40) AS alias,
  'User' || c_custkey || '@Mail.Example' AS email, CASE c_custkey % 5 WHEN 0 THEN 'proposed' WHEN 1 THEN 'estimated' ELSE 'confirmed' END AS status,
  substr(strftime(DATE '1850-01-01' + CAST(c_custkey * 37 % 20000 AS INT), '%Y-%m-%d'), 1, [10, 7, 4, 4][c_custkey % 4 + 1]) AS dob, ['exact', 'month', 'year', 'before'][c_custkey % 4 + 1] AS dobp,
  CASE WHEN c_custkey % 3 = 0 THEN strftime(DATE '1850-01-01' + CAST(c_custkey * 37 % 20000 + 9000 + c_custkey AS INT), '%Y-%m-%d') END AS dod FROM customer)"""
_II = f"""ii AS (SELECT o_orderkey AS k, o_custkey, 'o' || o_orderkey AS id, {_list(ITEM_TYPES)}[o_orderkey % 9 + 1] AS type, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'catalogued' END AS status,
  strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey END AS told_by, 'c' || o_custkey AS p1, 'c' || (o_custkey * 7 % 100) AS p2, 'n' || (o_orderkey % 26) AS place,
  't' || (o_orderkey % 6) AS theme, 's' || (o_orderkey % 97) AS org, CASE WHEN o_orderkey % 4 = 0 THEN 'o' || (o_orderkey + 3) END AS ref, o_orderkey % 10 = 1 AS clarification, o_orderkey % 10 = 2 AS reflection,
  o_orderkey % 10 = 3 AS evidence, o_orderkey % 7 = 0 AS sensitive, CASE WHEN o_orderkey % 5 = 0 THEN 'o' || (o_orderkey + 1) END AS comment_on, 'Title ' || o_orderkey AS title,
  'A day of ' || o_orderpriority || '. It was told by c' || o_custkey || ' in spring.' AS story, CASE WHEN o_orderkey % 3 = 0 THEN 'Dear Ada. The weather of ' || o_orderstatus || ' is fine.' ELSE '' END AS transcription FROM orders)"""
_EE = """ee AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey * 3 + 1) % (SELECT count(*) FROM customer) AS b, ['spouse', 'parent', 'sibling', 'inlaw', 'teacher'][c_custkey % 5 + 1] AS kind,
  CASE WHEN c_custkey % 2 = 0 THEN strftime(DATE '1890-01-01' + CAST(c_custkey * 11 % 9000 AS INT), '%Y-%m-%d') END AS date,
  CASE WHEN c_custkey % 6 = 0 THEN 'cousin' END AS label_a, '' AS label_b FROM customer WHERE c_custkey <> (c_custkey * 3 + 1) % (SELECT count(*) FROM customer))"""
_LL = "ll AS (SELECT 'n' || n_nationkey AS id, n_name AS name, n_nationkey * 1.25 AS lat, n_nationkey / 7.0 AS lng, ['exact', 'street', 'town'][n_nationkey % 3 + 1] AS precision FROM nation)"


def _pick(values, i: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))


def _id(prefix: str, key) -> Column:
    return F.concat(F.lit(prefix), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _dated(date: Column, precision: Column) -> Column:
    return F.struct(date.alias("date"), precision.alias("precision"), F.lit(None).cast("string").alias("date2"))


def _after(start: str, days: Column) -> Column:
    return F.date_format(F.date_add(F.lit(start).cast("date"), days.cast("int")), "yyyy-MM-dd")


def people(t) -> DataFrame:
    k = F.col("c_custkey")
    kind = k % 4
    dob = F.substring(_after("1850-01-01", k * 37 % 20000), F.lit(1), _pick((10, 7, 4, 4), kind))
    dod = F.when(k % 3 == 0, _after("1850-01-01", k * 37 % 20000 + 9000 + k))
    return t.customer.select(
        k.alias("pos"), _id("c", k).alias("id"), F.concat_ws(" ", _pick(FIRST, k % 7), _pick(LAST, k % 11)).alias("name"), F.array(_id("al", k % 40)).alias("aliases"),
        F.concat(F.lit("User"), k.cast("string"), F.lit("@Mail.Example")).alias("email"), F.when(k % 5 == 0, "proposed").when(k % 5 == 1, "estimated").otherwise("confirmed").alias("status"),
        _dated(dob, _pick(("exact", "month", "year", "before"), kind)).alias("dob"), _dated(dod, F.when(dod.isNotNull(), F.lit("exact"))).alias("dod"),
        F.when(k % 8 == 0, F.array(F.lit("baker"))).otherwise(F.array().cast("array<string>")).alias("occupations"), F.concat_ws(" ", F.lit("relation"), F.col("c_mktsegment")).alias("relation"))


def _ref(id_: Column, told: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(id_.alias("id"), nothing.alias("status"), F.lit(None).cast(DATED).alias("date"), (F.lit(None).cast("array<string>") if told is None else told).alias("people"))


def items(t) -> DataFrame:
    k, c = F.col("o_orderkey"), _id("c", "o_custkey")
    no_refs = F.array().cast(f"array<struct<id:string,status:string,date:{DATED},people:array<string>>>")
    return t.orders.select(
        k.alias("k"), _id("o", k).alias("id"), _pick(ITEM_TYPES, k % 9).alias("type"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("catalogued").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lit("exact").alias("date_precision"), F.when(k % 2 == 0, c).alias("told_by"),
        F.array(_ref(c), _ref(_id("c", F.col("o_custkey") * 7 % 100))).alias("people"), F.array(_ref(_id("n", k % 26), F.when(k % 3 == 0, F.array(c)))).alias("places"),
        F.array(_ref(_id("t", k % 6))).alias("themes"), F.array(_ref(_id("s", k % 97))).alias("orgs"), F.when(k % 4 == 0, F.array(_ref(_id("o", k + 3)))).otherwise(no_refs).alias("items"),
        *[(k % 10 == i).alias(name) for i, name in enumerate(("clarification", "reflection", "evidence"), 1)], (k % 7 == 0).alias("sensitive"), F.when(k % 5 == 0, _id("o", k + 1)).alias("comment_on"),
        F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.lit("").alias("description"),
        F.concat(F.lit("A day of "), F.col("o_orderpriority"), F.lit(". It was told by "), c, F.lit(" in spring.")).alias("story"),
        F.when(k % 3 == 0, F.concat(F.lit("Dear Ada. The weather of "), F.col("o_orderstatus"), F.lit(" is fine."))).otherwise("").alias("transcription"),
        F.when(k % 6 == 0, "draft").otherwise("none").alias("transcription_status"),
        F.struct(F.array(F.struct(F.lit("item").alias("kind"), F.lit("x").alias("name"), F.when(k % 11 == 0, _id("o", k + 20_000_000)).otherwise(_id("o", k)).alias("match"), F.lit("existing").alias("bucket"),
                                  F.lit("").alias("reason"), (k % 3 != 0).alias("on"))).alias("extractions")).alias("chat"))


def edges(t) -> DataFrame:
    k = F.col("c_custkey")
    n = t.customer.agg(F.count(F.lit(1)).alias("n"))
    rows = t.customer.select("c_custkey").crossJoin(F.broadcast(n)).withColumn("to", (k * 3 + 1) % F.col("n")).where(k != F.col("to"))  # one row
    date = F.when(k % 2 == 0, _after("1890-01-01", k * 11 % 9000))
    return rows.select(_id("c", k).alias("a"), _id("c", "to").alias("b"), _pick(("spouse", "parent", "sibling", "inlaw", "teacher"), k % 5).alias("kind"), _dated(date, F.when(date.isNotNull(), F.lit("exact"))).alias("date"),
                       F.when(k % 6 == 0, "cousin").alias("label_a"), F.lit("").alias("label_b"), F.lit(None).cast("string").alias("status"))


def places(t) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select(_id("n", k).alias("id"), F.col("n_name").alias("name"), (k * 1.25).alias("lat"), (k / 7.0).alias("lng"), _pick(("exact", "street", "town"), k % 3).alias("precision"), F.array().cast("array<string>").alias("aliases"))


def themes(t) -> DataFrame:
    own = t.orders.where("o_orderkey % 50 = 0").groupBy((F.col("o_orderkey") % 7).alias("t")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    return own.select(_id("t", "t").alias("id"), _id("Theme ", "t").alias("title"), F.transform("o", lambda o: F.struct(_id("o", o + F.when(o % 100 == 0, 0).otherwise(1)).alias("id"), F.lit("").alias("note"))).alias("items"))


_TT = "tt AS (SELECT 't' || (o_orderkey % 7) AS theme, o_orderkey, 'o' || (o_orderkey + CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE 1 END) AS id FROM orders WHERE o_orderkey % 50 = 0)"


def orgs(t) -> DataFrame:
    return t.supplier.select(_id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"))


def sessions(t) -> DataFrame:
    """A conversation is a session with two attempts: its first four turns and the others."""
    turn = F.col("turn")
    d = F.struct(_id("c", (F.col("conv_id") * 13 + turn) % 100).alias("person_id"), _pick(("confirm", "estimate", "reject", "skip"), turn % 4).alias("decision"),
                 F.when(turn % 3 == 1, F.struct(F.concat_ws("-", F.lit("told"), "conv_id", "turn").alias("text"))).alias("basis"))
    per = t.conversations.groupBy("conv_id", F.when(turn < 4, 0).otherwise(1).alias("attempt")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", d.alias("d")))), lambda x: x["d"]).alias("decisions"))
    return per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "decisions"))).alias("attempts")).select(
        F.format_string("q%06d", "conv_id").alias("id"), F.transform("attempts", lambda a: F.struct(a["decisions"].alias("decisions"))).alias("attempts"))


_DD = """dd AS (SELECT printf('q%06d', conv_id) AS id, CASE WHEN turn < 4 THEN 0 ELSE 1 END AS attempt, turn, 'c' || ((conv_id * 13 + turn) % 100) AS person_id, ['confirm', 'estimate', 'reject', 'skip'][turn % 4 + 1] AS decision,
  CASE WHEN turn % 3 = 1 THEN 'told-' || conv_id || '-' || turn END AS basis FROM conversations)"""


def batches(t) -> DataFrame:
    """A supplier's batch has a document for each of its nation's thirds."""
    k = F.col("s_suppkey")
    one = lambda i: F.struct(F.array(_id("p", k * 10 + i)).alias("pages"), F.when((k + i) % 3 == 0, "review").otherwise("confirmed").alias("status"))
    return t.supplier.select(_id("b", k).alias("batch_id"), F.when(k % 4 == 0, "confirmed").otherwise("pending").alias("status"), F.slice(F.array(one(0), one(1), one(2)), F.lit(1), (k % 3 + 1).cast("int")).alias("boundaries"))


_BB = """bb AS (SELECT s_suppkey AS k, 'b' || s_suppkey AS batch_id, CASE WHEN s_suppkey % 4 = 0 THEN 'confirmed' ELSE 'pending' END AS status, i, 'p' || (s_suppkey * 10 + i) AS page,
  CASE WHEN (s_suppkey + i) % 3 = 0 THEN 'review' ELSE 'confirmed' END AS doc_status FROM supplier, (SELECT unnest([0, 1, 2]) AS i) WHERE i <= s_suppkey % 3)"""
_SHOWN = "status <> 'draft'"


# versions

@query("SELECT event_id % 100 AS id, CAST(max(event_id // 100) + 2 AS BIGINT) AS version, 'deleted' AS status FROM events WHERE event_id % 100 < 30 GROUP BY 1")
def q_tombstones(t):
    log = t.events.select((F.col("event_id") % 100).alias("id"), (F.floor(F.col("event_id") / 100) + 1).alias("version"), F.col("event_type").alias("status"))
    return V.tombstones(log, log.where("id < 30").select("id").distinct(), "id", "version")


@query("""
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, n AS supersedes, CAST(coalesce(n, 0) + 1 AS BIGINT) AS version FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def q_next_version(t):
    log = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.row_number().over(_by("o_custkey", "o_orderkey")).cast("long").alias("version"))
    return V.next_version(log, t.customer.select(F.col("c_custkey").alias("id"), F.lit(0).alias("version")), "id").select("id", "supersedes", "version")


def _by(group: str, *order: str):
    from pyspark.sql.window import Window
    return Window.partitionBy(group).orderBy(*order)


@query(f"""WITH {_II} SELECT id AS item_id, 'story' AS kind, story AS text FROM ii WHERE type = 'story'
UNION ALL SELECT id, 'transcription', transcription FROM ii WHERE type IN ('story', 'letter', 'document') AND transcription <> ''""")
def q_split_content(t):
    return V.split_content(items(t))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'story.txt' ELSE 'story-' || (o_orderkey % 4 + 1) || '.txt' END AS file FROM orders")
def q_content_names(t):
    return t.orders.select("o_orderkey", V.content_filename(F.lit("story"), F.col("o_orderkey") % 4 + 1).alias("file"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'image:a.jpg' WHEN o_orderkey % 3 = 0 THEN 'image:a.jpg,story:new.txt' ELSE 'image:a.jpg,story:new.txt' END AS assets FROM orders")
def q_content_assets(t):
    none = F.lit(None).cast("string")
    asset = lambda kind, file: F.struct(F.lit(kind).alias("kind"), F.lit(file).alias("file"), none.alias("caption"))
    before = F.when(F.col("o_orderkey") % 3 == 0, F.array(asset("story", "old.txt"), asset("image", "a.jpg"))).otherwise(F.array(asset("image", "a.jpg")))
    after = V.upsert_content(before, "story", F.when(F.col("o_orderkey") % 2 == 1, F.lit("new.txt")))
    return t.orders.select("o_orderkey", F.array_join(F.transform(after, lambda a: F.concat_ws(":", a["kind"], a["file"])), ",").alias("assets"))


@query("SELECT p_partkey, p_brand, p_size FROM part JOIN (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY 1) USING (p_brand, p_size)")
def q_latest_table(t):
    return V.latest_table(t.part, "p_brand", "p_size").select("p_partkey", "p_brand", "p_size")


@query("SELECT conv_id, md5(string_agg(h, ',' ORDER BY h)) AS print FROM (SELECT conv_id, sha256(text) AS h FROM conversations) GROUP BY 1")
def q_fingerprints(t):
    return V.fingerprint(t.conversations, "conv_id", "text").select("conv_id", F.md5(F.array_join("fingerprint", ",")).alias("print"))


_PILES = """o AS (SELECT o_custkey AS c, o_orderkey % 400 AS page FROM orders), p AS (SELECT c, list_sort(list_distinct(list(page))) AS f FROM o GROUP BY 1),
r AS (SELECT 'b' || c AS batch_id, f FROM p WHERE c % 2 = 0), a AS (SELECT CASE WHEN c % 4 = 0 THEN 'b' || c ELSE 'x' || c END AS batch_id, CASE WHEN c % 8 = 0 THEN f ELSE f[2:] END AS f FROM p WHERE c % 2 = 0 AND len(f) > 1)"""


@query(f"""WITH {_PILES}, k AS (SELECT a.batch_id, a.f, r.f AS known FROM a LEFT JOIN r USING (batch_id)),
m AS (SELECT k.batch_id, arg_min(r.batch_id, (-len(list_intersect(k.f, r.f)), r.batch_id)) AS moved_from FROM k, r WHERE k.known IS NULL AND len(list_intersect(k.f, r.f)) >= greatest(1, len(k.f) // 2)
  AND len(list_intersect(k.f, r.f)) >= greatest(1, len(r.f) // 2) GROUP BY 1)
SELECT batch_id, moved_from, CASE WHEN known IS NOT NULL THEN CASE WHEN known = f THEN 'already-registered' ELSE 'content-changed' END WHEN moved_from IS NOT NULL THEN 're-associated' ELSE 'new' END AS outcome
FROM k LEFT JOIN m USING (batch_id)""")
def q_register(t):
    c = F.col("o_custkey")
    own = t.orders.where(c % 2 == 0).groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.col("o_orderkey") % 400)).alias("f"))
    checkpoints(t.spark)
    own = own.checkpoint()  # both sides are made of it
    text = lambda x: F.transform(x, lambda v: v.cast("string"))
    registry = own.select(_id("b", c).alias("batch_id"), text(F.col("f")).alias("fingerprint"))
    arriving = own.where(F.size("f") > 1).select(F.when(c % 4 == 0, _id("b", c)).otherwise(_id("x", c)).alias("batch_id"), text(F.when(c % 8 == 0, F.col("f")).otherwise(F.slice("f", F.lit(2), F.size("f") - 1))).alias("fingerprint"))
    return V.register(registry, arriving).select("batch_id", "moved_from", "outcome")


# visibility

def _ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key)


@query(f"WITH {_II} SELECT id FROM ii WHERE {_SHOWN}")
def q_catalogued(t):
    return _ids(S.catalogued(items(t)))


@query(f"WITH {_II} SELECT id FROM ii WHERE {_SHOWN} AND NOT clarification AND NOT reflection AND NOT evidence AND NOT sensitive")
def q_discoverable(t):
    return _ids(S.discoverable(items(t)))


@query(f"WITH {_II} SELECT id, told_by IS NOT DISTINCT FROM 'c8' AS mine FROM ii WHERE status = 'draft'")
def q_drafts(t):
    own = _ids(S.drafts(items(t), "c8")).withColumn("mine", F.lit(True))
    return _ids(S.drafts(items(t))).join(own, "id", "left").withColumn("mine", F.coalesce("mine", F.lit(False)))


@query(f"WITH {_PP} SELECT id, status FROM pp WHERE status IN ('proposed', 'estimated')")
def q_pending(t):
    return S.with_status(people(t), "proposed", "estimated").select("id", "status")


@query(f"WITH {_II} SELECT id FROM ii WHERE told_by = 'c14' OR p1 = 'c14' OR p2 = 'c14'")
def q_involves(t):
    return _ids(items(t).where(S.involves("c14")))


@query(f"""WITH {_II} SELECT 'clarification' AS kind, id FROM ii WHERE {_SHOWN} AND clarification AND (p1 = 'c14' OR p2 = 'c14' OR ref = 'c14')
UNION ALL SELECT 'reflection', id FROM ii WHERE {_SHOWN} AND reflection AND (p1 = 'c14' OR p2 = 'c14' OR place = 'c14') UNION ALL SELECT 'evidence', id FROM ii WHERE {_SHOWN} AND evidence AND place = 'n3'""")
def q_fragments(t):
    parts = [S.fragments_for(items(t), kind, target).select(F.lit(kind).alias("kind"), "id") for kind, target in (("clarification", "c14"), ("reflection", "c14"), ("evidence", "n3"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {_II} SELECT type, count(*) AS n FROM ii WHERE type <> 'story' GROUP BY 1")
def q_artifacts(t):
    return S.artifacts(items(t)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_II} SELECT 'known' AS filter, id FROM ii WHERE type IN ('letter', 'event') UNION ALL SELECT 'unknown', id FROM ii")
def q_timeline_types(t):
    own = items(t)
    return S.of_types(own, ("letter", "event", "nonsense"), ITEM_TYPES).select(F.lit("known").alias("filter"), "id").unionByName(S.of_types(own, ("nonsense",), ITEM_TYPES).select(F.lit("unknown").alias("filter"), "id"))


@query(f"WITH {_II} SELECT 'shelf' AS shelf, id FROM ii WHERE type IN ('letter', 'document') UNION ALL SELECT 'museum', id FROM ii WHERE type = 'object'")
def q_shelves(t):
    return S.of_types(items(t), ("letter", "document"), ITEM_TYPES).select(F.lit("shelf").alias("shelf"), "id").unionByName(S.of_types(items(t), ("object",), ITEM_TYPES).select(F.lit("museum").alias("shelf"), "id"))


@query(f"WITH {_II} SELECT 'both' AS bounds, id FROM ii WHERE CAST(substr(date, 1, 4) AS INT) BETWEEN 1994 AND 1996 UNION ALL SELECT 'one', id FROM ii")
def q_year_window(t):
    return S.in_years(items(t), "1994", " 1996").select(F.lit("both").alias("bounds"), "id").unionByName(S.in_years(items(t), "1994", "").select(F.lit("one").alias("bounds"), "id"))


@query(f"WITH {_II} SELECT id FROM ii WHERE abs(CAST(substr(date, 1, 4) AS INT) - 1995) <= 2")
def q_map_window(t):
    return _ids(S.around(items(t), 1995))


@query(f"WITH {_II} SELECT id FROM ii WHERE type = 'story' AND k % 18 <> 7")
def q_memories(t):
    stories = S.of_types(items(t), ("story",), ITEM_TYPES)
    return _ids(S.without(stories, stories.where("k % 18 = 7")))


@query(f"WITH {_DD}, s AS (SELECT DISTINCT id FROM dd) SELECT id, 'pending' AS open, 'reviewed' AS done FROM s")
def q_import_status(t):
    own = sessions(t).select("id", F.lit("pending").alias("status"))
    settled = people(t).withColumn("status", F.lit("confirmed"))
    return S.import_status(own, people(t)).withColumnRenamed("status", "open").join(S.import_status(own, settled).withColumnRenamed("status", "done"), "id")


@query(f"WITH {_II} SELECT id FROM ii WHERE {_SHOWN} AND (place = 'o33' OR (k % 3 <> 0 AND CASE WHEN k % 11 = 0 THEN 'o' || (k + 20000000) ELSE id END = 'o40') OR ref = 'o40')")
def q_referencing(t):
    return _ids(J.extraction_refs(items(t), "o40", "items"))


@query(f"WITH {_PP} SELECT id FROM pp WHERE lower(email) = 'user77@mail.example'")
def q_person_for_email(t):
    return _ids(S.person_for_email(people(t), "uSER77@mail.EXAMPLE"))


@query(f"WITH {_II} SELECT id FROM ii WHERE {_SHOWN} AND (told_by = 'c14' OR p1 = 'c14' OR p2 = 'c14' OR contains(lower(title || ' ' || '' || ' ' || story), '1-urgent') OR contains(lower(transcription), 'weather of f'))")
def q_shortlist(t):
    return _ids(S.shortlist(items(t), "c14", ["1-Urgent", "weather of f", " "]).where(S.involves("c14") | F.contains(F.lower("story"), F.lit("1-urgent")) | F.contains(F.lower("transcription"), F.lit("weather of f"))))


@query(f"""WITH {_II} SELECT id, CASE type WHEN 'photo' THEN 'Photograph' WHEN 'audio' THEN 'Recording' WHEN 'video' THEN 'Film' ELSE upper(type[1]) || substr(type, 2) END AS label FROM ii WHERE type <> 'event'
UNION ALL SELECT id, 'event-x' FROM ii WHERE type = 'event'""")
def q_type_labels(t):
    return items(t).select("id", S.type_label(F.when(F.col("type") == "event", "event-x").otherwise(F.col("type"))).alias("label"))


@query("""WITH b AS (SELECT c_custkey AS page, c_custkey % 5 * 90 AS rotation, CASE WHEN c_custkey % 7 = 0 THEN 'transcribing' ELSE 'idle' END AS state FROM customer)
SELECT page FROM b WHERE NOT (rotation % 360 <> 0 OR state = 'transcribing')""")
def q_available(t):
    k = F.col("c_custkey")
    busy = t.customer.select(k.alias("page"), (k % 5 * 90).alias("rotation"), F.when(k % 7 == 0, "transcribing").otherwise("idle").alias("state"))
    return S.available(busy.select("page"), busy)


@query(f"WITH {_BB} SELECT batch_id, count(*) FILTER (WHERE doc_status = 'confirmed')::INT AS confirmed, count(*)::INT AS documents FROM bb WHERE status <> 'confirmed' GROUP BY 1 HAVING count(*) FILTER (WHERE doc_status <> 'confirmed') > 0")
def q_open_batches(t):
    return S.open_batches(batches(t)).select("batch_id", "confirmed", "documents")


@query(f"WITH {_PP} SELECT min(pos) FILTER (WHERE pos % 3 <> 0) AS first, 10 AS again FROM pp")
def q_resume(t):
    queue = people(t).select(F.col("pos").alias("id"), "pos")
    done = queue.where("id % 3 = 0")
    own = queue.select(F.col("id").cast("string").alias("id"), "pos")
    return S.resume(own, done.select(F.col("id").cast("string").alias("id")), "9").select(F.col("id").cast("long").alias("first")).crossJoin(S.resume(own, done.select(F.col("id").cast("string").alias("id")), "10").select(F.col("id").cast("int").alias("again")))


# links

@query(f"WITH {_TT}, {_II} SELECT tt.theme, CAST(row_number() OVER (PARTITION BY tt.theme ORDER BY o_orderkey) - 1 AS INT) AS pos, tt.id FROM tt WHERE tt.id IN (SELECT id FROM ii)")
def q_arrangement(t):
    return J.arrangement(themes(t), items(t).select("id")).select("theme", "pos", "id")


@query(f"WITH {_II} SELECT id FROM ii WHERE ref = 'o43' AND id <> 'o43' AND comment_on IS DISTINCT FROM 'o43' AND NOT clarification AND NOT evidence")
def q_back_links(t):
    return _ids(J.back_links(items(t), "o43"))


@query(f"""WITH {_II}, {_TT}, s AS (SELECT * FROM ii WHERE {_SHOWN}), live AS (SELECT id FROM s)
SELECT 'people-ref' AS rule, id, p AS target FROM (SELECT id, unnest([p1, p2]) AS p FROM s) WHERE substr(p, 2)::BIGINT NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'places-ref', id, place FROM s WHERE substr(place, 2)::BIGINT NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'themes-ref', id, theme FROM s WHERE theme NOT IN (SELECT theme FROM tt) UNION ALL SELECT 'orgs-ref', id, org FROM s WHERE substr(org, 2)::BIGINT NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'item-ref', id, ref FROM s WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM live) UNION ALL SELECT 'comment-on', id, comment_on FROM s WHERE comment_on IS NOT NULL AND comment_on NOT IN (SELECT id FROM live)
UNION ALL SELECT 'extraction', id, 'o' || (k + 20000000) FROM s WHERE k % 3 <> 0 AND k % 11 = 0 UNION ALL SELECT 'theme-entry', theme, id FROM tt WHERE id NOT IN (SELECT id FROM live)""")
def q_integrity(t):
    return J.integrity(items(t), people(t), places(t), themes(t), orgs(t))


@query(f"""WITH {_EE} SELECT 'edge-endpoint' AS rule, a || '/' || b || '/' || kind AS id, target FROM (SELECT *, unnest([a, b]) AS target FROM ee) WHERE substr(target, 2)::BIGINT % 10 = 3""")
def q_edge_endpoints(t):
    return J.edge_endpoints(edges(t), people(t).where("pos % 10 <> 3"))


@query(f"WITH {_EE}, p AS (SELECT b AS child, list_sort(list_distinct(list(a))) AS parents FROM ee WHERE kind = 'parent' GROUP BY 1) SELECT array_to_string(parents, '+') AS family, array_to_string(list_sort(list(child)), ',') AS children FROM p GROUP BY 1")
def q_families(t):
    return J.families(edges(t)).select("family", F.array_join("children", ",").alias("children"))


@query(f"WITH {_DD} SELECT person_id, arg_min(basis, (id, attempt, turn)) AS basis FROM dd WHERE basis IS NOT NULL GROUP BY 1")
def q_estimate_basis(t):
    return J.estimate_basis(sessions(t)).select("person_id", F.col("basis.text").alias("basis"))


def _age_sql(b: str, bp: str, d: str) -> str:
    y = f"CAST(substr({d}, 1, 4) AS INT) - CAST(substr({b}, 1, 4) AS INT)"
    return f"CASE WHEN {bp} = 'exact' THEN CAST({y} - CASE WHEN substr({d}, 6) >= substr({b}, 6) THEN 0 ELSE 1 END AS VARCHAR) WHEN {bp} = 'before' OR {b} IS NULL THEN NULL ELSE ({y} - 1) || '–' || ({y}) END"


@query(f"WITH {_EE}, {_PP} SELECT ee.a, ee.b, ee.date, {_age_sql('x.dob', 'x.dobp', 'ee.date')} AS age_a, {_age_sql('y.dob', 'y.dobp', 'ee.date')} AS age_b FROM ee JOIN pp x ON x.id = ee.a JOIN pp y ON y.id = ee.b WHERE kind = 'spouse' AND date IS NOT NULL")
def q_marriages(t):
    return J.marriages(edges(t), people(t)).select("a", "b", F.col("date.date").alias("date"), D.age_label(F.col("age_a")).alias("age_a"), D.age_label(F.col("age_b")).alias("age_b"))


@query(f"WITH {_DD}, {_PP}, l AS (SELECT id, max(attempt) AS attempt FROM dd GROUP BY 1) SELECT dd.id, person_id, decision, coalesce(pp.name, person_id) AS name FROM dd JOIN l USING (id, attempt) LEFT JOIN pp ON pp.id = person_id")
def q_last_decisions(t):
    return J.last_decisions(sessions(t), people(t)).select("id", "person_id", "decision", "name")


@query(f"""WITH {_II}, n AS (SELECT told_by AS person, id, date FROM ii WHERE told_by IS NOT NULL UNION ALL SELECT unnest([p1, p2]), id, date FROM ii)
SELECT person, arg_min(id, (date, id)) AS item, min(date) AS date FROM n WHERE substr(person, 2)::BIGINT IN (SELECT c_custkey FROM customer) GROUP BY 1""")
def q_first_document(t):
    return J.first_document(items(t), people(t))


@query(f"WITH {_II}, {_TT}, n AS (SELECT DISTINCT theme FROM tt) SELECT id, 'Theme ' || substr(n.theme, 2) AS theme_title FROM ii LEFT JOIN n ON n.theme = ii.theme")
def q_theme_titles(t):
    return J.theme_title(items(t), themes(t).select("id", "title")).select("id", "theme_title")


# counts

@query(f"""WITH {_II} SELECT 'people' AS kind, p AS id, count(*) AS n FROM (SELECT unnest([p1, p2]) AS p FROM ii) GROUP BY 2
UNION ALL SELECT 'places', place, count(*) FROM ii WHERE k % 3 = 0 AND p1 = 'c14' GROUP BY 2 UNION ALL SELECT 'themes', theme, count(*) FROM ii GROUP BY 2""")
def q_ref_counts(t):
    return A.ref_counts(items(t), "c14")


@query(f"WITH {_LL}, {_II}, n AS (SELECT place AS id, count(*) AS n FROM ii GROUP BY 1) SELECT ll.id, round((CASE precision WHEN 'street' THEN 1.6 WHEN 'town' THEN 2.2 ELSE 1.0 END) * (2 + 6 * n / (SELECT max(n) FROM n)), 6) AS radius FROM ll JOIN n USING (id)")
def q_pin_radius(t):
    counts = A.ref_counts(items(t)).where("kind = 'places'").select("id", "n")
    top = counts.agg(F.max("n").alias("most"))
    return places(t).join(counts, "id").crossJoin(F.broadcast(top)).select("id", F.round(A.pin_radius(K.marker_ring(F.col("precision")), F.col("n"), F.col("most")), 6).alias("radius"))  # one row


@query(f"WITH {_II} SELECT place, p1 AS person, count(*) AS n FROM ii WHERE k % 3 = 0 GROUP BY 1, 2")
def q_people_at_places(t):
    return A.people_at_places(items(t))


@query(f"WITH {_II} SELECT DISTINCT p1 AS person FROM ii WHERE k % 3 = 0 AND abs(CAST(substr(date, 1, 4) AS INT) - 1996) <= 2")
def q_person_chips(t):
    return A.people_at_places(S.around(items(t), 1996)).select("person").distinct()


@query("SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE min(year(o_orderdate)) || '–' || max(year(o_orderdate)) END AS years FROM orders GROUP BY 1")
def q_year_ranges(t):
    return t.orders.groupBy("o_custkey").agg(A.year_range(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).alias("years"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def q_duplicate_ids(t):
    return A.duplicate_ids(t.lineitem, "l_orderkey")


@query(f"WITH {_BB} SELECT count(*) AS documents, count(*) FILTER (WHERE doc_status <> 'confirmed') AS unconfirmed FROM bb")
def q_boundary_counters(t):
    return A.boundary_counters(batches(t))


@query("SELECT doc_id, round(coalesce(list_avg(list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: CASE WHEN contains(w, 'e') THEN 1.0 ELSE 0.0 END)), 0.0), 6) AS conf FROM documents")
def q_line_confidence(t):
    return t.documents.select("doc_id", F.round(A.mean_flag(F.transform(X.line_words(F.col("text")), lambda w: F.contains(w, F.lit("e")).cast("double"))), 6).alias("conf"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view') AND value >= 60)::INT AS strong FROM events GROUP BY 1")
def q_strong_words(t):
    level = F.when(F.col("event_type").isin("click", "view"), "5").otherwise("4")
    row = F.concat_ws("\t", level, *[F.lit("0")] * 9, F.col("value").cast("string"), F.lit("w"))
    return t.events.groupBy("user_id").agg(A.strong_words(F.array_join(F.collect_list(row), "\n")).alias("strong"))


@query("SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
def q_best_class(t):
    return A.argmax(t.lineitem.withColumn("at", F.struct("l_linenumber", "l_partkey")), ["l_orderkey"], "l_quantity", "l_partkey", "at")


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS g, unnest([c_custkey % 50, c_custkey // 3 % 200]) AS s FROM customer), d AS (SELECT DISTINCT * FROM s),
u AS (SELECT min(id) AS id FROM d GROUP BY g, s HAVING count(*) = 1) SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT id FROM u)""")
def q_unique_signals(t):
    k = F.col("c_custkey")
    return A.unique_signals(t.customer, "c_custkey", F.col("c_nationkey"), F.array(k % 50, F.floor(k / 3) % 200))


@query(f"WITH {_II} SELECT id, transcription AS text FROM ii WHERE transcription <> ''")
def q_item_transcripts(t):
    return A.transcripts(items(t))


@query("""WITH m AS (SELECT o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN m USING (o_custkey) WHERE o_totalprice * 3 >= median""")
def q_tall_boxes(t):
    return A.tall_boxes(t.orders, "o_custkey", "o_totalprice").select("o_orderkey")


@query(f"WITH {_DD} SELECT " + ", ".join(f"count(*) FILTER (WHERE decision = '{d}') AS {d}" for d in ("confirm", "estimate", "reject", "skip")) + " FROM dd")
def q_decision_tally(t):
    return A.decision_tally(sessions(t).select(F.explode("attempts").alias("a")).select(F.explode("a.decisions").alias("d")).select("d.decision"))


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def q_once(t):
    return A.once(t.events.select("event_type", "user_id", "event_id"), ["event_type", "user_id"], "event_id")


# order

@query("""SELECT conv_id, CASE WHEN arg_max(role, turn) <> 'assistant' THEN arg_max(turn, turn) END AS current FROM conversations GROUP BY 1""")
def q_session_current(t):
    return W.session_current(t.conversations.select("conv_id", "turn", (F.col("role") == "assistant").alias("last"), F.col("turn").alias("person_id")), ["conv_id"], "turn")


@query(f"WITH {_II} SELECT id, row_number() OVER (ORDER BY date, id) AS place FROM ii ORDER BY date, id LIMIT 40")
def q_by_date(t):
    first = W.by_date(items(t)).select("id", "date").limit(40)  # the first page of the index
    return first.select("id", F.row_number().over(_by_all("date", "id")).cast("long").alias("place"))


def _by_all(*order: str):
    from pyspark.sql.window import Window
    return Window.orderBy(*order)


@query(f"WITH {_II} SELECT id FROM ii ORDER BY CASE WHEN k % 2 = 0 THEN date ELSE '1900-01-01' END DESC, id LIMIT 5")
def q_recent(t):
    none = F.lit(None).cast("string")
    return _ids(W.recent(items(t).withColumns({"created_at": none, "recorded": F.when(F.col("k") % 2 == 1, "1900-01-01"), "created": none})))


@query("""WITH y AS (SELECT user_id AS page, event_id, epoch_us(ts) // 1000000 % 5000 AS top FROM events)
SELECT page, arg_min(event_id, (CASE WHEN top <= 2500 AND 2500 <= top + 30 THEN 0 WHEN top > 2500 THEN 1 ELSE 2 END, abs(top - 2500), event_id)) AS line FROM y GROUP BY 1""")
def q_band_anchor(t):
    top = F.unix_timestamp(F.col("ts").cast("timestamp")) % 5000
    lines = t.events.select(F.col("user_id").alias("page"), F.col("event_id").alias("index"), top.alias("top"), (top + 30).alias("bottom"))
    return W.band_anchor(lines, "page", F.lit(2500))


# dates

@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(datediff('day', DATE '1996-05-14', CAST(o_orderdate AS DATE)) AS INT) END AS days FROM orders")
def q_days_from(t):
    return t.orders.select("o_orderkey", D.days_from(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderkey") % 2 == 0, "exact").otherwise("month"), F.lit("1996-05-14").cast("date")).alias("days"))


@query(f"""WITH {_PP} SELECT id, CASE WHEN dobp <> 'before' AND dod IS NOT NULL THEN substr(dob, 1, 4) || '–' || substr(dod, 1, 4) WHEN dobp <> 'before' THEN 'b. ' || substr(dob, 1, 4) WHEN dod IS NOT NULL THEN 'd. ' || substr(dod, 1, 4) END AS line FROM pp""")
def q_life_lines(t):
    return people(t).select("id", D.life_line(F.col("dob"), F.col("dod")).alias("line"))


_GD = """g AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%-d') || ' ' || upper(strftime(o_orderdate, '%b')) || ' ' || year(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)"""


@query(f"""WITH {_GD} SELECT k AS o_orderkey, CASE WHEN k % 5 = 4 THEN substr(iso, 1, 4) ELSE iso END AS date, CASE k % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'approx' WHEN 2 THEN 'before' WHEN 3 THEN 'between' ELSE 'after' END AS precision,
CASE WHEN k % 5 = 3 THEN iso END AS date2 FROM g""")
def q_parse_gedcom_dates(t):
    k, iso = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "yyyy-MM-dd")
    d = D.gedcom_date(iso, F.lit("exact"))
    value = F.when(k == 0, d).when(k == 1, F.concat(F.lit("EST "), d)).when(k == 2, F.concat(F.lit("BEF "), d)).when(k == 3, F.concat(F.lit("BET "), d, F.lit(" AND "), d)).otherwise(F.concat(F.lit("AFT "), F.substring(iso, 1, 4)))
    return t.orders.select("o_orderkey", D.parse_gedcom_date(value).alias("g")).select("o_orderkey", "g.*")


@query(f"""WITH {_GD} SELECT k AS o_orderkey, CASE k % 5 WHEN 0 THEN iso WHEN 1 THEN iso WHEN 2 THEN iso WHEN 3 THEN substr(iso, 1, 7) END AS date, CASE k % 5 WHEN 3 THEN 'month' WHEN 4 THEN NULL ELSE 'exact' END AS precision FROM g""")
def q_date_facts(t):
    k, d = F.col("o_orderkey") % 5, "o_orderdate"
    said = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d/M/yyyy")).when(k == 2, F.date_format(d, "MMMM d, yyyy")).when(k == 3, F.date_format(d, "MMM yyyy")).otherwise("some day")
    return t.orders.select("o_orderkey", D.normalize_date_fact(said, F.lit("exact")).alias("f")).select("o_orderkey", "f.*")


@query("SELECT c_custkey, CAST(CASE WHEN c_custkey % 150 BETWEEN 1 AND 109 THEN c_custkey % 150 END AS INT) AS age FROM customer")
def q_age_facts(t):
    return t.customer.select("c_custkey", D.normalize_age_fact(F.concat(F.lit(" "), (F.col("c_custkey") % 150).cast("string"))).alias("age"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN year(o_orderdate) // 10 * 10 END AS INT) AS year FROM orders")
def q_suggestion_years(t):
    k, y = F.col("o_orderkey") % 3, F.year("o_orderdate")
    said = F.when(k == 0, F.concat(F.lit("summer "), y.cast("string"))).when(k == 1, F.concat(F.lit("the "), (F.floor(y / 10) * 10).cast("string"), F.lit("s"))).otherwise("long ago")
    return t.orders.select("o_orderkey", D.suggestion_year(said).alias("year"))


@query(f"WITH {_PP} SELECT id, CASE WHEN dod IS NOT NULL THEN dod ELSE CAST(CAST(substr(dob, 1, 4) AS INT) + 20 + pos % 9 AS VARCHAR) END AS date, CASE WHEN dod IS NOT NULL THEN 'exact' ELSE 'approx' END AS precision FROM pp")
def q_event_dates(t):
    ages = F.array((F.col("pos") % 9).cast("int"), (F.col("pos") % 9 + 20).cast("int"))
    return people(t).select("id", D.event_date(F.col("dod"), F.col("dob"), ages).alias("e")).select("id", "e.*")


# text

@query("""WITH w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, w, w[1:5] AS seen FROM w)
SELECT doc_id, CAST(coalesce(list_sum(list_transform(w, lambda x: CASE WHEN x[1:2] = '~~' THEN 0 WHEN list_contains(seen, x) THEN 1 ELSE 0 END)), 0) AS BIGINT) AS hits FROM s""")
def q_word_flags(t):
    words = X.line_words(F.col("text"))
    return t.documents.select("doc_id", F.aggregate(X.word_confidence(words, F.slice(words, 1, 5)), F.lit(0).cast("long"), lambda a, x: a + x).alias("hits"))


@query("""SELECT p_partkey, list_transform(list_zip(string_split(p_name, ' '), [1, 2]), lambda x: x[1] || ':' || CASE WHEN x[2] = 1 + p_partkey % 2 THEN '0.0' ELSE '1.0' END) [1:len(string_split(p_name, ' '))] AS flags FROM part""")
def q_self_report(t):
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.lit(0.5).alias("conf")))
    told = X.apply_self_report(words, F.array((F.col("p_partkey") % 2 + 1).cast("int")))
    return t.part.select("p_partkey", F.transform(told, lambda x: F.concat_ws(":", x["word"], x["conf"].cast("string"))).alias("flags"))


@query(f"WITH {_PP} SELECT id, name FROM pp WHERE contains(lower(name), 'elm') ORDER BY pos LIMIT 10")
def q_search_people(t):
    return K.search_people(people(t), " Elm ").select("id", "name")


@query(f"""WITH {_PP}, {_EE} SELECT 'person' AS tool, id AS a, status AS b FROM pp WHERE id = 'c14' UNION ALL SELECT 'relationships', a, b FROM ee WHERE a = 'c14' OR b = 'c14'""")
def q_lookups(t):
    one = K.person(people(t), "c14").select(F.lit("person").alias("tool"), F.col("id").alias("a"), F.col("status").alias("b"))
    return one.unionByName(K.relationships(edges(t), "c14").select(F.lit("relationships").alias("tool"), "a", "b"))


@query(f"""WITH {_II}, h AS (SELECT id, title, k % 6 = 0 AS draft, story, list_filter(list_transform(string_split(story, '. '), lambda s: s || CASE WHEN ends_with(s, '.') THEN '' ELSE '.' END), lambda s: contains(s, 'c14')) AS hits FROM ii
  WHERE p1 = 'c14' OR p2 = 'c14' OR contains(lower(story), 'c14'))
SELECT id, title, draft, CASE WHEN len(hits) > 0 THEN hits[1] ELSE string_split(story, '. ')[1] || '.' END AS quote FROM h""")
def q_attested(t):
    return K.attested(items(t), "c14").select("id", "title", "draft", F.get("quotes", 0).alias("quote"))


@query(f"WITH {_II} SELECT id, title FROM ii WHERE contains(lower(story), '2-high') ORDER BY id LIMIT 5")
def q_search_items(t):
    return K.search_items(items(t), "2-HIGH").select("id", "title")


@query(f"WITH {_PP} SELECT min(pos) AS pos FROM pp WHERE lower(name) = 'cora elm' OR alias = 'cora elm'")
def q_known_as(t):
    return X.known_as(people(t), " CORA elm").select("pos")


@query(f"""WITH {_PP} SELECT id AS marker FROM pp UNION SELECT name FROM pp UNION SELECT alias FROM pp WHERE length(alias) > 2 AND alias <> 'al13' UNION SELECT lower(email) FROM pp UNION SELECT unnest(string_split(name, ' ')) FROM pp EXCEPT SELECT 'Oak'""")
def q_table_markers(t):
    return X.table_markers(people(t), common=("oak",), generic=("al13",))


@query(f"""WITH {_PP}, {_LL} SELECT dob AS marker FROM pp WHERE length(dob) > 6 UNION SELECT dod FROM pp WHERE dod IS NOT NULL
UNION SELECT m FROM (SELECT unnest([CAST(lat AS VARCHAR), CAST(lng AS VARCHAR)]) AS m FROM ll) WHERE regexp_matches(m, '\\.\\d{{4,}}$')""")
def q_date_geo_markers(t):
    return X.date_markers(people(t)).unionByName(X.geo_markers(places(t)))


@query("""WITH m AS (SELECT DISTINCT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS marker FROM customer WHERE c_custkey % 3 = 0)
SELECT c_custkey, marker FROM customer JOIN m ON c_name = marker""")
def q_offenders(t):
    texts = t.customer.select("c_custkey", F.concat(F.lit("from ("), F.col("c_name"), F.lit("), x")).alias("text"))
    return X.offenders(texts, "c_custkey", "text", t.customer.where("c_custkey % 3 = 0").select(F.col("c_name").alias("marker")))


@query(f"""WITH {_PP} SELECT id, ['spouse', 'parent', 'parent', 'inlaw'][pos % 4 + 1] AS kind, lower(name) AS claim FROM pp""")
def q_attested_claims(t):
    phrase = _pick(("husband of ", "son of ", "mother of ", "sister-in-law of "), F.col("pos") % 4)
    return X.attested_claims(people(t).withColumns({"bio": F.concat(phrase, F.col("name"), F.lit(".")), "relation": F.lit("")})).select("id", "kind", "claim")


@query(f"""WITH {_PP}, {_EE}, c AS (SELECT x.id, x.pos, lower(y.name) AS claim, y.pos AS ypos FROM pp x JOIN pp y ON y.pos = (x.pos + 1) % (SELECT count(*) FROM pp)),
f AS (SELECT c.id, c.claim, list(pp.id) AS targets FROM c JOIN pp ON lower(pp.name) = c.claim GROUP BY 1, 2),
u AS (SELECT a AS id, b AS target FROM ee WHERE kind = 'spouse' UNION SELECT b, a FROM ee WHERE kind = 'spouse')
SELECT id, 'spouse' AS kind, claim, len(targets)::INT AS n FROM f WHERE NOT list_contains(targets, id) AND NOT EXISTS (SELECT 1 FROM u WHERE u.id = f.id AND list_contains(f.targets, u.target))""")
def q_attested_gaps(t):
    own = people(t)
    n = own.agg(F.count(F.lit(1)).alias("n"))
    said = own.crossJoin(F.broadcast(n)).select("pos", ((F.col("pos") + 1) % F.col("n")).alias("to")).join(own.select(F.col("pos").alias("to"), F.col("name").alias("other")), "to").select("pos", F.concat(F.lit("wife of "), "other").alias("bio"))  # one row
    return X.attested_gaps(own.join(said, "pos").withColumn("relation", F.lit("")), edges(t)).select("id", "kind", "claim", "n")


@query("""SELECT conv_id, string_agg(CASE WHEN turn % 3 = 0 THEN role || ' (thinking): hm' || chr(10) ELSE '' END || role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def q_history(t):
    return K.history(t.conversations.withColumn("thinking", F.when(F.col("turn") % 3 == 0, "hm")), ["conv_id"], "turn")


@query("SELECT conv_id AS page, string_agg(CASE WHEN turn % 2 = 1 THEN 'edited ' || turn ELSE text END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def q_corrected_text(t):
    lines = t.conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("index"), "text")
    return X.corrected_text(lines, lines.where("index % 2 = 1").withColumn("text", F.concat(F.lit("edited "), F.col("index").cast("string"))), "page", "index", "text")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'plain:a |struck:' || p_name || '|plain: z' ELSE 'underlined:' || p_name || '|plain: z' END AS parts FROM part")
def q_struck_parts(t):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a ~~"), "p_name", F.lit("~~ z"))).otherwise(F.concat(F.lit("~"), "p_name", F.lit("~ z")))
    return t.part.select("p_partkey", F.array_join(F.transform(X.struck_parts(line), lambda p: F.concat_ws(":", p["kind"], p["text"])), "|").alias("parts"))


@query("""WITH l AS (SELECT o_custkey AS doc, o_orderkey AS pos, o_orderkey % 3 = 0 AS is_table, o_orderkey % 5 = 0 AS blank FROM orders), m AS (SELECT *, is_table AND NOT blank AS tab FROM l),
b AS (SELECT *, CASE WHEN NOT blank AND (coalesce(lag(blank) OVER w, true) OR lag(tab) OVER w <> tab) THEN 1 ELSE 0 END AS o FROM m WINDOW w AS (PARTITION BY doc ORDER BY pos)),
n AS (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY pos) AS block_no FROM b) SELECT doc, CAST(block_no AS BIGINT) AS block_no, bool_or(tab) AS is_table, count(*) AS lines FROM n WHERE NOT blank GROUP BY 1, 2""")
def q_markdown_blocks(t):
    k = F.col("o_orderkey")
    lines = t.orders.select(F.col("o_custkey").alias("doc"), k.alias("pos"), F.when(k % 5 == 0, "  ").when(k % 3 == 0, "| a | b |").otherwise("prose").alias("text"))
    return X.markdown_blocks(lines, "doc", "pos", "text").groupBy("doc", "block_no").agg(F.bool_or("is_table").alias("is_table"), F.count(F.lit(1)).alias("lines"))


@query("SELECT doc_id FROM documents WHERE contains(replace(lower(text), 'the thing', ' '), 'the th') OR contains(replace(lower(text), 'the thing', ' '), 'que el')")
def q_guards(t):
    return t.documents.where(X.holds_any(F.col("text"), ("the th", "Que El"), ("The thing",))).select("doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN NULL ELSE 'm' || c_custkey END AS match FROM customer")
def q_strip_kin(t):
    k = F.col("c_custkey")
    said = F.array(F.struct(F.when(k % 4 == 3, "place").otherwise("person").alias("kind"), _pick((" Mam", "GRANDDAD ", "Wife", "Aunty"), k % 4).alias("name"), _id("m", k).alias("match")))
    return t.customer.select("c_custkey", F.get(X.strip_kin_matches(said), 0)["match"].alias("match"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'We saw Ada Elm in the garden that day.' WHEN 1 THEN 'Only ada was there in the evening.' ELSE 'Nobody of that name was seen at all.' END AS quote FROM customer""")
def q_quote_from(t):
    k = F.col("c_custkey") % 3
    story = F.when(k == 0, "NOTES 1901. Only ada was there in the evening. We saw Ada Elm in the garden that day. End.").when(k == 1, "Short one. Nobody of that name was seen at all. Only ada was there in the evening").otherwise(
        "Nobody of that name was seen at all. Another long sentence without it.")
    return t.customer.select("c_custkey", X.quote_from(story, "Ada Elm").alias("quote"))


@query("SELECT c_custkey, 'son – ' || lower(c_mktsegment) || ' of c' || c_custkey AS relation FROM customer")
def q_personable(t):
    return t.customer.select("c_custkey", X.personable(F.concat(F.lit("son ["), "c_name", F.lit("] ("), F.lower("c_mktsegment"), F.lit(") of c"), F.col("c_custkey").cast("string"))).alias("relation"))


@query("""WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s)
SELECT p_partkey, CASE WHEN n + CASE WHEN slug = 'red-widget' THEN 3 ELSE 0 END = 1 THEN slug ELSE slug || '-' || (n + CASE WHEN slug = 'red-widget' THEN 3 ELSE 0 END) END AS new_id FROM r""")
def q_unique_ids(t):
    taken = t.spark.createDataFrame([("red-widget",), ("red-widget-3",)], "id string")
    return X.unique_ids(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey", taken).select("p_partkey", "new_id")


@query("""WITH u AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT strftime(d, '%Y-%m-%d') AS day, 'story-' || strftime(d, '%Y-%m-%d') || CASE WHEN day(d) % 2 = 0 THEN '-02' ELSE '-01' END AS story_id FROM u""")
def q_story_ids(t):
    day = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()
    taken = day.where("int(substring(day, 9, 2)) % 2 = 0").select(F.explode(F.array(F.concat(F.lit("story-"), "day", F.lit("-01")), F.concat(F.lit("story-"), "day", F.lit("-03")))).alias("id"))
    return K.next_story_id(taken, F.col("day"), day).select("day", "story_id")


# graph, resolution

_FF = """ff AS (SELECT a, b FROM ee WHERE kind <> 'teacher' UNION SELECT b, a FROM ee WHERE kind <> 'teacher'), fg AS (SELECT * FROM ff WHERE substr(a, 2)::BIGINT % 5 <> 0 AND substr(b, 2)::BIGINT % 5 <> 0)"""


@query(f"WITH {_EE}, {_FF} SELECT DISTINCT a AS id FROM fg")
def q_family_ids(t):
    return R.family_ids(edges(t), people(t))


@query(f"WITH {_EE}, {_FF} SELECT a AS id, count(*) AS degree FROM fg GROUP BY 1")
def q_family_degrees(t):
    return R.family_edges(edges(t), people(t)).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


@query(f"""WITH {_EE}, par AS (SELECT a AS id FROM ee WHERE kind = 'parent' AND b = 'c11'),
z AS (SELECT id, 1 AS r FROM par UNION ALL SELECT b, 2 FROM ee WHERE kind = 'parent' AND a = 'c11' UNION ALL SELECT CASE WHEN a = 'c11' THEN b ELSE a END, CASE kind WHEN 'spouse' THEN 3 WHEN 'sibling' THEN 4 ELSE 5 END
  FROM ee WHERE kind IN ('spouse', 'sibling', 'inlaw') AND (a = 'c11' OR b = 'c11') UNION ALL SELECT b, 4 FROM ee WHERE kind = 'parent' AND a IN (SELECT id FROM par) AND b <> 'c11'),
c AS (SELECT id, min(r) AS r FROM z GROUP BY 1), f AS (SELECT a AS id, b AS other FROM ee WHERE kind <> 'teacher' UNION SELECT b, a FROM ee WHERE kind <> 'teacher')
SELECT id, ['parent', 'child', 'partner', 'sibling', 'wider'][r] AS role, (SELECT count(*) FROM f WHERE f.id = c.id AND other <> 'c11' AND other NOT IN (SELECT id FROM c)) AS unseen FROM c""")
def q_ego(t):
    return R.ego(edges(t), "c11")


@query("""WITH p AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS p FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN len(p) - 1 > 5 THEN p[1] || ',…,' || p[-2] || ',' || p[-1] ELSE array_to_string(p, ',') END AS bar FROM p""")
def q_path_bar(t):
    paths = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("p"))
    return paths.select("o_custkey", F.array_join(R.path_bar(F.col("p")), ",").alias("bar"))


@query(f"""WITH {_PP}, {_EE}, own AS (SELECT * FROM pp WHERE status <> 'proposed') SELECT 'birth' AS kind, dob AS date, id AS person, NULL AS other, NULL AS ages FROM own WHERE dobp <> 'before'
UNION ALL SELECT 'death', dod, id, NULL, NULL FROM own WHERE dod IS NOT NULL
UNION ALL SELECT 'marriage', ee.date, ee.a, ee.b, {_age_sql('x.dob', 'x.dobp', 'ee.date')} || ' and ' || {_age_sql('y.dob', 'y.dobp', 'ee.date')} FROM ee JOIN own x ON x.id = ee.a JOIN own y ON y.id = ee.b WHERE kind = 'spouse' AND date IS NOT NULL""")
def q_life_events(t):
    return R.life_events(people(t), edges(t))


@query(f"""WITH {_PP}, {_EE}, s AS (SELECT a AS id, b AS other, date FROM ee WHERE kind = 'spouse' UNION ALL SELECT b, a, date FROM ee WHERE kind = 'spouse'),
n AS (SELECT s.id, arg_min(pp.name, (date IS NULL, coalesce(date, ''), other)) AS spouse FROM s JOIN pp ON pp.id = other GROUP BY 1)
SELECT id, coalesce(spouse, CASE WHEN pos % 8 = 0 THEN 'baker' END, alias) AS detail FROM pp LEFT JOIN n USING (id)""")
def q_person_detail(t):
    return R.person_detail(people(t), edges(t))


@query(f"WITH {_EE} SELECT a, b, CASE WHEN a = 'c14' THEN kind ELSE coalesce(label_a, kind) END AS label FROM ee")
def q_relation_labels(t):
    return edges(t).select("a", "b", R.relation_label("c14").alias("label"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'HUSB' WHEN 1 THEN 'WIFE' ELSE 'HUSB' END AS first, CASE c_custkey % 3 WHEN 0 THEN 'HUSB' ELSE 'WIFE' END AS second FROM customer")
def q_roles(t):
    p = _pick(("he/him", "She/her", "they/them"), F.col("c_custkey") % 3)
    return t.customer.select("c_custkey", G._role(p, 0).alias("first"), G._role(p, 1).alias("second"))


@query(f"WITH {_PP} SELECT id, name, pos % 3 = 0 AS dead FROM pp WHERE status <> 'proposed'")
def q_gedcom_round_trip(t):
    own = people(t).withColumns({"pronouns": F.lit(None).cast("string"), "basis": F.lit(None).cast("struct<text:string,by:string,when:string,note:string>"),
                                 "residence": F.lit(None).cast("array<struct<place:string,from:string,to:string,status:string>>")})
    told = t.spark.createDataFrame([], "person string, text string")
    lines = G.export_lines(own, edges(t).where("false"), places(t), told)
    place = F.struct("section", "key", "seq", "ord", "sub")
    read = G.parse_lines(lines.select(F.row_number().over(_by_all(place)).alias("pos"), "line"))  # a document is read in order
    back, _, _ = G.import_gedcom(read, places(t))
    return back.select("id", "name", F.col("dod").isNotNull().alias("dead"))


@query(f"""WITH {_PP}, s AS (SELECT s_suppkey, 'w' || s_suppkey AS id, {_list(FIRST)}[s_suppkey % 7 + 1] || ' ' || CASE WHEN s_suppkey % 2 = 0 THEN {_list(LAST)}[s_suppkey % 11 + 1] ELSE 'New' || (s_suppkey % 20) END AS name FROM supplier),
f AS (SELECT * FROM s WHERE lower(name) NOT IN (SELECT lower(name) FROM pp)) SELECT id, name FROM pp UNION ALL SELECT arg_min(id, printf('%08d', s_suppkey)), arg_min(name, printf('%08d', s_suppkey)) FROM f GROUP BY lower(name)""")
def q_merge_people(t):
    k = F.col("s_suppkey")
    name = F.concat_ws(" ", _pick(FIRST, k % 7), F.when(k % 2 == 0, _pick(LAST, k % 11)).otherwise(_id("New", k % 20)))
    none = F.lit(None).cast("string")
    new = t.supplier.select(_id("w", k).alias("id"), name.alias("name"), _dated(none, none).alias("dob"), F.format_string("%08d", k).alias("path"))
    return M.merge_people(people(t).select("id", "name", "dob"), new).select("id", "name")


@query(f"""WITH {_PP}, x AS (SELECT o_orderkey AS k, ['person', 'place', 'theme'][o_orderkey % 3 + 1] AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'Ada Elm' WHEN 1 THEN 'Mam' WHEN 2 THEN 'al7' ELSE 'Nobody Yet' END AS name,
  CASE WHEN o_orderkey % 10 = 0 THEN 'c1' END AS match FROM orders), f AS (SELECT lower(name) AS n, id, status FROM pp UNION ALL SELECT alias, id, status FROM pp), g AS (SELECT n, min(id) AS id FROM f GROUP BY 1)
SELECT k AS item, kind, coalesce(match, CASE WHEN kind = 'person' AND name <> 'Mam' THEN g.id END, CASE WHEN kind <> 'theme' THEN replace(lower(name), ' ', '-') END) AS id,
  match IS NULL AND NOT (kind = 'person' AND name <> 'Mam' AND g.id IS NOT NULL) AND kind <> 'theme' AS minted
FROM x LEFT JOIN g ON g.n = lower(name) WHERE match IS NOT NULL OR kind <> 'theme'""")
def q_extraction_refs(t):
    k = F.col("o_orderkey")
    said = t.orders.select(k.alias("item"), _pick(("person", "place", "theme"), k % 3).alias("kind"), _pick(("Ada Elm", "Mam", "al7", "Nobody Yet"), k % 4).alias("name"), F.when(k % 10 == 0, "c1").alias("match"), F.lit(True).alias("on"), k.alias("pos"))
    return M.extraction_refs(said, people(t)).select("item", "kind", "id", "minted")


_EV = """ev AS (SELECT 'c' || (event_id % 300) AS id, event_id AS seq, ['propose', 'confirm', 'estimate', 'reject', 'promote'][event_id // 300 % 5 + 1] AS decision FROM events),
now AS (SELECT id, arg_max(CASE decision WHEN 'propose' THEN 'proposed' WHEN 'estimate' THEN 'estimated' WHEN 'reject' THEN 'deleted' ELSE 'confirmed' END, seq) AS status FROM ev GROUP BY 1)"""


def _decisions(t) -> DataFrame:
    k = F.col("event_id")
    kind = _pick(("propose", "confirm", "estimate", "reject", "promote"), F.floor(k / 300) % 5)
    return t.events.select(_id("c", k % 300).alias("id"), k.alias("at"), kind.alias("decision"), F.lit("told").alias("basis"))


@query(f"WITH {_EV} SELECT id, status, CASE WHEN status = 'estimated' THEN 'told' END AS basis FROM now")
def q_current_status(t):
    return M.current_status(_decisions(t))


@query(f"""WITH {_PP}, {_EE}, {_EV}, d AS (SELECT id FROM now WHERE status = 'deleted') SELECT 'person' AS kind, pp.id AS a, coalesce(now.status, 'confirmed') AS b FROM pp LEFT JOIN now USING (id) WHERE pp.id NOT IN (SELECT id FROM d)
UNION ALL SELECT 'edge', a, b FROM ee WHERE a NOT IN (SELECT id FROM d) AND b NOT IN (SELECT id FROM d)""")
def q_apply_decisions(t):
    own, left = M.apply_decisions(people(t), edges(t), _decisions(t))
    return own.select(F.lit("person").alias("kind"), F.col("id").alias("a"), F.col("status").alias("b")).unionByName(left.select(F.lit("edge").alias("kind"), "a", "b"))


@query(f"WITH {_PP}, {_II} SELECT id FROM pp WHERE status = 'proposed' AND id IN (SELECT p1 FROM ii UNION SELECT p2 FROM ii)")
def q_blocked_rejections(t):
    return _ids(M.blocked_rejections(S.with_status(people(t), "proposed").select("id"), J.refs(items(t), ("people",))))


@query("""WITH x AS (SELECT o_orderkey, unnest([o_custkey % 5, o_orderkey % 5, o_custkey % 5]) AS id, unnest([0, 1, 2]) AS pos FROM orders) SELECT o_orderkey, id, CAST(min(pos) AS INT) AS pos FROM x GROUP BY 1, 2""")
def q_dedupe_refs(t):
    refs = t.orders.select("o_orderkey", F.posexplode(F.array(F.col("o_custkey") % 5, F.col("o_orderkey") % 5, F.col("o_custkey") % 5)).alias("pos", "id"))
    return A.once(refs, ["o_orderkey", "id"], "pos").select("o_orderkey", "id", "pos")


@query(f"WITH {_PP} SELECT name FROM pp UNION SELECT alias FROM pp")
def q_vocabulary(t):
    own = people(t)
    return own.select("name").unionByName(own.select(F.explode("aliases").alias("name"))).distinct()


# ingest, rules

@query("SELECT c_custkey % 50 AS batch_id, c_custkey AS page FROM customer WHERE c_custkey % 4 <> 0")
def q_known_pages(t):
    flags = t.customer.select((F.col("c_custkey") % 50).alias("batch_id"), F.col("c_custkey").alias("page"))
    return I.known_pages(flags, flags.where("page % 4 <> 0"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey FROM orders), d AS (SELECT l_orderkey, arg_max(l_linenumber % 3, (l_linenumber, l_partkey)) AS d, max(l_linenumber) AS at FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_no, CASE d WHEN 0 THEN 'confirmed' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' ELSE 'review' END AS status, CASE WHEN d = 1 THEN 'new' ELSE 'old' END AS text FROM b LEFT JOIN d ON l_orderkey = o_orderkey""")
def q_reviewed(t):
    docs = t.orders.select(F.lit(1).alias("batch_id"), F.col("o_orderkey").alias("doc_no"), F.lit("old").alias("text"))
    d = t.lineitem.select(F.lit(1).alias("batch_id"), F.col("l_orderkey").alias("doc_no"), _pick(("accept", "edit", "reject"), F.col("l_linenumber") % 3).alias("decision"), F.lit("new").alias("text"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return I.reviewed(docs, d).select("doc_no", "status", "text")


@query(f"""WITH {_BB}, c AS (SELECT batch_id, page, arg_max(st, seq) AS st FROM (SELECT batch_id, page, k AS seq, 'late' AS st FROM bb WHERE k % 5 = 0 UNION ALL SELECT batch_id, page, k - 1, 'early' FROM bb WHERE k % 10 = 0) GROUP BY 1, 2)
SELECT bb.batch_id, bb.page, coalesce(c.st, doc_status) AS status FROM bb LEFT JOIN c USING (batch_id, page)""")
def q_confirmations(t):
    flat = batches(t).select("batch_id", F.explode("boundaries").alias("b")).select("batch_id", "b.pages", "b.status")
    k = F.substring("batch_id", 2, 20).cast("long")
    said = flat.select("batch_id", "pages", k.alias("confirmed_at"))
    said = said.where(k % 5 == 0).withColumn("status", F.lit("late")).unionByName(said.where(k % 10 == 0).withColumns({"status": F.lit("early"), "confirmed_at": F.col("confirmed_at") - 1}))
    return I.confirmed(flat, said).select("batch_id", F.get("pages", 0).alias("page"), "status")


@query(f"WITH {_EE}, {_II} SELECT 'item' AS kind, id AS a, NULL AS b FROM ii WHERE k % 3 <> 0 UNION ALL SELECT DISTINCT kind, a, b FROM ee WHERE kind <> 'parent'")
def q_capture(t):
    own, links = items(t).select("k", "id"), edges(t).select("a", "b", "kind")
    new, more = I.capture(own, own.where("k % 3 = 0"), links.unionByName(links), links.where("kind = 'parent'"))
    return new.select(F.lit("item").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).unionByName(more.select("kind", "a", "b"))


@query("SELECT DISTINCT CASE WHEN starts_with(p_type, 'S') THEN 'small' ELSE 'eco' END AS suite FROM part WHERE starts_with(p_type, 'S') OR starts_with(p_type, 'ECO')")
def q_affected(t):
    return I.affected(t.part.select(F.col("p_type").alias("path")), t.spark.createDataFrame([("S", "small"), ("ECO", "eco"), ("zzz", "none")], "prefix string, suite string"))


@query(f"""WITH {_II} SELECT rule, id AS record_id FROM (SELECT id, unnest(['date-parses', 'attested']) AS rule, k, type FROM ii WHERE {_SHOWN}) WHERE rule = 'date-parses' AND k % 13 = 0 OR rule = 'attested' AND type IN ('object', 'photo') AND k % 2 = 0""")
def q_completeness(t):
    odd = items(t).withColumns({"date": F.when(F.col("k") % 13 == 0, "1963-13").otherwise(F.col("date")), "provenance": F.lit(""), "source": F.when(F.col("k") % 2 == 1, "a box")})
    return Q.completeness(odd).select("rule", "record_id")


@query(f"WITH {_II}, l AS (SELECT id AS a, ref AS b FROM ii WHERE {_SHOWN} AND ref IS NOT NULL) SELECT 'one-way' AS rule, a AS record_id, b AS detail FROM l WHERE NOT EXISTS (SELECT 1 FROM l r WHERE r.a = l.b AND r.b = l.a)")
def q_one_way_links(t):
    return Q.one_way_links(items(t))


@query(f"WITH {_II} SELECT 'told-day' AS rule, id AS record_id FROM ii WHERE type = 'story' AND k % 2 = 0")
def q_told_day(t):
    told = items(t).withColumns({"recorded": F.when(F.col("k") % 2 == 0, F.concat("date", F.lit("T10:00"))).otherwise(F.date_add(F.col("date").cast("date"), 1).cast("string")), "created": F.lit(None).cast("string"), "created_at": F.lit(None).cast("string")})
    return Q.told_day_stories(told).select("rule", "record_id")


@query(f"WITH {_PP} SELECT id FROM pp WHERE 1850 + pos % 10 < CAST(substr(dob, 1, 4) AS INT)")
def q_implausible_years(t):
    return _ids(Q.implausible_years(people(t).select("id", (F.col("pos") % 10 + 1850).alias("year"), F.col("dob.date").alias("dob")), "year", "dob"))


@query("""WITH s AS (SELECT o_orderkey AS k, unnest(['unconnected-narrator', 'asked-computable-date', 'age-without-birth', 'telling-day', 'event-date', 'new-artifact']) AS rule FROM orders) SELECT rule, CAST(k AS VARCHAR) AS record_id FROM s WHERE
rule = 'unconnected-narrator' AND k % 2 = 0 OR rule = 'asked-computable-date' AND k % 6 = 0 OR rule = 'age-without-birth' AND k % 5 = 0 AND k % 3 <> 0 OR rule = 'telling-day' AND k % 7 = 0 AND k % 11 <> 5 OR rule = 'event-date' AND k % 11 = 5 OR rule = 'new-artifact' AND k % 4 = 1""")
def q_story_faults(t):
    k = F.col("o_orderkey")
    event = k % 11 == 5
    told = t.orders.select(k.alias("id"), (k % 2 == 1).alias("narrator_linked"), (k % 2 == 0).alias("asked_date"), (k % 3 == 0).alias("date_computable"), (k % 5 == 0).alias("has_age"), (k % 3 == 0).alias("has_dob"), F.lit(False).alias("asked_birth"),
                           F.when(~event, "d").alias("date"), F.when(k % 7 == 0, "d").otherwise("e").alias("told_day"), event.alias("is_event"), (k % 4 == 1).alias("names_artifact"), F.lit(False).alias("asked_artifact"))
    return Q.deterministic_violations(told).select("rule", "record_id")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record_id, rule FROM (SELECT o_orderkey, unnest(['pages', 'text', 'status']) AS rule FROM orders) WHERE rule = 'pages' AND o_orderkey % 5 = 0 OR rule = 'text' AND o_orderkey % 4 = 1 OR rule = 'status' AND o_orderkey % 4 = 3""")
def q_confirmation_rules(t):
    k = F.col("o_orderkey")
    said = t.orders.select(k.alias("id"), F.lit("b").alias("batch_id"), F.lit(0).alias("doc_index"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p"))).alias("pages"),
                           _pick(("rejected", "confirmed", "confirmed", "odd"), k % 4).alias("status"), _pick(("", " ", "t", "t"), k % 4).alias("text"))
    return Q.violations(said, "id", Q.confirmation_rules()).select("record_id", "rule")


@query("""SELECT o_orderkey AS id, e AS error FROM (SELECT o_orderkey, unnest(['missing title', 'extraction kind', 'too many questions', 'question not skippable']) AS e FROM orders) WHERE e = 'missing title' AND o_orderkey % 3 = 0 OR e = 'extraction kind' AND o_orderkey % 4 = 0
OR e = 'too many questions' AND o_orderkey % 8 > 5 OR e = 'question not skippable' AND o_orderkey % 8 > 0 AND o_orderkey % 5 = 0""")
def q_contract_errors(t):
    k = F.col("o_orderkey")
    said = F.array(F.struct(F.when(k % 4 == 0, "thing").otherwise("person").alias("kind"), F.lit("new").alias("bucket")))
    asked = F.transform(F.when(k % 8 > 0, F.sequence(F.lit(1).cast("long"), k % 8)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct((k % 5 != 0).alias("skippable"), F.array().cast("array<string>").alias("suggestions")))
    return K.contract_errors(t.orders.select(k.alias("id"), F.when(k % 3 == 0, " ").otherwise("t").alias("title"), said.alias("extractions"), asked.alias("questions")))


def _rule_rows(df: DataFrame, rules: dict, key: str) -> DataFrame:
    return Q.violations(df, key, rules).select("rule", "record_id")


@query(f"""WITH {_PP} SELECT rule, id AS record_id FROM (SELECT *, unnest(['id', 'dob', 'basis', 'name']) AS rule FROM pp) WHERE rule = 'id' AND pos % 9 = 0 OR rule = 'dob' AND pos % 4 = 3 AND pos % 7 = 0 OR rule = 'basis' AND status = 'estimated' OR rule = 'name' AND pos % 10 = 4""")
def q_person_rules(t):
    none = F.lit(None).cast("struct<text:string>")
    odd = people(t).withColumns({"key": F.col("id"), "id": F.when(F.col("pos") % 9 == 0, F.upper("id")).otherwise(F.col("id")), "basis": none, "name": F.when(F.col("pos") % 10 == 4, " ").otherwise(F.col("name")),
                                 "dob": F.when((F.col("pos") % 4 == 3) & (F.col("pos") % 7 == 0), _dated(F.lit("18x0"), F.lit("year"))).otherwise(F.col("dob"))})
    return _rule_rows(odd, Q.person_rules(), "key")


@query(f"WITH {_EE} SELECT 'kind' AS rule, a AS record_id FROM ee WHERE kind = 'sibling' UNION ALL SELECT 'ends', a FROM ee WHERE kind = 'inlaw'")
def q_relationship_rules(t):
    odd = edges(t).withColumns({"kind": F.when(F.col("kind") == "sibling", "friend").otherwise(F.col("kind")), "b": F.when(F.col("kind") == "inlaw", F.col("a")).otherwise(F.col("b"))})
    return _rule_rows(odd, Q.relationship_rules(), "a")


@query(f"WITH {_LL} SELECT 'precision' AS rule, id AS record_id FROM ll WHERE precision = 'town' UNION ALL SELECT 'lat', id FROM ll WHERE lat * 4 > 90")
def q_place_rules(t):
    return _rule_rows(places(t).withColumns({"precision": F.when(F.col("precision") == "town", "village").otherwise(F.col("precision")), "lat": F.col("lat") * 4}), Q.place_rules(), "id")


@query(f"""WITH {_II} SELECT rule, id AS record_id FROM (SELECT *, unnest(['event-kind', 'precision', 'clarification', 'reflection', 'evidence', 'sources']) AS rule FROM ii) WHERE rule = 'event-kind' AND type = 'event' AND k % 2 = 0
OR rule = 'precision' AND k % 17 = 0 OR rule = 'clarification' AND clarification AND type <> 'story' OR rule = 'reflection' AND reflection AND type <> 'story' OR rule = 'evidence' AND evidence AND type = 'story' OR rule = 'sources' AND k % 19 = 0""")
def q_item_rules(t):
    k = F.col("k")
    source = F.array(F.struct(F.when(k % 19 == 0, "ftp://x").otherwise("https://x").alias("url"), F.lit("").alias("title"), F.lit("2001").alias("accessed")))
    odd = items(t).withColumns({"kind": F.when(k % 2 == 1, "birth"), "date_precision": F.when(k % 17 == 0, "odd").otherwise("exact"), "date2": F.lit(None).cast("string"), "sources": source, "transcription_status": F.lit("")})
    return _rule_rows(odd, Q.item_rules(), "id")


# store and streams

@query(f"WITH {_II} SELECT id, CASE WHEN k % 2 = 0 THEN story END AS story FROM ii")
def q_content_for(t):
    own = items(t)
    content = own.where("k % 2 = 0").select(F.col("id").alias("item_id"), F.lit("story").alias("kind"), F.col("story").alias("text"))
    return C.content_for(own, content, "story", "story").select("id", "story")


@query(f"WITH {_PP} SELECT id FROM pp WHERE pos % 6 <> 0")
def q_queue_without_rejected(t):
    own = people(t)
    return _ids(C.rejected(own, own.select("id", F.when(F.col("pos") % 6 == 0, "reject").otherwise("confirm").alias("decision"))))


@query(f"WITH {_BB} SELECT batch_id, CAST(i AS INT) AS doc_index, doc_status AS status, CASE WHEN i = 0 THEN '' ELSE 'text of ' || page END AS text FROM bb")
def q_draft_payloads(t):
    pages = batches(t).select(F.explode("boundaries").alias("b")).select(F.get("b.pages", 0).alias("page")).where("substring(page, -1) <> '0'")
    return C.draft_payloads(batches(t), pages.withColumn("text", F.concat(F.lit("text of "), "page")), pages.withColumn("layout", F.lit("{}"))).select("batch_id", "doc_index", "status", "text")


@query(f"WITH {_BB} SELECT page, CASE WHEN k % 2 = 0 THEN doc_status ELSE 'review' END AS status FROM bb")
def q_draft_status(t):
    flat = batches(t).select("batch_id", F.explode("boundaries").alias("b")).select("batch_id", "b.pages", "b.status")
    known = flat.where(F.substring("batch_id", 2, 20).cast("long") % 2 == 0)
    return C.draft_status(flat, known).select(F.get("pages", 0).alias("page"), "status")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_name END AS content FROM part")
def q_placeholders(t):
    files = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("file"), F.col("p_name").cast("binary").alias("content"))
    return C.with_placeholder(t.part.select("p_partkey", F.col("p_partkey").alias("file")), files, "none").select("p_partkey", F.col("content").cast("string").alias("content"))


@query("SELECT event_id AS message_id FROM events WHERE event_id % 7 <> 0")
def q_outbox_pending(t):
    out = t.events.select(F.col("event_id").alias("message_id"))
    return T.pending(out, out.where("message_id % 7 = 0"))


@query("""WITH w AS (SELECT user_id AS page, arg_max(event_id * 90 % 360, (ts, event_id)) AS wished FROM events GROUP BY 1), d AS (SELECT page, CASE WHEN page % 4 = 0 THEN 0 ELSE page % 4 * 90 END AS now, wished FROM w)
SELECT page, CAST((wished - now + 360) % 360 AS BIGINT) AS delta FROM d WHERE (wished - now + 360) % 360 <> 0""")
def q_rotation_deltas(t):
    wishes = t.events.select(F.col("user_id").alias("page"), F.struct("ts", "event_id").alias("at"), (F.col("event_id") * 90 % 360).alias("rotation"))
    now = wishes.select("page").distinct().where("page % 4 <> 0").withColumn("rotation", F.col("page") % 4 * 90)
    return T.rotation_deltas(wishes, now)


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'failed' ELSE lower(o_orderstatus) END AS state FROM orders")
def q_restarted(t):
    jobs = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "transcribing").otherwise(F.lower("o_orderstatus")).alias("state"))
    return T.restarted(jobs)


@query("SELECT DISTINCT user_id FROM events")
def q_decisions_once(t):
    return T.first_decisions(t.events.select("user_id", "event_id"), "user_id").select("user_id")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '0:[' || p_size || '.0, 1.0, 2.0, 3.0]' END AS boxes FROM part""")
def q_told_boxes(t):
    said = F.when(F.col("p_partkey") % 3 == 0, F.lit("[[1, 2]]")).otherwise(F.concat(F.lit("[["), F.col("p_size").cast("string"), F.lit(", 1, 2, 3], [4]]")))
    return t.part.select("p_partkey", F.array_join(F.transform(N.line_boxes(said), lambda b: F.concat(b["index"].cast("string"), F.lit(":"), F.to_json(b["box"]))), ";").alias("boxes")).withColumn("boxes", F.replace("boxes", F.lit(","), F.lit(", ")))


@query("SELECT c_custkey, [true, true, false, false, NULL][c_custkey % 5 + 1] AS flag FROM customer")
def q_strict_flags(t):
    return t.customer.select("c_custkey", N.strict_flag(_pick(("Yes", " true", "0", "no", "maybe"), F.col("c_custkey") % 5)).alias("flag"))


@query("SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_props(t):
    answer = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_type", N.parse(answer, "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, [p_brand, p_type] AS values FROM part")
def q_clean_lists(t):
    return t.part.select("p_partkey", N.clean_list(F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.col("p_type"), F.col("p_brand")), 2).alias("values"))
