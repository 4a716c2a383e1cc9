"""Queries of the archive operators over the driver's tables, each with its SQL where SQL can
say it. A query only names columns and parameters; the work is the operator's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import dates as D
from tidewrack.functions import text as X
from tidewrack.operators import aggregates as A
from tidewrack.operators import graph as R
from tidewrack.operators import links as J
from tidewrack.operators import resolve as M
from tidewrack.operators import sequence as W
from tidewrack.operators import versions as V

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The driver's tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[f.__name__] = sql
        return f
    return register


def _all() -> None:
    from tidewrack import bindings_archive  # noqa: F401  registers its own


def queries() -> dict:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def _day(c: str):
    """A timestamp's day as an ISO string."""
    return F.date_format(c, "yyyy-MM-dd")


# versions

_LATEST = """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1 AND event_type <> 'error'"""


@query(_LATEST)
def q_latest_event(t):
    return V.current(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")


@query("""
SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high, count(DISTINCT l_linenumber) AS versions
FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(DISTINCT l_linenumber)""")
def q_version_gaps(t):
    return V.version_gaps(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_fingerprint_dups(t):
    return V.duplicate_content(t.documents, "text", "doc_id")


_LINES = "SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(f"""
WITH l AS (SELECT * FROM ({_LINES}) WHERE line <> ''), n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM l x JOIN l y ON x.line = y.line AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, shared FROM s JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
WHERE shared >= greatest(1, na.n // 2) AND shared >= greatest(1, nb.n // 2)""")
def q_pile_overlap(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return V.pile_overlap(lines, "doc_id", "line")


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def q_upsert_last(t):
    return V.latest(t.orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
WHERE before IS DISTINCT FROM event_type""")
def q_changes_only(t):
    return V.changes_only(t.events, ["user_id"], ["ts", "event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


# visibility, counts

@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def q_published(t):
    from tidewrack.operators.visibility import published
    items = t.orders.withColumns({"status": F.when(F.col("o_orderstatus") == "P", "draft").otherwise("catalogued"),
                                  "clarification": F.when(F.col("o_orderpriority") == "1-URGENT", True), "reflection": F.col("o_orderpriority") == "5-LOW",
                                  "evidence": F.lit(None).cast("boolean")})
    return published(items).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("""
WITH e AS (SELECT p_brand, p_type, n_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT 'brand' AS kind, p_brand AS id, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'type', p_type, count(*) FROM e GROUP BY 2
      UNION ALL SELECT 'nation', n_name, count(*) FROM e GROUP BY 2)
SELECT kind, id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, id) AS rank FROM c) WHERE rank <= 12""")
def q_top_entities(t):
    # the fact is counted by its two keys first; names join the counts, not the facts
    keyed = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    part = keyed.groupBy("l_partkey").agg(F.sum("n").alias("n")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    counts = None
    for kind, c in (("brand", "p_brand"), ("type", "p_type")):
        one = part.groupBy(F.col(c).alias("id")).agg(F.sum("n").alias("n")).select(F.lit(kind).alias("kind"), "id", "n")
        counts = one if counts is None else counts.unionByName(one)
    nation = keyed.groupBy("l_suppkey").agg(F.sum("n").alias("n")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    counts = counts.unionByName(nation.groupBy(F.col("n_name").alias("id")).agg(F.sum("n").alias("n")).select(F.lit("nation").alias("kind"), "id", "n"))
    return A.top_counts(counts, ["kind"]).select("kind", "id", "n", "rank")


@query("""
SELECT kind, id, count(*) AS n FROM (SELECT 'type' AS kind, event_type AS id FROM events UNION ALL SELECT 'user', CAST(user_id AS VARCHAR) FROM events)
GROUP BY 1, 2""")
def q_entity_counts(t):
    return A.entity_counts(t.events, {"type": F.col("event_type"), "user": F.col("user_id")}).select("kind", "id", "n")


@query("""
WITH u AS (SELECT user_id, list(DISTINCT event_type) AS kinds FROM events GROUP BY 1)
SELECT event_type, count(*) AS n FROM events JOIN u USING (user_id) WHERE list_contains(kinds, 'purchase') GROUP BY 1""")
def q_person_place(t):
    from tidewrack.operators.visibility import at_place
    kinds = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("people"))
    rows = t.events.join(kinds, "user_id").where(at_place("purchase", F.struct("people")))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1),
z AS (SELECT n_nationkey, n_name, coalesce(n, 0) AS n FROM nation LEFT JOIN c ON c_nationkey = n_nationkey)
SELECT n_nationkey, n_name, n, round(0.2 + 0.8 * n / greatest(1, (SELECT max(n) FROM z)), 6) AS intensity FROM z""")
def q_zero_filled(t):
    counts = t.customer.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return A.heat(A.zero_filled(t.nation.select("n_nationkey", "n_name"), "n_nationkey", counts)).select("n_nationkey", "n_name", "n", F.round("intensity", 6).alias("intensity"))


@query("SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, count(*) AS n FROM orders GROUP BY 1")
def q_decades(t):
    return A.decade_bands(t.orders, _day("o_orderdate"))


@query("""
WITH d AS (SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS decade, o_orderkey, o_orderdate FROM orders)
SELECT decade, o_orderkey, rank, remainder FROM (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY o_orderdate, o_orderkey) AS rank FROM d)
JOIN (SELECT decade, greatest(0, count(*) - 8) AS remainder FROM d GROUP BY 1) USING (decade) WHERE rank <= 8""")
def q_band_cap(t):
    banded = t.orders.withColumn("decade", A.decade(F.year("o_orderdate")))
    return A.band_heads(banded.select("decade", "o_orderkey", "o_orderdate"), "decade", ["o_orderdate", "o_orderkey"]).select("decade", "o_orderkey", "rank", "remainder")


@query("SELECT c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 1")
def q_histogram(t):
    return A.histogram(t.customer.select(F.col("c_mktsegment").alias("kind")), "kind")


@query("""
SELECT o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY 1""")
def q_upper_median(t):
    return t.orders.groupBy("o_custkey").agg(A.upper_median(F.collect_list("o_totalprice")).alias("median"))


# periods

def _periods_sql(target: int) -> str:
    return f"""
WITH RECURSIVE y AS (SELECT year, n, row_number() OVER (ORDER BY year) AS i FROM (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY 1)),
r AS (
  SELECT i, year, n, CAST(1 AS BIGINT) AS first_no, CASE WHEN n > {target} THEN CAST(ceil(n / {target}) AS BIGINT) ELSE 1 END AS last_no, CASE WHEN n > {target} THEN 0 ELSE n END AS held FROM y WHERE i = 1
  UNION ALL
  SELECT y.i, y.year, y.n,
    CASE WHEN y.n > {target} OR r.held = 0 OR r.held + y.n > {target} THEN r.last_no + 1 ELSE r.last_no END,
    CASE WHEN y.n > {target} THEN r.last_no + CAST(ceil(y.n / {target}) AS BIGINT) WHEN r.held = 0 OR r.held + y.n > {target} THEN r.last_no + 1 ELSE r.last_no END,
    CASE WHEN y.n > {target} THEN 0 WHEN r.held = 0 OR r.held + y.n > {target} THEN y.n ELSE r.held + y.n END
  FROM r JOIN y ON y.i = r.i + 1),
p AS (SELECT year(o_orderdate) AS year, o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
placed AS (SELECT p.*, CAST(CASE WHEN r.n > {target} THEN r.first_no + (rn - 1) // {target} ELSE r.first_no END AS INT) AS period_no FROM p JOIN r USING (year))"""


def _periods(t, target: int) -> DataFrame:
    return W.bucket_periods(t.orders, F.year("o_orderdate"), ["o_orderdate", "o_orderkey"], target)


@query(_periods_sql(5000) + " SELECT period_no, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM placed GROUP BY 1")
def q_periods(t):
    return W.period_summary(_periods(t, 5000), F.year("o_orderdate"))


@query(_periods_sql(1500) + " SELECT period_no, min(year) AS first_year, max(year) AS last_year, count(*) AS n FROM placed GROUP BY 1")
def q_periods_split(t):
    return W.period_summary(_periods(t, 1500), F.year("o_orderdate"))


@query(_periods_sql(5000) + """, c AS (SELECT period_no, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM placed GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY period_no ORDER BY n DESC, f) AS rn, sum(n) OVER (PARTITION BY period_no) AS total FROM c)
SELECT period_no, CAST(total AS BIGINT) AS total, CASE WHEN n >= 2 AND n * 5 >= total THEN o_orderpriority END AS hook FROM b WHERE rn = 1""")
def q_period_hook(t):
    return A.dominant(_periods(t, 5000), "period_no", "o_orderpriority", "o_orderkey")


# dates

_REF = "DATE '1998-01-02'"


def _md(date: str, ref: str) -> str:
    """Signed distance of month and day from ref, in SQL."""
    this = f"TRY_CAST(lpad(CAST(year({ref}) AS VARCHAR), 4, '0') || substr({date}, 5, 6) AS DATE)"
    leap = f"(year({ref}) % 4 = 0 AND year({ref}) % 100 <> 0 OR year({ref}) % 400 = 0)"
    d = f"datediff('day', {ref}, {this})"
    return f"CAST(CASE WHEN {d} > 183 THEN {d} - CASE WHEN {leap} THEN 366 ELSE 365 END WHEN {d} < -183 THEN {d} + CASE WHEN {leap} THEN 366 ELSE 365 END ELSE {d} END AS INT)"


@query(f"""
WITH o AS (SELECT o_orderkey, c_nationkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, {_md('date', _REF)} AS distance FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(distance), date, o_orderkey) AS rn FROM m WHERE abs(distance) <= 4)
SELECT c_nationkey, o_orderkey, distance, CAST(1998 - CAST(substr(date, 1, 4) AS INT) AS INT) AS years FROM w WHERE rn = 1 AND 1998 - CAST(substr(date, 1, 4) AS INT) >= 1""")
def q_moment(t):
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey", _day("o_orderdate").alias("date"), F.lit("exact").alias("precision"))
    won = W.today_moment(orders, F.lit("1998-01-02").cast("date"), F.col("date"), F.col("precision"), ["c_nationkey"], ["date", "o_orderkey"])
    return won.select("c_nationkey", "o_orderkey", "distance", "years")


@query(f"""
WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE month(o_orderdate) = 2 AND day(o_orderdate) = 29)
SELECT o_orderkey, {_md('date', "DATE '2026-01-01'")} AS common_year, {_md('date', "DATE '2028-02-27'")} AS leap_year FROM o""")
def q_monthday_leap(t):
    days = t.orders.where("month(o_orderdate) = 2 and day(o_orderdate) = 29").select("o_orderkey", _day("o_orderdate").alias("date"), F.lit("exact").alias("p"))
    at = lambda d: D.month_day_distance("date", "p", F.lit(d).cast("date"))
    return days.select("o_orderkey", at("2026-01-01").alias("common_year"), at("2028-02-27").alias("leap_year"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, least(o_orderdate, l_shipdate) AS b, greatest(o_orderdate, l_shipdate) AS d, l_orderkey % 2 = 0 AS exact
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber,
  CAST(CASE WHEN exact THEN year(d) - year(b) - CASE WHEN (month(d), day(d)) >= (month(b), day(b)) THEN 0 ELSE 1 END END AS INT) AS exact,
  CAST(CASE WHEN exact THEN year(d) - year(b) - CASE WHEN (month(d), day(d)) >= (month(b), day(b)) THEN 0 ELSE 1 END ELSE year(d) - year(b) - 1 END AS INT) AS low,
  CAST(CASE WHEN exact THEN year(d) - year(b) - CASE WHEN (month(d), day(d)) >= (month(b), day(b)) THEN 0 ELSE 1 END ELSE year(d) - year(b) END AS INT) AS high FROM p""")
def q_ages(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate").join(t.orders.select("o_orderkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    precision = F.when(F.col("l_orderkey") % 2 == 0, "exact").otherwise("year")
    cut = lambda d: F.when(precision == "exact", d).otherwise(F.substring(d, 1, 4))
    rows = rows.withColumns({"b": F.date_format(F.least("o_orderdate", "l_shipdate"), "yyyy-MM-dd"), "d": F.date_format(F.greatest("o_orderdate", "l_shipdate"), "yyyy-MM-dd")})
    age = D.age_in_years(cut(F.col("b")), precision, cut(F.col("d")), precision)
    return rows.select("l_orderkey", "l_linenumber", age["exact"].alias("exact"), age["from"].alias("low"), age["to"].alias("high"))


_MONTH_SQL = "['" + "', '".join(D.MONTHS) + "'][month(o_orderdate)]"


@query(f"""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(day(o_orderdate) AS VARCHAR) || ' ' || substr({_MONTH_SQL}, 1, 3) || ' ' || year(o_orderdate)
  WHEN 1 THEN {_MONTH_SQL} || ' ' || year(o_orderdate) ELSE 'circa ' || year(o_orderdate) END AS label,
  CASE o_orderkey % 3 WHEN 0 THEN CAST(day(o_orderdate) AS VARCHAR) || ' ' || upper(substr({_MONTH_SQL}, 1, 3)) || ' ' || year(o_orderdate)
  WHEN 1 THEN upper(substr({_MONTH_SQL}, 1, 3)) || ' ' || year(o_orderdate) ELSE 'ABT ' || year(o_orderdate) END AS gedcom FROM orders""")
def q_date_labels(t):
    k = F.col("o_orderkey") % 3
    date = F.substring(_day("o_orderdate"), F.lit(1), F.when(k == 0, 10).when(k == 1, 7).otherwise(4))
    rows = t.orders.select("o_orderkey", date.alias("date"), F.when(k == 0, "exact").when(k == 1, "month").otherwise("approx").alias("p"))
    return rows.select("o_orderkey", D.date_label("date", "p").alias("label"), D.gedcom_date("date", "p").alias("gedcom"))


_DATES = ("1963", "1963-05", "1963-13", "1963-05-14", "2026-02-31", "2026-99", "1900-02-29", "2000-02-29", "63", "", "abcd", "1963-5-1")


@query(f"""
SELECT d AS date, CASE WHEN regexp_full_match(d, '[0-9]{{4}}') THEN true WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}') THEN CAST(substr(d, 6, 2) AS INT) BETWEEN 1 AND 12
  WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(d AS DATE) IS NOT NULL ELSE false END AS viable
FROM (SELECT unnest([{', '.join(repr(d) for d in _DATES)}]) AS d)""")
def q_viable_dates(t):
    rows = t.spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in _DATES])).alias("date"))
    return rows.select("date", D.viable_date("date").alias("viable"))


@query("""
WITH f AS (SELECT c_nationkey, min(strftime(o_orderdate, '%Y-%m-%d')) AS born FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1999-01' ELSE greatest(strftime(o_orderdate, '%Y-%m-%d'), born) END AS date
FROM orders JOIN customer ON c_custkey = o_custkey JOIN f USING (c_nationkey)""")
def q_refdate(t):
    placed = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).withColumn("date", _day("o_orderdate"))
    born = placed.where("o_orderpriority = '1-URGENT'").groupBy("c_nationkey").agg(F.min("date").alias("born"))
    return placed.join(born, "c_nationkey").select("o_orderkey", D.ref_date(F.when(F.col("o_orderstatus") == "F", "1999-01"), "date", "born").alias("date"))


# links

@query("""
WITH p AS (SELECT p_partkey, p_brand, p_type, p_size FROM part),
j AS (SELECT x.p_partkey, y.p_partkey AS near, abs(x.p_size - y.p_size) AS distance FROM p x JOIN p y ON x.p_partkey <> y.p_partkey
  AND (x.p_brand = y.p_brand OR x.p_type = y.p_type OR abs(x.p_size - y.p_size) <= 1))
SELECT p_partkey, near, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY distance, near) AS rank FROM j) WHERE rank <= 6""")
def q_nearby(t):
    return J.nearby(t.part.select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey", ["p_brand", "p_type"], "p_size", 1, ["p_partkey"], 6)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem x WHERE EXISTS (
  SELECT 1 FROM (SELECT l_partkey AS p FROM lineitem WHERE l_quantity >= 50) y WHERE y.p = x.l_partkey)""")
def q_backlinks(t):
    return J.referenced_by(t.lineitem, t.lineitem.where("l_quantity >= 50").select("l_partkey").distinct(), "l_partkey", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT 'unlabelled' AS rule, CAST(doc_id AS VARCHAR) AS target FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_dangling(t):
    return J.dangling(t.documents, "doc_id", t.labels, "doc_id", "unlabelled")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def q_unlinked(t):
    return J.unlinked(t.customer, "c_custkey", t.orders.where("o_orderstatus = 'P'"), "o_custkey").select("c_custkey", "c_name")


@query("SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def q_resolve_names(t):
    return J.resolve_names(t.supplier.select("s_suppkey", "s_nationkey"), "s_nationkey", t.nation, "n_nationkey", "n_name").select("s_suppkey", "name")


# order

@query("""
WITH f AS (SELECT conv_id, turn, role, role = 'user' AS s, role = 'assistant' AS e FROM conversations),
o AS (SELECT *, CASE WHEN s OR coalesce(lag(e) OVER (PARTITION BY conv_id ORDER BY turn), true) THEN 1 ELSE 0 END AS opens FROM f),
d AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS doc_no FROM o)
SELECT conv_id, doc_no, count(*) AS pages, NOT arg_max(e, turn) AS open FROM d GROUP BY 1, 2""")
def q_group_docs(t):
    pages = t.conversations.select("conv_id", "turn", (F.col("role") == "user").alias("starts"), (F.col("role") == "assistant").alias("ends"))
    return W.documents(pages, ["conv_id"], "turn", "starts", "ends")


@query("""
SELECT conv_id, turn, CAST(1 + coalesce(sum(CASE WHEN role = 'assistant' AND turn >= 3 THEN 1 ELSE 0 END) OVER (
  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS attempt_no FROM conversations""")
def q_sessions(t):
    events = t.conversations.withColumn("last", (F.col("role") == "assistant") & (F.col("turn") >= 3))
    return W.attempts(events, ["conv_id"], "turn", "last").select("conv_id", "turn", "attempt_no")


@query("""
WITH y AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 % 100000 AS y FROM events),
g AS (SELECT *, least(200, greatest(20, coalesce(lead(y) OVER (PARTITION BY user_id ORDER BY y, event_id) - y, 60))) AS height FROM y)
SELECT event_id, user_id, CAST(height AS BIGINT) AS height, CAST(trunc(y - CAST(0.6 AS DOUBLE) * height) AS INT) AS top, CAST(trunc(y + CAST(0.4 AS DOUBLE) * height) AS INT) AS bottom FROM g""")
def q_line_boxes(t):
    lines = t.events.select("user_id", "event_id", (F.unix_timestamp(F.col("ts").cast("timestamp")) % 100000).alias("y"))
    return W.line_boxes(lines, ["user_id"], "y", "event_id").select("event_id", "user_id", F.col("height").cast("long").alias("height"), "top", "bottom")


@query("""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT conv_id, k, turn, answer FROM u JOIN a USING (conv_id, k)""")
def q_positional(t):
    user = t.conversations.where("role = 'user'").select("conv_id", "turn")
    answer = t.conversations.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answer"))
    return W.positional(user, answer, ["conv_id"], "turn", ["answer"]).select("conv_id", "k", "turn", "answer")


@query("""
WITH f AS (SELECT user_id, event_id FROM events WHERE value > 100)
SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n_flagged,
  coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), min(event_id) OVER (PARTITION BY user_id)) AS next_flagged FROM f""")
def q_flags(t):
    from tidewrack.operators.visibility import flagged
    return flagged(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 100).select("user_id", "event_id", "n_flagged", "next_flagged")


# text

@query("SELECT doc_id, source FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'worthless')")
def q_search(t):
    return X.search(t.documents, "worthless", ["text", "source"]).select("doc_id", "source")


@query("""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents),
h AS (SELECT doc_id, s, list_filter(s, lambda x: contains(lower(x), 'with') OR contains(lower(x), 'que')) AS h FROM s)
SELECT doc_id, array_to_string(list_transform((CASE WHEN len(h) > 0 THEN h ELSE s END)[1:3], lambda x: substr(x, 1, 300)), ' / ') AS quotes FROM h""")
def q_quotes(t):
    return t.documents.select("doc_id", F.array_join(X.relevant_sentences(F.col("text"), ["with", "que"]), " / ").alias("quotes"))


_ALIASES = ("that", "with", "this", "from")


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b({'|'.join(_ALIASES)})\\b')) AS n FROM documents WHERE len(regexp_extract_all(text, '(?i)\\b({'|'.join(_ALIASES)})\\b')) > 0""")
def q_mentions(t):
    people = t.spark.createDataFrame([(a, [a], True) for a in _ALIASES], "id string, aliases array<string>, fold boolean")
    # \\b of the oracle counts ASCII word characters, as the operator does
    return X.match_entities(t.documents, "doc_id", "text", people).select("doc_id", F.size("matches").cast("long").alias("n"))


@query()
def q_mentions_longest(t):
    people = t.spark.createDataFrame([("the-of", ["the of", "the"], True), ("of", ["of the", "of"], True), ("Is", ["Is"], False)], "id string, aliases array<string>, fold boolean")
    found = X.match_entities(t.documents, "doc_id", "text", people)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.start", "m.end", "m.id", "m.text")


@query("""
WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, line, list_distinct(list_filter(string_split(line, ' '), lambda x: x <> '')) AS w FROM l),
b AS (SELECT item_id, list_distinct(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS b FROM benchmark),
j AS (SELECT doc_id, line, item_id, len(list_intersect(w, b)) AS k, len(w) + len(b) - len(list_intersect(w, b)) AS u FROM w, b WHERE len(w) * 3 >= len(b))
SELECT doc_id, item_id, round(max(k / u), 6) AS score FROM j WHERE 50 * k >= 17 * u GROUP BY 1, 2""")
def q_jaccard(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct().select("doc_id", F.array_distinct(X.line_words(F.col("line"))).alias("w"))
    items = t.benchmark.select("item_id", F.array_distinct(X.line_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("b"))
    # a shared word is necessary: candidates come from an equi-join on words, counted by pair
    lines = lines.withColumn("line_no", F.xxhash64("doc_id", "w"))
    shared = lines.select("doc_id", "line_no", F.size("w").alias("nw"), F.explode("w").alias("x")).join(items.select("item_id", F.size("b").alias("nb"), F.explode("b").alias("x")), "x")
    k = shared.groupBy("doc_id", "line_no", "item_id", "nw", "nb").agg(F.count(F.lit(1)).alias("k")).where("nw * 3 >= nb")
    u = F.col("nw") + F.col("nb") - F.col("k")
    near = k.where(50 * F.col("k") >= 17 * u).select("line_no", "item_id").join(lines, "line_no").join(items, "item_id")  # few lines are left
    return near.groupBy("doc_id", "item_id").agg(F.round(F.max(X.jaccard(F.col("w"), F.col("b"))), 6).alias("score"))


@query()
def q_associate(t):
    from tidewrack.operators.alignment import associate_lines
    lines = t.documents.where("doc_id is not null").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    boxes = lines.select("page", F.col("text"), (F.col("index") * 40 % 97).cast("double").alias("y"))
    return associate_lines(lines, boxes, "page")


@query("SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+')) AS marker FROM documents")
def q_markers(t):
    return t.documents.select("doc_id", F.explode(X.emails(F.col("text"))).alias("marker")).distinct()


@query("""
SELECT doc_id, len(list_distinct(list_filter(string_split(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))) AS words FROM documents""")
def q_normalize(t):
    return t.documents.select("doc_id", F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(X.normalize("text"), "[^a-z0-9]+", " "), " "), lambda w: w != ""))).cast("long").alias("words"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def q_transcripts(t):
    return X.joined(t.conversations, ["conv_id"], "turn", F.concat_ws(": ", "role", "text"), "\n\n")


@query("SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE CASE WHEN contains(substr(text, 1, 140), ' ') AND 140 - instr(reverse(substr(text, 1, 140)), ' ') > 60 THEN substr(text, 1, 140 - instr(reverse(substr(text, 1, 140)), ' ')) ELSE substr(text, 1, 140) END || '…' END AS preview FROM documents")
def q_previews(t):
    return t.documents.select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("""
WITH s AS (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer)
SELECT c_custkey, slug FROM s""")
def q_slugs(t):
    return t.customer.select("c_custkey", X.slug(F.col("c_name")).alias("slug"))


# resolution, graph, json, streams

@query("""
WITH s AS (SELECT s_suppkey AS id, lower(trim('Customer#' || lpad(CAST(s_suppkey * 70 % 3000 AS VARCHAR), 9, '0'))) AS k, 'Customer#' || lpad(CAST(s_suppkey * 70 % 3000 AS VARCHAR), 9, '0') AS name FROM supplier),
f AS (SELECT * FROM s WHERE k NOT IN (SELECT lower(trim(c_name)) FROM customer) AND 1000000 + id NOT IN (SELECT c_custkey FROM customer))
SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1000000 + min(id), arg_min(name, id) FROM f GROUP BY k""")
def q_merge_proposed(t):
    table = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    staged = t.supplier.select((F.col("s_suppkey") + 1000000).alias("id"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") * 70 % 3000).cast("string"), 9, "0")).alias("name"), F.col("s_suppkey").alias("path"))
    return M.merge_by_name(table, staged, "id", "name", "path").select("id", "name")


_TRADE = """WITH e AS (SELECT DISTINCT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey)"""


def _trade(t) -> DataFrame:
    ends = t.lineitem.select("l_orderkey", "l_suppkey").join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).join(
        t.supplier.select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    return ends.where("c_nationkey <> s_nationkey").select(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).distinct()


@query(_TRADE + " SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1")
def q_degree(t):
    return A.degrees(_trade(t))


@query(_TRADE + ", d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT 1")
def q_family(t):
    return A.focus(A.degrees(_trade(t)))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS source, a AS node, 0 AS hops FROM u WHERE a = (SELECT min(a) FROM e) UNION SELECT source, b, hops + 1 FROM r JOIN u ON u.a = r.node WHERE hops < 12)
SELECT source, node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1, 2""")
def q_path_len(t):
    edges = t.lineitem.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
    return R.hops(edges, edges.agg(F.min("a").alias("id")))


@query(_LATEST)
def q_stream_state(t):
    from tidewrack.streaming.state import current_from_stream
    return current_from_stream(t.spark, f"{t.folder}/events.parquet", ["user_id"], ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "event_type", "value")


@query("""
WITH r AS (SELECT doc_id, label, rank FROM (SELECT documents.doc_id, 'quality' AS label, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, documents.doc_id) AS rank FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE rank <= 5)
SELECT doc_id, label, rank FROM r""")
def q_top_labelled(t):
    good = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id").select("doc_id", "lang", "n_chars")
    return A.top_counts(good, ["lang"], 5, "n_chars", ("doc_id",)).select("doc_id", F.lit("quality").alias("label"), "rank")


# more bindings: registers, queues, drafts, forms

@query("""
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) - count(*) FILTER (WHERE o_orderstatus = 'P') AS already FROM o""")
def q_review_queue(t):
    from tidewrack.operators.visibility import review_queue
    return review_queue(t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "P", "proposed").otherwise("confirmed")))


@query("""
SELECT CASE WHEN user_id % 2 = 0 THEN 'told' ELSE 'about' END AS section, count(*) AS n FROM events WHERE user_id % 2 = 0 OR event_type = 'purchase' GROUP BY 1""")
def q_sections(t):
    from tidewrack.operators.visibility import told_and_mentioned
    items = t.events.select(F.when(F.col("user_id") % 2 == 0, "me").otherwise("other").alias("told_by"), F.array(F.struct(F.when(F.col("event_type") == "purchase", "me").otherwise("x").alias("id"))).alias("people"))
    return told_and_mentioned(items, "me").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') ORDER BY p_partkey LIMIT 8""")
def q_autocomplete(t):
    from tidewrack.operators.visibility import autocomplete
    named = t.part.select("p_partkey", "p_name", F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.col("p_partkey").alias("pos"))
    return autocomplete(named, "E").select("p_partkey", "p_name")


@query("SELECT coalesce(min(o_orderkey) FILTER (WHERE o_orderkey > 500), min(o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def q_next_open(t):
    from tidewrack.operators.visibility import next_after
    return next_after(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", 500)


@query("""
SELECT conv_id, turn, floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) / 5)::INT AS chunk, CASE WHEN length(text) >= 200 THEN 'print' ELSE 'handwriting' END AS route FROM conversations""")
def q_chunks(t):
    from tidewrack.plans.ingest import chunked, routes
    pages = t.conversations.withColumn("n", F.length("text"))
    return routes(chunked(pages, "conv_id", "turn"), "n").select("conv_id", "turn", "chunk", "route")


@query("""
SELECT c_custkey, upper(substr(c_name, 1, 1)) AS initials FROM customer""")
def q_initials(t):
    return t.customer.select("c_custkey", X.initials(F.col("c_name")).alias("initials"))


@query("""
SELECT c_custkey, CAST(list_sum(list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda x: ascii(x))) % 6 AS VARCHAR) AS hue FROM customer""")
def q_hue(t):
    return t.customer.select("c_custkey", X.hue(F.col("c_custkey").cast("string"), F.lit(None).cast("string")).alias("hue"))


@query("""
SELECT doc_id, coalesce(substr(trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1]), 1, 48), source) AS title FROM documents""")
def q_doc_titles(t):
    return t.documents.select("doc_id", X.doc_title(F.lit(None).cast("string"), F.col("text"), F.col("source")).alias("title"))


@query("""
WITH v AS (SELECT o_orderkey AS record_id, o_totalprice > 0 AS price, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS priority, o_orderstatus <> 'P' AS status FROM orders)
SELECT 'priority' AS rule, CAST(record_id AS VARCHAR) AS record_id FROM v WHERE NOT priority UNION ALL SELECT 'status', CAST(record_id AS VARCHAR) FROM v WHERE NOT status
UNION ALL SELECT 'price', CAST(record_id AS VARCHAR) FROM v WHERE NOT price""")
def q_violations(t):
    from tidewrack.operators.rules import violations
    return violations(t.orders, "o_orderkey", {"price": F.col("o_totalprice") > 0, "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
                                               "status": F.col("o_orderstatus") != "P"}).select("rule", "record_id")


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('purchase', 'error')) WHERE rn = 1""")
def q_first_decision(t):
    events = t.events.select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "reject").otherwise("propose").alias("decision"))
    return M.changed_decisions(events, "user_id", "at").select("user_id", "event_id", "event_type")


@query("""
SELECT p_partkey, [100.0 - p_size * 2, CAST(p_size AS DOUBLE), 100.0 - p_size, p_size * 3.0] AS box FROM part""")
def q_rotated_boxes(t):
    from tidewrack.operators.alignment import rotate_box
    rows = t.part.select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_size").cast("double"), (F.col("p_size") * 3).cast("double"), (F.col("p_size") * 2).cast("double")).alias("b"))
    return rows.select("p_partkey", rotate_box(F.col("b"), F.lit(200.0), F.lit(100.0), F.lit(1)).alias("box"))


@query("""
WITH j AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS response FROM conversations)
SELECT conv_id * 100 + turn AS id, conv_id * 100 + response AS response FROM j WHERE response IS NOT NULL""")
def q_responses(t):
    items = t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100 + F.col("turn") - 1).alias("comment_on"))
    return J.responses(items)


@query("""
SELECT user_id, min(ts) AS first, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, s""")
def q_event_sessions(t):
    from tidewrack.streaming.state import sessions
    return sessions(t.events, "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("first"), "n")
