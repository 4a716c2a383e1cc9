"""Joins by reference: names, back-links, integrity, what lies near."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions.dates import age_in_years, year_of
from tidewrack.operators.visibility import catalogued, flag, has_ref, involves

REF_KINDS = ("people", "places", "themes", "orgs", "items")


def refs(items: DataFrame, kinds: tuple[str, ...] = REF_KINDS) -> DataFrame:
    """A row per reference: (item, kind, pos, target, status)."""
    parts = None
    for kind in kinds:
        one = items.select(F.col("id").alias("item"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "r")).select(
            "item", "kind", "pos", F.col("r.id").alias("target"), F.col("r.status").alias("status"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def resolve_names(rows: DataFrame, key: str, names: DataFrame, name_key: str = "id", name: str = "name") -> DataFrame:
    """``rows`` with the name of what ``key`` refers to, or the raw id."""
    dim = names.select(F.col(name_key).alias(key), F.col(name).alias("_name"))
    return rows.join(dim, key, "left").withColumn("name", F.coalesce("_name", F.col(key).cast("string"))).drop("_name")


def arrangement(themes: DataFrame, items: DataFrame) -> DataFrame:
    """Theme entries in their order, with their items; entries without item are left out."""
    entries = themes.select(F.col("id").alias("theme"), F.posexplode("items").alias("pos", "e")).select("theme", "pos", F.col("e.id").alias("id"), F.col("e.note").alias("note"))
    return entries.join(items, "id")


def referenced_by(links: DataFrame, targets: DataFrame, link_target: str, target: str) -> DataFrame:
    """Links whose target is among ``targets``."""
    return links.join(targets.select(F.col(target).alias(link_target)), link_target, "left_semi")


def responses(items: DataFrame) -> DataFrame:
    """(id, response): items that comment on another."""
    return items.select("id").join(items.where("comment_on is not null").select(F.col("comment_on").alias("id"), F.col("id").alias("response")), "id")


def back_links(items: DataFrame, target) -> DataFrame:
    """Items that refer to the target, but for itself, its comments and its fragments."""
    return items.where(has_ref(F.col("items"), target) & (F.col("id") != target) & ~F.coalesce(F.col("comment_on") == target, F.lit(False))
                       & ~flag("clarification") & ~flag("evidence"))


def _nearest(df: DataFrame, group: str | None, number: str, order: list[str], limit: int, reach: int | None) -> DataFrame:
    """(group, number, near, ...) for every value of ``group`` and ``number``: the ``limit`` + 1 rows of the group whose
    number is nearest, at most ``reach`` away, then by ``order``. Of the rows with equal group and number
    only the first ``limit`` + 1 can be among them, and only those of the ``limit`` + 1 next
    numbers to either side, so all of this is linear."""
    most = limit + 1
    g = F.lit(0) if group is None else F.col(group)
    rows = df.where(g.isNotNull() & F.col(number).isNotNull()).select(g.alias("_g"), F.col(number).alias("_v"), F.struct(*order).alias("_o"))
    heads = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_v").orderBy("_o"))).where(F.col("_r") <= most)
    runs = heads.groupBy("_g", "_v").agg(F.array_sort(F.collect_list("_o")).alias("_heads"))
    runs = runs.withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_v")))
    to = runs.select("_g", F.col("_v").alias("_to"), F.explode(F.sequence(F.col("_i") - most, F.col("_i") + most)).alias("_i"))
    met = to.join(runs, ["_g", "_i"]).withColumn("_d", F.abs(F.col("_to") - F.col("_v")))
    if reach is not None:
        met = met.where(F.col("_d") <= reach)
    each = met.select("_g", "_to", "_d", F.explode("_heads").alias("_o"))
    kept = each.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_to").orderBy("_d", "_o"))).where(F.col("_r") <= most)
    return kept.select("_g", F.col("_to").alias("_v"), "_d", "_o")


def nearby(df: DataFrame, key: str, shared: list[str], number: str, reach: int, order: list[str], limit: int, of: Column | None = None) -> DataFrame:
    """For each row of ``of`` the ``limit`` rows that share a value of one of the columns
    ``shared`` or differ by at most ``reach`` in ``number``: (key, near, distance, rank), nearest
    first, then by ``order``. Rows never meet all others of a value: each condition has its
    few nearest for every value and number, and a row takes the best of them. A row
    without a number has no distance and takes no part."""
    rows = df if of is None else df.where(of)
    keys = list(dict.fromkeys([*order, key]))
    found = None
    for c, most in [*((c, None) for c in shared), (None, reach)]:
        near = _nearest(df, c, number, keys, limit, most)
        g = F.lit(0) if c is None else F.col(c)
        one = rows.select(F.col(key).alias("_k"), g.alias("_g"), F.col(number).alias("_v")).join(near, ["_g", "_v"]).select("_k", "_d", "_o")
        found = one if found is None else found.unionByName(one)
    pairs = found.where(F.col("_k") != F.col(f"_o.{key}")).distinct()
    w = Window.partitionBy("_k").orderBy("_d", "_o")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.select(F.col("_k").alias(key), F.col(f"_o.{key}").alias("near"), F.col("_d").alias("distance"), "rank")


def unlinked(df: DataFrame, key: str, links: DataFrame, link_key: str) -> DataFrame:
    return df.join(links.select(F.col(link_key).alias(key)), key, "left_anti")


def dangling(links: DataFrame, key: str, dim: DataFrame, dim_key: str, rule: str) -> DataFrame:
    """Violations (rule, target) of links that resolve nowhere, one per link."""
    lost = links.where(F.col(key).isNotNull()).join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("target"))


def integrity(items: DataFrame, people: DataFrame, places: DataFrame, themes: DataFrame, orgs: DataFrame) -> DataFrame:
    """Violations (rule, id, target) of what catalogued items and themes refer to. References
    to items, comments, theme entries and kept extractions must meet catalogued items, unless
    the reference is itself only proposed."""
    shown = catalogued(items)
    tables = {"people": people, "places": places, "themes": themes, "orgs": orgs}
    found = None

    def add(rows: DataFrame) -> None:
        nonlocal found
        found = rows if found is None else found.unionByName(rows)
    for kind, dim in tables.items():
        add(refs(shown, (kind,)).join(dim.select(F.col("id").alias("target")), "target", "left_anti").select(F.lit(f"{kind}-ref").alias("rule"), F.col("item").alias("id"), "target"))
    live = shown.select(F.col("id").alias("target"))
    confirmed = refs(shown, ("items",)).where(F.coalesce("status", F.lit("confirmed")) != "proposed")
    add(confirmed.join(live, "target", "left_anti").select(F.lit("item-ref").alias("rule"), F.col("item").alias("id"), "target"))
    add(shown.where("comment_on is not null").select("id", F.col("comment_on").alias("target")).join(live, "target", "left_anti").select(F.lit("comment-on").alias("rule"), "id", "target"))
    said = shown.select("id", F.explode("chat.extractions").alias("x")).where("x.match is not null and x.kind = 'item' and coalesce(x.on, true)")
    add(said.select("id", F.col("x.match").alias("target")).join(live, "target", "left_anti").select(F.lit("extraction").alias("rule"), "id", "target"))
    entries = themes.select("id", F.explode("items").alias("e")).select("id", F.col("e.id").alias("target"))
    add(entries.join(live, "target", "left_anti").select(F.lit("theme-entry").alias("rule"), "id", "target"))
    return found


def edge_endpoints(edges: DataFrame, people: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("target"), F.concat_ws("/", "a", "b", "kind").alias("id"))
    return ends.join(people.select(F.col("id").alias("target")), "target", "left_anti").select(F.lit("edge-endpoint").alias("rule"), "id", "target")


def families(edges: DataFrame) -> DataFrame:
    """(family, parents, children): children grouped by their set of parents."""
    parents = edges.where("kind = 'parent'").groupBy(F.col("b").alias("child")).agg(F.array_sort(F.collect_set("a")).alias("parents"))
    return parents.groupBy("parents").agg(F.array_sort(F.collect_list("child")).alias("children")).withColumn("family", F.array_join("parents", "+"))


def estimate_basis(sessions: DataFrame) -> DataFrame:
    """(person_id, basis): the first decision that gives one, in order of session, attempt and place."""
    d = sessions.select(F.col("id").alias("session"), F.posexplode("attempts").alias("attempt", "a")).select(
        "session", "attempt", F.posexplode("a.decisions").alias("pos", "d")).where("d.basis is not null")
    return d.groupBy(F.col("d.person_id").alias("person_id")).agg(F.min_by("d.basis", F.struct("session", "attempt", "pos")).alias("basis"))


def marriages(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Dated marriages with both ages, null where a birth is unknown."""
    a = people.select(F.col("id").alias("a"), F.col("name").alias("name_a"), F.col("dob").alias("dob_a"))
    b = people.select(F.col("id").alias("b"), F.col("name").alias("name_b"), F.col("dob").alias("dob_b"))
    wed = edges.where("kind = 'spouse' and date.date is not null").join(a, "a").join(b, "b")

    def age(dob: str):
        return age_in_years(f"{dob}.date", f"{dob}.precision", "date.date", "date.precision")
    return wed.select("a", "b", "name_a", "name_b", "date", age("dob_a").alias("age_a"), age("dob_b").alias("age_b"))


def last_decisions(sessions: DataFrame, people: DataFrame) -> DataFrame:
    """The decisions of each session's latest attempt, with the person's name or id."""
    d = sessions.select("id", F.posexplode(F.try_element_at("attempts", F.lit(-1))["decisions"]).alias("pos", "d")).select("id", "pos", F.col("d.person_id").alias("person_id"), F.col("d.decision").alias("decision"))
    return resolve_names(d, "person_id", people)


def first_document(items: DataFrame, people: DataFrame) -> DataFrame:
    """(person, item, date): the earliest item that involves each person."""
    told = items.where("told_by is not null").select(F.col("told_by").alias("person"), "id", "date")
    named = items.select(F.explode("people.id").alias("person"), "id", "date")
    both = told.unionByName(named).join(people.select(F.col("id").alias("person")), "person", "left_semi")
    return both.groupBy("person").agg(F.min(F.struct("date", "id")).alias("x")).select("person", F.col("x.id").alias("item"), "x.date")


def theme_title(items: DataFrame, themes: DataFrame) -> DataFrame:
    """Items with the title of their first theme."""
    first = items.withColumn("theme", F.get("themes", 0)["id"])
    return first.join(themes.select(F.col("id").alias("theme"), F.col("title").alias("theme_title")), "theme", "left")


def extraction_refs(items: DataFrame, target, kind: str) -> DataFrame:
    """Catalogued items that hold a reference or a kept extraction of the target."""
    said = F.coalesce(F.exists("chat.extractions", lambda x: (x["match"] == target) & (F.coalesce(x["on"], F.lit(True)))), F.lit(False))
    return catalogued(items).where(has_ref(F.col(kind), target) | said)


def item_years(items: DataFrame) -> DataFrame:
    return items.withColumn("year", year_of("date"))


def person_items(items: DataFrame, person) -> DataFrame:
    return items.where(involves(person))
