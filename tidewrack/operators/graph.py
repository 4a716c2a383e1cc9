"""The relationship graph: family, degrees, shortest paths, the circle around a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.dates import age_label
from tidewrack.operators.links import marriages
from tidewrack.schemas import FAMILY_KINDS, POINT_PRECISIONS
from tidewrack.shared import checkpoints


def family_edges(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Undirected (a, b) of family links, both ways, without proposed people."""
    own = edges.where(F.col("kind").isin(*FAMILY_KINDS)).select("a", "b")
    both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    proposed = people.where("status = 'proposed'").select("id")
    return both.join(proposed.withColumnRenamed("id", "a"), "a", "left_anti").join(proposed.withColumnRenamed("id", "b"), "b", "left_anti")


def family_ids(edges: DataFrame, people: DataFrame) -> DataFrame:
    return family_edges(edges, people).select(F.col("a").alias("id")).distinct()


def hops(edges: DataFrame, sources: DataFrame, most: int | None = None, parents: bool = False) -> DataFrame:
    """(source, node, hops) and, if wanted, the neighbour nearer to the source: breadth-first
    search from each source (column ``id``) over undirected edges (a, b), as deep as ``most``
    where it is given.

    One join per level on the frontier alone; visited nodes leave by anti-join, and the state
    of each level is cut from its lineage by a checkpoint. It ends when no node is new. Of
    several neighbours the smallest is taken.
    """
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    start = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).alias("hops"), F.lit(None).cast(dict(both.dtypes)["a"]).alias("parent"))
    seen = frontier = before = start.checkpoint()
    level = 0
    while most is None or level < most:
        level += 1
        new = frontier.select("source", F.col("node").alias("a")).join(both, "a").groupBy("source", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        # over undirected edges a neighbour lies on the level before, on this one or on the next
        known = frontier.select("source", "node").unionByName(before.select("source", "node"))
        before, frontier = frontier, new.join(known, ["source", "node"], "left_anti").select("source", "node", F.lit(level).alias("hops"), "parent").checkpoint()
        if not frontier.head(1):
            break
        seen = seen.unionByName(frontier)
    return seen if parents else seen.drop("parent")


def path_to(edges: DataFrame, start, end, most: int | None = None) -> list | None:
    """The nodes of a shortest path, or None if there is none or both ends are one. Each step
    reads one row back from the search, at most ``most`` of them where it is given."""
    spark = edges.sparkSession
    if start == end:
        return None
    found = hops(edges, spark.createDataFrame([(start,)], ["id"]), most, parents=True)
    table = found.where("parent is not null").select("node", "parent")
    path = [end]
    while path[-1] != start:
        row = table.where(F.col("node") == path[-1]).head(1)
        if not row:
            return None
        path.append(row[0].parent)
    return path[::-1]


def path_bar(path: Column, most: int = 5) -> Column:
    """A long path as first, …, last two."""
    short = F.concat(F.slice(path, 1, 1), F.array(F.lit("…")), F.slice(path, -2, 2))
    return F.when(F.size(path) - 1 > most, short).otherwise(path)


def ego(edges: DataFrame, person) -> DataFrame:
    """(id, role) of a person's parents, children, partners, siblings (told, or by a shared
    parent) and wider family, each once in the closest role, and their number of links that
    the circle does not show."""
    def side(kind: str, mine: str, other: str, role: str) -> DataFrame:
        return edges.where((F.col("kind") == kind) & (F.col(mine) == person)).select(F.col(other).alias("id"), F.lit(role).alias("role"))
    parents, children = side("parent", "b", "a", "1 parent"), side("parent", "a", "b", "2 child")
    circle = parents.unionByName(children)
    for kind, role in (("spouse", "3 partner"), ("sibling", "4 sibling"), ("inlaw", "5 wider")):
        circle = circle.unionByName(side(kind, "a", "b", role)).unionByName(side(kind, "b", "a", role))
    shared = edges.where("kind = 'parent'").join(parents.select(F.col("id").alias("a")), "a", "left_semi").where(F.col("b") != person)
    circle = circle.unionByName(shared.select(F.col("b").alias("id"), F.lit("4 sibling").alias("role")))
    best = circle.groupBy("id").agg(F.substring(F.min("role"), 3, 20).alias("role"))
    family = edges.where(F.col("kind").isin(*FAMILY_KINDS))
    links = family.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(family.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    shown = best.select(F.col("id").alias("other")).unionByName(edges.sparkSession.createDataFrame([(person,)], "other string"))
    unseen = links.join(best.select("id"), "id", "left_semi").join(shown, "other", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("unseen"))
    return best.join(unseen, "id", "left").withColumn("unseen", F.coalesce("unseen", F.lit(0).cast("long")))


def life_events(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, date, person, other, ages): births and deaths of people who are not proposed,
    placed to a point, and dated marriages."""
    own = people.where("coalesce(status, 'confirmed') <> 'proposed'")
    parts = None
    for kind, field in (("birth", "dob"), ("death", "dod")):
        one = own.where(F.col(f"{field}.precision").isin(*POINT_PRECISIONS) & F.col(f"{field}.date").isNotNull()).select(
            F.lit(kind).alias("kind"), F.col(f"{field}.date").alias("date"), F.col("id").alias("person"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("string").alias("ages"))
        parts = one if parts is None else parts.unionByName(one)
    wed = marriages(edges, own).select(F.lit("marriage").alias("kind"), F.col("date.date").alias("date"), F.col("a").alias("person"), F.col("b").alias("other"), F.when(
        F.col("age_a").isNotNull() & F.col("age_b").isNotNull(), F.concat_ws(" and ", age_label(F.col("age_a")), age_label(F.col("age_b")))).alias("ages"))
    return parts.unionByName(wed)


def person_detail(people: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, detail): the name of a spouse - dated first, unknown ones skipped - else the first
    occupation, else the first alias."""
    both = edges.where("kind = 'spouse'").select(F.col("a").alias("id"), F.col("b").alias("other"), "date.date").unionByName(
        edges.where("kind = 'spouse'").select(F.col("b").alias("id"), F.col("a").alias("other"), "date.date"))
    named = both.join(people.select(F.col("id").alias("other"), F.col("name").alias("spouse")), "other").where(~F.startswith("spouse", F.lit("?")))
    best = named.groupBy("id").agg(F.min_by("spouse", F.struct(F.col("date").isNull().alias("undated"), "date", "other")).alias("spouse"))
    return people.join(best, "id", "left").select("id", F.coalesce("spouse", F.try_element_at("occupations", F.lit(1)), F.try_element_at("aliases", F.lit(1))).alias("detail"))


def relation_label(person) -> Column:
    """An edge seen from one side: the other's label, else the kind."""
    return F.coalesce(F.nullif(F.when(F.col("a") == person, F.col("label_b")).otherwise(F.col("label_a")), F.lit("")), F.col("kind"))
