"""From raw versions to the published tables: bronze, silver, a gate, gold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import rules
from tidewrack.operators.links import edge_endpoints, integrity
from tidewrack.operators.resolve import merge_by_name, merge_people
from tidewrack.operators.versions import current, version_gaps
from tidewrack.operators.visibility import catalogued


@dataclass(frozen=True)
class Silver:
    """Current, typed records."""

    items: DataFrame
    people: DataFrame
    relationships: DataFrame
    places: DataFrame
    themes: DataFrame
    orgs: DataFrame


def resolved_items(versions: DataFrame, content: DataFrame) -> DataFrame:
    """The current items (id, version, fields) with their long texts embedded: the latest
    version of each text, empty for types that carry one. Content assets and the chain of
    versions do not show."""
    now = current(versions, ["id"], ["version"], F.col("status") == "deleted").drop("version")
    texts = content.groupBy("item_id", "kind").agg(F.max_by("text", "version").alias("text")).groupBy("item_id").pivot("kind", ["story", "transcription"]).agg(F.first("text"))
    carries = {"story": F.col("type") == "story", "transcription": F.col("type").isin("story", "letter", "document")}
    own = now.drop("story", "transcription").join(texts.withColumnRenamed("item_id", "id"), "id", "left")
    own = own.withColumns({k: F.when(ok, F.coalesce(k, F.lit(""))).otherwise(F.col(k)) for k, ok in carries.items()})
    return own.withColumn("assets", F.filter("assets", lambda a: ~a["kind"].isin("story", "transcription"))).select(*now.columns)


def missing_content(versions: DataFrame, content: DataFrame) -> DataFrame:
    """Violations: a content asset whose file does not exist."""
    now = current(versions, ["id"], ["version"], F.col("status") == "deleted")
    said = now.select(F.col("id").alias("item_id"), F.explode("assets").alias("a")).where(F.col("a.kind").isin("story", "transcription")).select("item_id", F.col("a.file").alias("file"))
    return said.join(content, ["item_id", "file"], "left_anti").select(F.lit("content-missing").alias("rule"), F.col("item_id").alias("record_id"), F.col("file").alias("detail"))


def silver(versions: DataFrame, content: DataFrame, people: DataFrame, relationships: DataFrame, places: DataFrame, themes: DataFrame, orgs: DataFrame,
           proposed_people: DataFrame | None = None, proposed_places: DataFrame | None = None) -> Silver:
    if proposed_people is not None:
        people = merge_people(people, proposed_people)
    if proposed_places is not None:
        places = merge_by_name(places, proposed_places, "id", "name", "path")
    return Silver(resolved_items(versions, content), people, relationships, places, themes, orgs)


def faults(s: Silver, versions: DataFrame | None = None) -> DataFrame:
    """All violations (rule, record_id, detail) of the silver tables."""
    found = rules.violations(s.items, "id", rules.item_rules()).unionByName(rules.violations(s.people, "id", rules.person_rules())).unionByName(
        rules.violations(s.places, "id", rules.place_rules())).unionByName(rules.violations(s.relationships, "a", rules.relationship_rules()))
    links = integrity(s.items, s.people, s.places, s.themes, s.orgs).unionByName(edge_endpoints(s.relationships, s.people))
    found = found.unionByName(links.select("rule", F.col("id").alias("record_id"), F.col("target").alias("detail")))
    if versions is not None:
        gaps = version_gaps(versions, ["id"], "version")
        found = found.unionByName(gaps.select(F.lit("version-gap").alias("rule"), F.col("id").alias("record_id"), F.concat_ws("-", "low", "high").alias("detail")))
    return found


def gold(s: Silver) -> dict[str, DataFrame]:
    """The published tables."""
    items = s.items.withColumn("chat", F.when(F.size("chat.extractions") > 0, F.col("chat")))
    return {"items": items, "people": s.people, "relationships": s.relationships, "places": s.places, "themes": s.themes, "orgs": s.orgs,
            "transcripts": s.items.where("coalesce(transcription, '') <> ''").select("id", F.col("transcription").alias("text")),
            "index": catalogued(s.items).select("id", "type", "title", "date", "status").orderBy("date", "id")}


def _pointer(spark: SparkSession, where: str) -> int:
    """Number of the latest complete pointer, 0 where there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/current")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [f.getPath() for f in fs.listStatus(root)]
    done = [int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(done, default=0)


def current_tables(spark: SparkSession, where: str) -> dict[str, str]:
    """Table to the publication that holds it, as the latest pointer says."""
    n = _pointer(spark, where)
    return {r.table: r.name for r in spark.read.schema("table string, name string").json(f"{where}/current/{n:09d}").collect()} if n else {}  # a row per table


def _write(spark: SparkSession, where: str, name: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """Write tables under a new name, then a new pointer to them and to those that did not change.
    A pointer counts once it is complete, so readers see one publication or the next."""
    paths = {}
    for table, df in tables.items():
        paths[table] = f"{where}/{name}/{table}"
        df.write.mode("errorifexists").parquet(paths[table])
    held = current_tables(spark, where) | dict.fromkeys(tables, name)
    spark.createDataFrame(sorted(held.items()), "table string, name string").coalesce(1).write.mode("errorifexists").json(f"{where}/current/{_pointer(spark, where) + 1:09d}")
    return paths


def publish(s: Silver, where: str, name: str, versions: DataFrame | None = None) -> dict[str, str]:
    """Check, write every gold table under a new name, then let the pointer name it."""
    rules.strict(faults(s, versions))
    return _write(s.items.sparkSession, where, name, gold(s))


def refresh(spark: SparkSession, where: str, name: str, stories: DataFrame | None = None, dropped: DataFrame | None = None,
            people: DataFrame | None = None, places: DataFrame | None = None) -> dict[str, str]:
    """Bring the current publication up to date without publishing all: ``stories`` replace or join the
    items by id, ``dropped`` ids leave, new people and places join. Only the tables that follow from
    them are written; a refresh that comes twice changes nothing more."""
    now = {t: spark.read.parquet(f"{where}/{n}/{t}") for t, n in current_tables(spark, where).items()}
    changed: dict[str, DataFrame] = {}
    for table, more in (("people", people), ("places", places)):
        if more is not None:
            changed[table] = now[table].unionByName(more.join(now[table].select("id"), "id", "left_anti").dropDuplicates(["id"]), allowMissingColumns=True).select(*now[table].columns)
    if stories is not None or dropped is not None:
        items = now["items"]
        for gone in (stories, dropped):
            if gone is not None:
                items = items.join(gone.select("id"), "id", "left_anti")
        if stories is not None:
            items = items.unionByName(stories, allowMissingColumns=True)
        made = gold(Silver(items.select(*now["items"].columns), now["people"], now["relationships"], now["places"], now["themes"], now["orgs"]))
        changed |= {t: made[t] for t in ("items", "transcripts", "index")}
    return _write(spark, where, name, changed)


def register_views(spark: SparkSession, where: str) -> str:
    """Temp views of the current publication; the name that holds its items."""
    names = current_tables(spark, where)
    for table, name in names.items():
        spark.read.parquet(f"{where}/{name}/{table}").createOrReplaceTempView(table)
    return names["items"]
