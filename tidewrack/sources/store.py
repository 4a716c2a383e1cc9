"""The file store as tables: listing, whole and partial reads, create-only writes."""

from __future__ import annotations

import posixpath
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.schemas import schema


class PathError(ValueError):
    """A path that leaves its root."""


def inside(root: str, path: str) -> str:
    """``path`` under ``root``; one that would leave it is refused."""
    full = posixpath.normpath(posixpath.join(root, path))
    if path.startswith("/") or not (full + "/").startswith(posixpath.normpath(root) + "/"):
        raise PathError(path)
    return full


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of all files under ``root``, by path relative to it; an absent root has
    none. Contents are not read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    except Exception as e:  # only an absent folder is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length long")
    base = PurePosixPath(root.split(":", 1)[-1]).as_posix().rstrip("/") + "/"
    rows = files.select(F.substring_index("path", base, -1).alias("path"), "length")
    for_kind = [F.endswith(F.lower("path"), F.lit(s)) for s in suffixes]
    if for_kind:
        hit = for_kind[0]
        for k in for_kind[1:]:
            hit = hit | k
        rows = rows.where(hit)
    return rows.orderBy("path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_prefix(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, text) of the first ``size`` bytes; a cut character reads as the replacement."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.expr(f"decode(substring(content, 1, {int(size)}), 'UTF-8')").alias("text"))


def write_new(df: DataFrame, path: str) -> None:
    """Write a table where there is none; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files under ``root``, by path relative to it."""
    base = PurePosixPath(root.split(":", 1)[-1]).as_posix().rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", base, -1).alias("path"), "content")


def drift(left: DataFrame, right: DataFrame, stamp: str | None = None) -> DataFrame:
    """(path, fault) of two file sets (path, content) that should be one: 'only left', 'only right' or
    'differs'. What the pattern ``stamp`` matches in a text, such as the time it was made, does not count."""
    def side(df: DataFrame, name: str) -> DataFrame:
        body = F.col("content") if stamp is None else F.coalesce(F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), stamp, "").cast("binary"), F.col("content"))
        return df.select("path", F.sha2(body, 256).alias(name))
    both = side(left, "l").join(side(right, "r"), "path", "full")
    fault = F.when(F.col("r").isNull(), "only left").when(F.col("l").isNull(), "only right").when(F.col("l") != F.col("r"), "differs")
    return both.select("path", fault.alias("fault")).where("fault is not null")


def raw_versions(spark: SparkSession, root: str, name: str = "item") -> DataFrame:
    """(path, record_id, version, payload) of versioned JSON records: <id>/item.json is
    version 1, item-2.json version 2; numbers are compared as numbers."""
    pattern = rf"([^/]+)/{name}(?:-(\d+))?\.json$"
    files = spark.read.text(f"{root}/*/{name}*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.where(F.rlike("path", F.lit(pattern))).select("path", part(1).alias("record_id"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(1)).alias("version"), "payload")


def table_versions(spark: SparkSession, root: str, names: tuple[str, ...]) -> DataFrame:
    """(table_name, version, payload) of whole-table versions such as people-2.json."""
    pattern = rf"({'|'.join(names)})(?:-(\d+))?\.json$"
    files = spark.read.text(f"{root}/*.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return files.where(F.rlike("path", F.lit("/" + pattern))).select(F.regexp_extract("path", pattern, 1).alias("table_name"),
                                                                    F.coalesce(F.nullif(F.regexp_extract("path", pattern, 2), F.lit("")).cast("int"), F.lit(1)).alias("version"), "payload")


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """Payloads as records of a type; one that is no JSON fails the read."""
    return rows.withColumn("r", F.from_json("payload", schema(kind), {"mode": "FAILFAST"})).select(*[c for c in rows.columns if c != "payload"], "r.*")


def proposals(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The queue of proposed records, one JSON file each; a corrupt one fails."""
    return spark.read.schema(schema(kind)).option("mode", "FAILFAST").option("multiLine", "true").json(path).withColumn("path", F.col("_metadata.file_path"))


def rejected(queue: DataFrame, events: DataFrame, key: str = "id") -> DataFrame:
    """The queue without what was rejected: nothing is deleted, an event says so."""
    return queue.join(events.where("decision = 'reject'").select(key), key, "left_anti")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Registered batches, newest first."""
    return spark.read.schema(schema("batches")).option("multiLine", "true").json(path).orderBy(F.desc("arrived_at"), "batch_id")


def content_for(items: DataFrame, content: DataFrame, kind: str, name: str) -> DataFrame:
    """Items with a content text, null where it is missing."""
    own = content.where(F.col("kind") == kind).select(F.col("item_id").alias("id"), F.col("text").alias(name))
    return items.drop(name).join(own, "id", "left")


def draft_payloads(batch: DataFrame, texts: DataFrame, layouts: DataFrame) -> DataFrame:
    """(batch_id, doc_index, pages, text, layouts): the documents of batches with the texts of
    their pages in order and the layouts by page."""
    docs = batch.select("batch_id", F.posexplode("boundaries").alias("doc_index", "b")).select("batch_id", "doc_index", F.col("b.pages").alias("pages"), F.col("b.status").alias("status"))
    page = docs.select("batch_id", "doc_index", "pages", "status", F.posexplode("pages").alias("pos", "page")).join(texts.select("page", "text"), "page", "left").join(layouts.select("page", "layout"), "page", "left")
    return page.groupBy("batch_id", "doc_index", "pages", "status").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n").alias("text"),
        F.map_from_entries(F.collect_list(F.when(F.col("layout").isNotNull(), F.struct("page", "layout")))).alias("layouts"))


def draft_status(drafts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Drafts with the registry's status of the same pages; unknown ones are under review."""
    return drafts.drop("status").join(boundaries.select("pages", "status"), "pages", "left").withColumn("status", F.coalesce("status", F.lit("review")))


def with_placeholder(assets: DataFrame, files: DataFrame, placeholder: Column | str) -> DataFrame:
    """Assets with their bytes, or the placeholder where there are none."""
    return assets.join(files.select("file", "content"), "file", "left").withColumn("content", F.coalesce("content", placeholder if not isinstance(placeholder, str) else F.lit(placeholder).cast("binary")))
