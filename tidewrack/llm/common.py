"""What the corpus operators share: scratch tables, word expressions, component labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.shared import shared_dir

#: White space of the contracts: space and the ASCII controls 9 to 13.
WS_CHARS = " \t\n\x0b\f\r"
WS_REGEX = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it again, so that what follows
    neither recomputes it nor depends on the executors that made it. Spark deletes the
    table when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewrack-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df[f"`{name}`"]


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column of ``taken`` has it."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white characters; null and blank text: empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_REGEX))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Parts of an array that are placed one after the other by a fold, which copies what it has at every step.
_FOLD = 256


def located(parts: Column, size: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """For each part of an array ``made(part, start)``, an array of ``kind``; start is the sum of the sizes before it.
    Long arrays are taken in slices, so the cost grows little faster than their length."""
    def of(p: Column) -> Column:
        def fold(zero: Column, own: Column) -> Column:
            first = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
            return F.aggregate(own, first, lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.array_append(a["out"], made(x, a["at"])).alias("out")), lambda a: a["out"])

        def sliced(c: Column) -> Column:
            return F.slice(p, c * _FOLD + 1, _FOLD)
        chunks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _FOLD).cast("int"))
        sums = F.transform(chunks, lambda c: F.aggregate(sliced(c), F.lit(0), lambda a, x: a + size(x)))

        def long(s: Column) -> Column:
            return F.flatten(F.transform(chunks, lambda c: fold(F.aggregate(F.slice(s, F.lit(1), c), F.lit(0), lambda a, x: a + x), sliced(c))))
        return F.when(F.size(p) <= _FOLD, fold(F.lit(0), p)).otherwise(F.get(F.transform(F.array(sums), long), 0))
    return F.get(F.transform(F.array(parts), of), 0)


#: Rows of an edge table that one task handles, so that a small table is not spread over all shuffle partitions.
EDGES_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Label the nodes of ``edges`` (u long, v long) with the smallest node reachable.

    Returns (node, component) for nodes that have an edge to another node; nodes with none, edges of a
    node to itself and edges with a null end give no row, repeated edges count once, and no edges give no
    rows. Alternates the
    large-star and small-star steps until the edge set stands still; every step is a
    min per node and an equi-join, both of which AQE splits, and the state between rounds
    is a table in the shared folder. No edge goes to the driver: it sees a count and a
    checksum per round.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = mark(now)
    while before[0]:
        tasks = -(-before[0] // EDGES_PER_TASK)
        both = now.coalesce(tasks).select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.coalesce(tasks).distinct(), tasks)
        after = mark(new)
        drop_table(now)
        drop_table(large)
        now = new
        if after == before:
            break
        before = after
    stars = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x"))
    return stars.select("x.*").distinct()
