"""The stages by which scanned pages become documents, with the models as parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.operators.sequence import documents
from tidewrack.operators.versions import latest

#: Pages with this many clear words are print, the others handwriting.
DENSITY = 200
#: Pages that one model call sees.
CHUNK = 5

Model = Callable[[DataFrame], DataFrame]


def routes(pages: DataFrame, density: str = "strong_words", least: int = DENSITY) -> DataFrame:
    return pages.withColumn("route", F.when(F.col(density) >= least, "print").otherwise("handwriting"))


def chunked(pages: DataFrame, batch: str = "batch_id", order: str = "page", size: int = CHUNK) -> DataFrame:
    """Pages with the number of the call that sees them."""
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(order))
    return pages.withColumn("chunk", F.floor((rank - 1) / size).cast("int"))


def known_pages(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """Flags of pages that exist: a model may make some up."""
    return flags.join(pages.select("batch_id", "page"), ["batch_id", "page"], "left_semi")


def process(pages: DataFrame, transcribe: Model, flag: Model, done: DataFrame | None = None) -> DataFrame:
    """Documents of the batches: route, transcribe, flag in chunks, group. ``transcribe`` adds
    text, ``flag`` adds starts, ends, greeting and signoff; both get a DataFrame and may be a
    mapInPandas over it. Pages in ``done`` keep their text and are not sent again."""
    routed = routes(pages)
    if done is not None:
        new = routed.join(done.select("batch_id", "page"), ["batch_id", "page"], "left_anti")
        texts = transcribe(new).select("batch_id", "page", "text").unionByName(done.select("batch_id", "page", "text"))
    else:
        texts = transcribe(routed).select("batch_id", "page", "text")
    flags = known_pages(flag(chunked(texts)), pages)
    return documents(flags, ["batch_id"], "page", "starts", "ends", "greeting", "signoff")


def reviewed(boundaries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Boundaries with the latest decision on each: accepted, edited (its text) or rejected."""
    last = latest(decisions, ["batch_id", "doc_no"], ["at"]).select("batch_id", "doc_no", "decision", F.col("text").alias("_text"))
    both = boundaries.join(last, ["batch_id", "doc_no"], "left")
    status = F.when(F.col("decision").isin("accept", "edit"), "confirmed").when(F.col("decision") == "reject", "rejected").otherwise("review")
    return both.withColumns({"status": status, "text": F.when(F.col("decision") == "edit", F.col("_text")).otherwise(F.col("text"))}).drop("decision", "_text")


def confirmed(boundaries: DataFrame, confirmations: DataFrame, order: str = "confirmed_at") -> DataFrame:
    """The registry after confirmations: the last one for the same pages replaces the entry."""
    kept = boundaries.join(confirmations.select("batch_id", "pages"), ["batch_id", "pages"], "left_anti")
    new = latest(confirmations, ["batch_id", "pages"], [order])
    return kept.unionByName(new.select(*[c for c in kept.columns if c in new.columns]), allowMissingColumns=True)


def capture(imports: DataFrame, known: DataFrame, edges: DataFrame, known_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and links not captured yet: a repeat adds nothing."""
    new = imports.join(known.select("id"), "id", "left_anti")
    return new, edges.distinct().join(known_edges.select("a", "b", "kind"), ["a", "b", "kind"], "left_anti")


def affected(changed: DataFrame, suites: DataFrame) -> DataFrame:
    """(suite) whose path prefix a changed file has."""
    return changed.join(suites, F.startswith(changed["path"], suites["prefix"])).select("suite").distinct()  # suites are a short list


def classified(pages: DataFrame, scores: str, labels: tuple[str, ...]) -> DataFrame:
    """Pages with the class of the highest score."""
    from tidewrack.operators.alignment import best_class
    return pages.withColumn("kind", best_class(F.col(scores), F.array(*[F.lit(x) for x in labels])))
