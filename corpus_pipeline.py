"""The corpus pipeline: stages over documents, each written as Parquet and read by the next.

Every stage takes any documents, none included, with further columns and nulls in all of them, and
hands on what it keeps with all columns; what it does with nulls and repeated rows it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import decontaminate, mixing, ngram_join, quality, sharding
from tidewrack.llm.common import cut, drop_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents, does not reject. Null and
    blank texts are rejected; equal rows share their fate."""
    return quality.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join: five words, similarity 0.8. Null
    texts link with nothing; of rows with one id one stays, and all rows without an id."""
    return ngram_join.deduplicate(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``. Null and empty texts hold none; rows equal in
    id and text share their fate."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them. A null source is a source of its own, null texts have
    no words, and equal rows are drawn each for itself."""
    return mixing.mix(docs).select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it. Null texts count as no bytes; equal rows keep
    together."""
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; each stage's result is a table in the shared folder, which goes
    when the next one has read it."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        if made is not None:
            drop_table(made)
        made = docs
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
