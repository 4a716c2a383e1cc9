import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in every column, empty and blank texts, a very long one, repeated
    rows and ids, and columns whose names clash with the operators' own."""
    long_text = " ".join(f"w{i % 977} the of" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and looked at the dog for a long while today", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", None, 3),
            (5, long_text, "en", "b", len(long_text)), (6, "one", "en", "b", 3), (6, "one", "en", "b", 3), (7, "one", "en", "c", 3), (None, "one two three", "en", "c", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    return df.withColumns({"size": F.lit("s"), "shard": F.lit("x"), "rank": F.lit(1), "a.b": F.lit(2), "hits": F.lit(None).cast("string"), "spans": F.lit(0), "quality_score": F.lit("q"), "target": F.lit("t")})
