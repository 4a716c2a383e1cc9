"""The operators' queries over the corpus tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, embedding_join, html_text, mixing, ngram_join, pii, quality, sharding, substring


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.formatted(chat.alternatives(_read(spark, sf_dir, "conversations")))

    def spans(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias(name)
    return pairs.select("pair_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passages(_read(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_read(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.link(_read(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = pii.find(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(pii.of_kind(base, k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("row")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs))
    return scored.select("doc_id", "quality_score", "quality_votes", (F.col("quality_score") >= 0.5).alias("kept"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "source", "shards")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_OP1 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, max(turn) AS upto FROM c WHERE role = 'assistant' GROUP BY 1),
z AS (SELECT c.* FROM c JOIN l ON c.conv_id = l.conv_id AND turn = upto WHERE role = 'assistant'),
r AS (SELECT conv_id, turn, role, text FROM c LEFT JOIN l USING (conv_id) WHERE upto IS NULL OR turn < upto
  UNION ALL SELECT a.conv_id, a.turn, b.role, b.text FROM z a JOIN z b ON b.conv_id = xor(a.conv_id, 1)),
t AS (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * FROM r),
i AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn) AS i,
  '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part FROM t),
m AS (SELECT coalesce(x.conv_id, y.conv_id) AS conv_id, coalesce(x.i, y.i) AS i, coalesce(x.part = y.part, false) AS same
  FROM (SELECT * FROM i WHERE side = 'c') x FULL JOIN (SELECT * FROM i WHERE side = 'r') y ON x.conv_id = y.conv_id AND x.i = y.i),
n AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, count(*)) AS n FROM m GROUP BY 1),
s AS (SELECT i.*, n, sum(length(part)) OVER (PARTITION BY side, conv_id ORDER BY i) - length(part) + 12 + length(role) + 1 AS start FROM i JOIN n USING (conv_id) WHERE i > n),
o AS (SELECT side, conv_id, string_agg(part, '' ORDER BY i) AS text, coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(s.text) + 10 AS BIGINT), ',' ORDER BY i)
  FILTER (WHERE role = 'assistant'), '') AS spans FROM s GROUP BY 1, 2),
p AS (SELECT conv_id, n, coalesce(string_agg(part, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt FROM i JOIN n USING (conv_id) WHERE side = 'c' GROUP BY 1, 2)
SELECT p.conv_id AS pair_id, n AS n_prompt_turns, prompt, coalesce(x.text, '') AS chosen, coalesce(x.spans, '') AS chosen_spans, coalesce(y.text, '') AS rejected, coalesce(y.spans, '') AS rejected_spans
FROM p LEFT JOIN o x ON x.side = 'c' AND x.conv_id = p.conv_id LEFT JOIN o y ON y.side = 'r' AND y.conv_id = p.conv_id"""

_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY 1"""

_OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN d ON d.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op4_ngram_jaccard": _OP4, "op6_embedding_near_dedup": _OP6}
