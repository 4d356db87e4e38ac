"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licences, neighbours, packing, pieces, quality, resharding, runs, simhash, structure, substrings, topk, toxicity
from .common import load


#: One conversation more, whose texts hold the template's control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=50, k=5, scale=256.0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), errors=4, words_per_shingle=4, seed=42)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(load(spark, sf_dir, "documents"), span=50)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(load(spark, sf_dir, "documents"), least=0.8)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=100, k=10)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(CONTROL_TEXT))
    return chat.digest(turns.unionByName(more))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(load(spark, sf_dir, "documents"), name="piece_bpe_32k.model")


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digest(load(spark, sf_dir, "documents"), shards=24, law="bytes")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.planted(load(spark, sf_dir, "documents")), least=24, times=3)


def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return structure.report(structure.damaged(turns), turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_simhash, op3_packing, op4_substrings, op5_licences, op6_neighbours, op7_chat, op8_quality, op9_toxicity, op10_sentencepiece, op11_resharding, op12_runs, op13_structure)}


#: Exact top-k: quantised inner products of all queries and rows, ranked.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Chat formatting: turns and texts as they stand in the table, and the template's length.
OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS opens,
    length(regexp_replace(text, '(\\*)(###|</turn>|<next/>)', '\\\1\2', 'g')) AS body,
    length(replace(replace(replace(role, '%', '%25'), ':', '%3A'), chr(10), '%0A')) AS name
  FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(body + CASE WHEN opens THEN name + 15 ELSE 9 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op7_chat": OP7_SQL}
