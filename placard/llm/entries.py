"""The registered queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm import covertree, fingerprint, jaccard, language, packing, periodic, quality, sharding, tokenize, topk, toxicity, trie, urls
from placard.session import small_batches, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(_documents(spark, sf_dir), jaccard.Rule(words=4, num=85))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(_documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learned_and_scored(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_documents(spark, sf_dir))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.quantized(table(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokenize.tokenized(_documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed_pieces(_documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN, with_ids=False)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learned_and_judged(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.learned_and_scored(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("last_turn")


def op12_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return periodic.digests(periodic.periodic_runs(_documents(spark, sf_dir), crc, periodic.periodic_tail))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_jaccard, op2_fingerprint, op3_quality, op4_urls, op5_sharding, op6_topk, op7_bpe, op8_packing, op9_language, op10_toxicity, op11_trie, op12_covertree, op13_runs)
    return {f.__name__: f for f in every}


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.terms, c.terms), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_urls": urls.sql(), "op6_topk": _TOP_K, "op11_trie": trie.sql(), "op12_covertree": covertree.sql()}
