"""Stages that turn raw documents into packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from placard.llm import jaccard, language, packing, quality
from placard.llm.training import remainder
from placard.session import small_batches, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, accepts.

    Rows: a null text counts as empty; null ids and repeated rows are judged by their texts; without labels of both classes all
    stay or go by the share of label 1; an empty table gives no rows.
    """
    small_batches(spark)
    return quality.accepted(docs, quality.learned(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, learned from four fifths of the ids with a known one.

    Rows: null and empty texts and texts without letters go; null ids and repeated rows are judged by their texts; without any
    known language nothing stays; an empty table gives no rows.
    """
    small_batches(spark)
    return language.spoken(docs, language.labelled_text(docs, remainder(docs["doc_id"], 5) != 0))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more: the smallest id.

    Rows: texts without words and rows with a null id stay; of repeated rows one stays, and rows of one id with other texts are
    told apart; an empty table gives no rows.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, jaccard.Rule(words=5, num=80, den=100))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids and sequence numbers.

    Rows: a null or empty text is the end id alone; null ids and repeated rows have pieces of their own; an empty table gives none.
    """
    small_batches(spark)
    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near copies", near_copy_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # models and tokens are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
