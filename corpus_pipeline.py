"""The corpus pipeline: documents without toxic and poor ones, without repeated line runs and near copies, packed for training."""

from __future__ import annotations

import uuid
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import line_dedup, ngram_join, packing, quality_rules, toxicity
from rankloom.llm.common import drop, step, work_dir, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; null texts are scored as empty ones, repeated rows share a fate, no documents give none."""
    return toxicity.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines above the limits.

    Null and empty texts fail for want of words; a null source is a source of its own; repeated rows share a fate.
    """
    return quality_rules.filtered(docs)


def without_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words and more; those that lose all their lines are gone.

    The order is that of ids, rows without one last; of repeated rows one keeps its lines; null and empty texts stay.
    """
    return line_dedup.filtered(docs, least=50)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id; null, empty and blank texts are copies of none."""
    return ngram_join.one_of_each(docs, ngram_join.Settings(width=5, threshold=Fraction(4, 5)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", of_quality),
    ("line_dedup", without_repeated_runs),
    ("ngram_join", one_of_near_copies),
    ("packing", packed),
]

#: Scores of compressed lengths and the packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next.

    What a stage writes on its way goes when its rows are written, and those when the next stage's are.
    """
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        with step(spark):
            docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if before:
            drop(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
