"""Retrieval datasets as three tables: queries, corpus, judgments. JSON lines with a given schema, judgments as tab-separated lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.columns import graded, titled
from rankloom.operators.evaluation import last_judgment

RECORD = "_id STRING, title STRING, text STRING"

#: How many documents that no judgment names are loaded beside those that one does.
EXTRA_DOCUMENTS = 10_000


@dataclass(frozen=True)
class Dataset:
    """``queries`` (``qid, query``), ``corpus`` (``doc_id, text``), ``judged`` (``qid, doc_id, rel``)."""

    queries: DataFrame
    corpus: DataFrame
    judged: DataFrame


def _records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank ones are passed over, others must be valid and have ``_id`` and ``text``."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    missing = F.col("_id").isNull() | F.col("text").isNull()
    return rows.withColumn("_id", F.when(missing, F.raise_error(F.lit(f"io error: a record of {path} lacks _id or text"))).otherwise(F.col("_id")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path).select(F.col("_id").alias("qid"), F.col("text").alias("query"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark, path).select(F.col("_id").alias("doc_id"), titled(F.col("title"), F.col("text")).alias("text"))


def read_judgments(spark: SparkSession, path: str, header: str = "always") -> DataFrame:
    """``qid, doc_id, rel``. Lines are trimmed, those of fewer than three fields passed over, grades that are no number of 0 to 255 are 0.

    ``header``: ``always`` drops each file's first line, ``named`` drops it if it begins with "query".
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # as many rows as files
    first = lines.where(F.col("block") == 0).groupBy(F.col("file").alias("f")).agg(F.min("at").alias("first"))
    lines = lines.join(F.broadcast(first), F.col("file") == F.col("f"), "left")
    heads = F.coalesce(F.col("at") == F.col("first"), F.lit(False))
    lines = lines.where(~(heads & F.col("line").startswith("query")) if header == "named" else ~heads)
    parts = lines.select(F.split("line", "\t").alias("p"), "at").where(F.size("p") >= 3)
    rows = parts.select(F.trim(F.col("p")[0]).alias("qid"), F.trim(F.col("p")[1]).alias("doc_id"), graded(F.col("p")[2]).alias("rel"), "at")
    return last_judgment(rows, "at")


def load_beir(spark: SparkSession, path: str, split: str = "test") -> Dataset:
    """A folder of ``queries.jsonl``, ``corpus.jsonl`` and ``qrels/<split>.tsv``; judgments of unknown queries or documents are dropped."""
    queries, corpus = read_queries(spark, f"{path}/queries.jsonl"), read_corpus(spark, f"{path}/corpus.jsonl")
    judged = read_judgments(spark, f"{path}/qrels/{split}.tsv")
    return Dataset(queries, corpus, known(judged, queries, corpus))


def known(judged: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    return judged.join(queries.select("qid"), "qid", "left_semi").join(corpus.select("doc_id"), "doc_id", "left_semi").select("qid", "doc_id", "rel")


def load_msmarco(spark: SparkSession, path: str, max_queries: int | None = None, extra: int = EXTRA_DOCUMENTS) -> Dataset:
    """Judged queries, the first ``max_queries`` by id if given; all documents that their judgments name, and the first ``extra`` others."""
    judged = read_judgments(spark, f"{path}/qrels/dev.tsv", header="named")
    queries = read_queries(spark, f"{path}/queries.jsonl").join(judged.select("qid"), "qid", "left_semi")
    if max_queries is not None:
        queries = queries.orderBy("qid").limit(max_queries)
    judged = judged.join(queries.select("qid"), "qid", "left_semi")
    whole = read_corpus(spark, f"{path}/corpus.jsonl")
    named = judged.select("doc_id").distinct()
    needed = whole.join(named, "doc_id", "left_semi")
    others = whole.join(named, "doc_id", "left_anti").orderBy("doc_id").limit(extra)
    return Dataset(queries, needed.unionByName(others), judged.select("qid", "doc_id", "rel"))
