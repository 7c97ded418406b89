"""First-stage retrieval by BM25, and two-stage search."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import all_tokens, tokens
from rankloom.operators import matching
from rankloom.session import is_small


class Retriever(Protocol):
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def held_queries(queries: DataFrame) -> tuple[DataFrame, matching.Asked | None]:
    """``qid, token`` of ``queries`` (``qid, query``), and the same for tasks to hold if they are few enough; else joins shuffle by token."""
    out = queries.select("qid", F.explode(tokens(F.col("query"))).alias("token"))
    return out, matching.Asked(out.toArrow()) if is_small(out) else None


def overlaps(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``qid, doc_id, inter, nq, nd``: each query with the documents (``doc_id, text``) that share a token with it.

    Queries that tasks can hold meet each document where it lies. More of them are joined by token, and counts by pair are shuffled.
    """
    rows, asked = held_queries(queries)
    if asked:
        return matching.overlaps(docs, asked)
    sized = queries.select("qid", F.size(tokens(F.col("query"))).alias("nq"))
    words = docs.select("doc_id", tokens(F.col("text")).alias("words")).select("doc_id", F.size("words").alias("nd"), F.explode("words").alias("token"))
    met = words.join(rows, "token").groupBy("qid", "doc_id").agg(F.count(F.lit(1)).alias("inter"), F.first("nd").alias("nd"))
    return met.join(sized, "qid").select("qid", "doc_id", "inter", "nq", "nd")


class Bm25:
    """BM25 over ``corpus`` (``doc_id, text``).

    One pass counts documents by the queries' tokens, one scores; queries that tasks can hold are cut to their best before the shuffle.
    """

    def __init__(self, corpus: DataFrame, k1: float = 1.2, b: float = 0.75):
        self.corpus, self.k1, self.b = corpus, k1, b

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``qid, idx, doc_id, score``: the ``k`` best documents of each query, equal scores by document."""
        rows, asked = held_queries(queries)
        words = self.corpus.select("doc_id", all_tokens(F.col("text")).alias("words"))
        if asked:
            n, mean, df = matching.corpus_statistics(words, asked)
            scored = matching.weighed(words, asked, np.log(1.0 + (n - df + 0.5) / (df + 0.5)), mean or 1.0, self.k1, self.b)
        else:
            scored = self._joined(words, rows)
        order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
        return scored.withColumn("idx", F.row_number().over(order) - 1).where(F.col("idx") < k).select("qid", "idx", "doc_id", "score")

    def _joined(self, words: DataFrame, asked: DataFrame) -> DataFrame:
        """Scores by an inverted list of the queries' tokens, counted within each document before anything is shuffled."""
        docs = words.withColumn("length", F.size("words"))
        n, mean = docs.agg(F.count(F.lit(1)), F.avg("length")).first()
        counted = docs.select("doc_id", "length", F.explode("words").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
        postings = counted.groupBy("doc_id", "length", "token").agg(F.count(F.lit(1)).alias("tf"))
        df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        idf = F.ln(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf") * (self.k1 + 1.0) / (F.col("tf") + self.k1 * (1.0 - self.b + self.b * F.col("length") / F.lit(float(mean or 1.0))))
        parts = postings.join(asked.join(df, "token").select("qid", "token", idf.alias("idf")), "token").select("qid", "doc_id", (F.col("idf") * tf).alias("part"))
        return parts.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def two_stage(retriever: Retriever, queries: DataFrame, corpus: DataFrame, scorer, retrieve: int = 100, k: int = 10) -> DataFrame:
    """``qid, idx, doc_id, score, rank``: the ``k`` best by ``scorer`` of the ``retrieve`` first found; ``idx`` is the place in the first list."""
    from rankloom.operators.rank import top_k

    found = retriever.search(queries, retrieve).drop("score")
    candidates = found.join(queries.select("qid", "query"), "qid").join(corpus.select("doc_id", F.col("text").alias("doc")), "doc_id")
    return top_k(scorer.score(candidates), k).select("qid", "idx", "doc_id", "score", "rank")
