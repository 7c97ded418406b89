"""Ranking of candidates ``qid, query, idx, doc`` by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def requests_to_candidates(requests: DataFrame) -> DataFrame:
    """``qid, query, idx, doc, top_k, return_documents`` from rows of requests with an array ``documents``.

    An empty query is an error, also where there are no documents; a request without documents gives no rows.
    """
    checked = requests.withColumn("query", F.when(F.coalesce("query", F.lit("")) == "", F.raise_error(F.lit("inference error: a query without text"))).otherwise(F.col("query")))
    return checked.select("qid", "query", F.posexplode("documents").alias("idx", "doc"), "top_k", "return_documents")


def best_first(score: Column, tie: str = "idx") -> list[Column]:
    """Descending by score, NaN and null last, equal scores by ``tie``, the input order unless another column is named."""
    return [F.isnan(score).asc_nulls_last(), score.desc_nulls_last(), F.col(tie).asc()]


def ranked(scored: DataFrame, keys: Sequence[str] = ("qid",), score: str = "score") -> DataFrame:
    """``scored`` with a 1-based ``rank`` in each key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first(F.col(score)))))


def top_k(scored: DataFrame, k: int | str, keys: Sequence[str] = ("qid",), score: str = "score") -> DataFrame:
    """The ``k`` best of each key. A number lets the planner cut each group before the shuffle; a column name gives each row's own
    ``k``, null for no limit. A ``k`` of 0 gives no rows."""
    bound = F.coalesce(F.col(k), F.lit(2**31 - 1)) if isinstance(k, str) else F.lit(k)
    return ranked(scored, keys, score).where(F.col("rank") <= bound)


def rerank(candidates: DataFrame, scorer, k: int | str | None = None, return_documents: bool = False) -> DataFrame:
    """``qid, idx, score, rank[, document]``: candidates scored by ``scorer``, best first."""
    scored = scorer.score(candidates)
    out = ranked(scored) if k is None else top_k(scored, k)
    return out.select("qid", "idx", "score", "rank", *([F.col("doc").alias("document")] if return_documents else []))


def responses(results: DataFrame) -> DataFrame:
    """A JSON response for each ``qid``; absent documents leave no field."""
    fields = [c for c in ("idx", "score", "document") if c in results.columns]
    rows = F.transform(F.array_sort(F.collect_list(F.struct("rank", *fields))), lambda r: F.struct(*(r[c].alias("index" if c == "idx" else c) for c in fields)))
    return results.groupBy("qid").agg(F.to_json(F.struct(rows.alias("results"))).alias("response"))
