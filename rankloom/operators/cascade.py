"""A fast scorer for all candidates, a big one only for those in doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.config import CascadeConfig
from rankloom.functions.columns import at_least
from rankloom.operators.rank import top_k


def zone(score: Column, config: CascadeConfig = CascadeConfig()) -> Column:
    """``high``, ``uncertain`` or ``reject``; NaN and null are rejected."""
    return F.when(at_least(score, config.high), "high").when(at_least(score, config.low), "uncertain").otherwise("reject")


def cascade(candidates: DataFrame, fast, big, k: int, config: CascadeConfig = CascadeConfig()) -> DataFrame:
    """``qid, idx, doc, score, rank``: sure candidates with their fast score, doubtful ones with the big one's, ``k`` best of both.

    The filter on the fast score stands below the big scorer, which so sees doubtful rows only. Where it gives a column ``error``
    that is set for a row, its whole query keeps only sure candidates.
    """
    scored = fast.score(candidates).withColumn("zone", zone(F.col("score"), config))
    sure = scored.where(F.col("zone") == "high").select("qid", "idx", "doc", "score")
    doubtful = scored.where(F.col("zone") == "uncertain").drop("score", "zone")
    again = big.score(doubtful)
    if "error" in again.columns:
        failed = again.where(F.col("error").isNotNull()).select("qid").distinct()
        again = again.join(failed, "qid", "left_anti")
    return top_k(sure.unionByName(again.select("qid", "idx", "doc", "score")), k)
