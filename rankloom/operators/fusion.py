"""Weighted reciprocal rank fusion of lists ``qid, list_id, rank0, doc_id, score``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import FusionConfig
from rankloom.operators.rank import best_first


def as_list(scored: DataFrame, list_id: int, doc: str = "doc_id", score: str = "score", keys: Sequence[str] = ("qid",)) -> DataFrame:
    """A ranked list from scores, by descending score and then document; NaN and null come last."""
    order = Window.partitionBy(*keys).orderBy(*best_first(F.col(score).cast("double"), doc))
    return scored.select(*keys, F.lit(list_id).alias("list_id"), (F.row_number().over(order) - 1).alias("rank0"), F.col(doc).alias("doc_id"), F.col(score).cast("double").alias("score"))


def reciprocal_rank_fusion(lists: Sequence[DataFrame], config: FusionConfig = FusionConfig()) -> DataFrame | None:
    """``qid, doc_id, score, rank``: the sum over lists of weight / (k + position + 1), the position counted from 0; ranks count from 1, by
    descending score and then document.

    One list alone keeps its own scores. A document that a list names twice is counted twice. No lists: None.
    """
    if not lists:
        return None
    if len(lists) == 1:
        return _ordered(lists[0].select("qid", "doc_id", "score"))
    parts = [x.select("qid", "doc_id", (F.lit(config.weight(i)) / (F.col("rank0") + (config.k + 1.0))).alias("part")) for i, x in enumerate(lists)]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return _ordered(union.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")))


def _ordered(fused: DataFrame) -> DataFrame:
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*best_first(F.col("score"), "doc_id"))))


def hybrid(lexical: DataFrame, neural: DataFrame, alpha: float = 0.5, k: float = 60.0) -> DataFrame:
    """Fusion of a lexical list with weight ``1 - alpha`` and a neural one with ``alpha``."""
    return reciprocal_rank_fusion([lexical, neural], FusionConfig(k, (1.0 - alpha, alpha)))
