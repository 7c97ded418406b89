"""Reranking a stream of requests: micro-batches in, responses out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import hash_variant
from rankloom.operators.rank import requests_to_candidates, responses, top_k
from rankloom.sources.registry import requests_from_json


def answered(requests: DataFrame, scorer) -> DataFrame:
    """``qid, response, is_error`` for valid requests; one with an empty query, without a document, or with a document that the scorer could
    not score (its column ``error``) gets an error or an empty result of its own."""
    fine = requests.where(F.coalesce("query", F.lit("")) != "")
    scored = scorer.score(requests_to_candidates(fine))
    failed = F.col("error") if "error" in scored.columns else F.lit(None).cast("string")
    scored = scored.withColumn("error", F.min(failed).over(Window.partitionBy("qid")))
    results = top_k(scored.where(F.col("error").isNull()), "top_k")
    shown = results.withColumn("document", F.when(F.col("return_documents"), F.col("doc")))
    told = responses(shown.select("qid", "idx", "score", "rank", "document"))
    broken = scored.where(F.col("error").isNotNull()).groupBy(F.col("qid").alias("_qid")).agg(F.min("error").alias("error"))
    asked = requests.select("qid", "query").join(told, "qid", "left").join(broken, F.col("qid") == F.col("_qid"), "left")
    error = F.when(F.coalesce("query", F.lit("")) == "", "inference error: a query without text").otherwise(F.col("error"))
    text = F.when(error.isNotNull(), F.to_json(F.struct(error.alias("error")))).otherwise(F.coalesce("response", F.lit('{"results":[]}')))
    return asked.select("qid", text.alias("response"), error.isNotNull().alias("is_error"))


def serve(lines: DataFrame, scorers: Mapping[str, object], weights: tuple[int, int], sink: Callable[[DataFrame, int], None]):
    """A writer for a stream of JSON requests: each micro-batch is routed to variant ``a`` or ``b`` by its ids and scored by that one's scorer.

    ``sink`` gets a frame ``qid, response, is_error, variant, latency_ms`` and the batch's number; a batch that is replayed has the same
    number. A request's latency is the time its micro-batch took, which is when its answer is there; ``variant_metrics`` and
    ``server_metrics`` take such rows.
    """
    requests = requests_from_json(lines)

    def handle(batch: DataFrame, number: int) -> None:
        routed = batch.withColumn("variant", hash_variant(F.col("qid"), *weights))
        parts = [answered(routed.where(F.col("variant") == v), s).withColumn("variant", F.lit(v)) for v, s in sorted(scorers.items())]
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        out = out.persist()
        began = time.monotonic()
        out.count()
        sink(out.withColumn("latency_ms", F.lit((time.monotonic() - began) * 1000.0)), number)
        out.unpersist()

    return requests.writeStream.foreachBatch(handle)
