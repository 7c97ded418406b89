"""Retrieval evaluation over ``ranking`` (``qid, doc_id, rank``, 1-based) and ``judged`` (``qid, doc_id, rel``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import md5_bucket
from rankloom.session import broadcast_if, is_small


def gain(rel: Column, rank: Column) -> Column:
    """What a grade of ``rel`` is worth at a 1-based rank."""
    return (F.pow(F.lit(2.0), rel.cast("double")) - 1.0) / F.log2(rank + 1.0)


def last_judgment(judged: DataFrame, order: str | None = None) -> DataFrame:
    """One grade for each query and document: the last in ``order``, or the highest without one."""
    pick = F.max_by("rel", order) if order else F.max("rel")
    return judged.groupBy("qid", "doc_id").agg(pick.alias("rel"))


def ndcg_at(ranking: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """``qid, ndcg`` for each query that is ranked. The ideal order is over all of a query's judgments, cut where the ranking is cut;
    0 where nothing is relevant."""
    # no query needs more than k ranks or k best judgments, which windows cut before the shuffle
    shown = ranking.where(F.col("rank") <= k)
    dcg = shown.join(judged, ["qid", "doc_id"], "left").groupBy("qid").agg(F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("n"))
    best = judged.withColumn("ideal", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))).where(F.col("ideal") <= k)
    ideal = best.join(dcg.select("qid", "n"), "qid").where(F.col("ideal") <= F.col("n")).groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("ideal"))).alias("idcg"))
    return dcg.join(ideal, "qid", "left").select("qid", F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def reciprocal_rank(ranking: DataFrame, judged: DataFrame) -> DataFrame:
    """``qid, rr``: one over the rank of the first relevant document, 0 without one."""
    relevant = judged.where(F.col("rel") > 0).select("qid", "doc_id", F.lit(True).alias("hit"))
    first = ranking.join(relevant, ["qid", "doc_id"], "left").groupBy("qid").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.select("qid", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))


def macro_mean(per_query: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row of means. With ``queries``, those that are missing count as 0; without, only those that were scored count."""
    values = [c for c in per_query.columns if c != "qid"]
    rows = per_query if queries is None else queries.select("qid").join(per_query, "qid", "left")
    return rows.agg(*(F.coalesce(F.avg(F.coalesce(c, F.lit(0.0))), F.lit(0.0)).alias(c) for c in values), F.count(F.lit(1)).alias("n_queries"))


def hash_order(corpus: DataFrame, seed: int) -> DataFrame:
    """``doc_id, pos``: the places of the corpus's documents, from 0 on, in the order of a seeded hash.

    The hash's first digits deal the documents evenly into 65,536 groups; a group's place is the sum of the sizes before it.
    """
    hashed = corpus.select("doc_id", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id"))).alias("h")).withColumn("group", F.substring("h", 1, 4))
    sizes = hashed.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("group").alias("_group"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("group").orderBy("h", "doc_id"))
    placed = hashed.withColumn("nth", nth).join(F.broadcast(starts), F.col("group") == F.col("_group"))
    return placed.select("doc_id", (F.col("start") + F.col("nth") - 1).alias("pos"))


def sampled_negatives(queries: DataFrame, corpus: DataFrame, judged: DataFrame, top: int, seed: int = 42) -> DataFrame:
    """``qid, doc_id, rel, idx``: each query's judged documents, then unjudged ones up to ``top`` candidates.

    The negatives of a query are those that follow its own place in the corpus's ``hash_order``, round to the beginning. As many are
    drawn as could be needed if all judged ones were among them, so no query meets the whole corpus. Judged documents come first, so they
    win ties. A document judged irrelevant is no negative.
    """
    known = judged.join(corpus.select("doc_id"), "doc_id", "left_semi")
    by_doc = Window.partitionBy("qid").orderBy("doc_id")
    first = known.select("qid", "doc_id", "rel", (F.row_number().over(by_doc) - 1).alias("idx"))
    have = queries.select("qid").join(first.groupBy("qid").agg(F.count(F.lit(1)).alias("have")), "qid", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    total = corpus.count()
    if not total:
        return first
    start = F.pmod(md5_bucket(F.concat_ws("|", F.lit(str(seed)), F.col("qid")), 2**31), F.lit(total))
    turns = F.explode(F.sequence(F.lit(0), F.least(F.lit(top) + F.col("have"), F.lit(total)) - 1))
    asked = have.select("qid", "have", start.alias("start"), turns.alias("turn")).withColumn("pos", F.pmod(F.col("start") + F.col("turn"), F.lit(total)))
    drawn = hash_order(corpus, seed).join(broadcast_if(is_small(asked), asked), "pos").join(judged.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    rest = drawn.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("turn"))).where(F.col("n") <= F.lit(top) - F.col("have"))
    return first.unionByName(rest.select("qid", "doc_id", F.lit(0).cast(judged.schema["rel"].dataType).alias("rel"), (F.col("have") + F.col("n") - 1).cast("int").alias("idx")))
