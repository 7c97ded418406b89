"""Drift of score distributions, in batch: decayed histograms, divergence, and the course of alerts.

Rows are ``model, n, score``: ``n`` counts a model's observations from 1. An observation weighs ``decay`` to the number of those
after it, which is what multiplying all bins before each addition comes to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.config import DriftConfig
from rankloom.functions.columns import histogram_bin


def numbered(rows: DataFrame, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """``rows`` with ``n``, the observation's number in its key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def histogram(rows: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``model, bin, weight`` after all rows; empty bins have no row."""
    last = rows.groupBy("model").agg(F.max("n").alias("last"))
    weight = F.pow(F.lit(config.decay), (F.col("last") - F.col("n")).cast("double"))
    return rows.join(last, "model").groupBy("model", histogram_bin(F.col("score"), config.bins).alias("bin")).agg(F.sum(weight).alias("weight"))


def dense(weights: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``keys, bin, p``: shares over all bins; uniform if a histogram is empty."""
    all_bins = weights.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    filled = all_bins.join(weights, [*keys, "bin"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("total", total)
    return filled.select(*keys, "bin", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(F.lit(1.0 / bins)).alias("p"))


def divergence(p: Column, q: Column, epsilon: float) -> Column:
    """A bin's part of the divergence of p from q, both smoothed."""
    return (p + epsilon) * F.ln((p + epsilon) / (q + epsilon))


def kl(current: DataFrame, baseline: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``model, kl`` of two histograms, over all bins."""
    p, q = dense(current, ["model"], config.bins), dense(baseline, ["model"], config.bins).withColumnRenamed("p", "q")
    return p.join(q, ["model", "bin"]).groupBy("model").agg(F.sum(divergence(F.col("p"), F.col("q"), config.epsilon)).alias("kl"))


def checks(rows: DataFrame, every: int, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``model, n, kl, status, alerts`` at each ``every`` observations.

    Observations are summed for each check's span, decayed to its end; a check's histogram adds the spans before it, each decayed by
    the distance. Spans so far back that they weigh under 1e-18 of the present are left out, so spans meet a bounded number of
    checks. ``alerts`` is how many checks in a row were over the threshold, up to this one.
    """
    import math

    marked = rows.withColumn("check", F.ceil(F.col("n") / every).cast("int"))
    fine = marked.withColumn("bin", histogram_bin(F.col("score"), config.bins))
    weight = lambda end: F.pow(F.lit(config.decay), (end - F.col("n")).cast("double"))
    spans = fine.groupBy("model", "check", "bin").agg(F.sum(weight(F.col("check") * every)).alias("weight"))
    reach = math.ceil(math.log(1e-18) / math.log(config.decay) / every)
    ended = rows.groupBy("model").agg(F.max("n").alias("last"))
    meets = spans.select("model", "bin", "weight", F.col("check").alias("from"), F.explode(F.sequence(F.col("check"), F.col("check") + reach)).alias("check")).join(ended, "model").where(F.col("check") * every <= F.col("last"))
    decayed = F.col("weight") * F.pow(F.lit(config.decay), ((F.col("check") - F.col("from")) * every).cast("double"))
    current = meets.groupBy("model", "check", "bin").agg(F.sum(decayed).alias("weight"))

    early = fine.where(F.col("n") <= config.warm_up)
    base = early.groupBy("model", "bin").agg(F.sum(weight(F.lit(config.warm_up))).alias("weight"))
    p = dense(current, ["model", "check"], config.bins)
    q = dense(base, ["model"], config.bins).withColumnRenamed("p", "q")
    found = p.join(q, ["model", "bin"]).groupBy("model", "check").agg(F.sum(divergence(F.col("p"), F.col("q"), config.epsilon)).alias("kl"))
    return statuses(found.select("model", (F.col("check") * every).alias("n"), "kl"), config)


def statuses(found: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``model, n, kl, status, alerts`` from divergences in the order of ``n``; ``kl`` is null before the baseline."""
    known = (F.col("n") >= config.warm_up) & (F.col("n") >= config.least)
    order = Window.partitionBy("model").orderBy("n")
    rows = found.withColumn("known", known).withColumn("over", known & (F.col("kl") > config.threshold))
    # a check without enough data says nothing and changes nothing
    calm = F.sum(F.when(F.col("known") & ~F.col("over"), 1).otherwise(0)).over(order)
    rows = rows.withColumn("run", calm)
    rows = rows.withColumn("alerts", F.sum(F.col("over").cast("int")).over(Window.partitionBy("model", "run").orderBy("n")).cast("int"))
    before = F.coalesce(F.lag("alerts").over(order), F.lit(0))
    status = (
        F.when(~F.col("known"), "InsufficientData")
        .when(F.col("over"), F.when(F.col("alerts") >= config.critical_after, "Critical").otherwise("Warning"))
        .when(before > 0, "Recovered")
        .otherwise("Stable")
    )
    return rows.withColumn("status", status).select("model", "n", F.when(F.col("n") >= config.warm_up, F.col("kl")).alias("kl"), "status", "alerts")


def summary(checked: DataFrame, rows: DataFrame, config: DriftConfig = DriftConfig()) -> DataFrame:
    """``model, baseline_established, samples, warm_up_left, alerts, kl, threshold``: where each model of ``rows`` (``model, n``) stands, by its
    last look in ``checked``; ``alerts`` is 0 and ``kl`` null before the first."""
    seen = rows.groupBy("model").agg(F.max("n").alias("samples"))
    last = checked.groupBy("model").agg(F.max_by(F.struct("alerts", "kl"), "n").alias("look"))
    ready = F.col("samples") >= config.warm_up
    return seen.join(last, "model", "left").select(
        "model",
        ready.alias("baseline_established"),
        "samples",
        F.greatest(F.lit(config.warm_up) - F.col("samples"), F.lit(0)).alias("warm_up_left"),
        F.coalesce("look.alerts", F.lit(0)).alias("alerts"),
        F.when(ready, F.col("look.kl")).alias("kl"),
        F.lit(config.threshold).alias("threshold"),
    )
