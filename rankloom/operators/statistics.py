"""Statistics of latencies and scores. Percentiles are by index into the sorted values, three rules as their users have them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Index, counted from 0, of a percentile among ``n`` sorted values.
BY_HUNDREDTHS = {"p50": lambda n: F.floor(n * 50 / 100), "p95": lambda n: F.least(F.floor(n * 95 / 100), n - 1), "p99": lambda n: F.least(F.floor(n * 99 / 100), n - 1)}
BY_FRACTION = {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1), "p99": lambda n: F.least(F.floor(n * F.lit(0.99)), n - 1)}
UNCLAMPED = {"p95": lambda n: F.floor(n * F.lit(0.95))}


def at_index(rows: DataFrame, keys: Sequence[str], value: str, indexes: Mapping) -> DataFrame:
    """``keys`` and the values at the indexes, null where there is none.

    Equal values are counted by partial sums first, so that what a key's window sees is its distinct values, not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(whole))
    hit = lambda i: (F.col("_upto") > i) & (F.col("_upto") - F.col("_n") <= i)
    return ranked.groupBy(*keys).agg(*(F.max(F.when(hit(index(F.col("_all"))), F.col(value))).alias(name) for name, index in indexes.items()))


def latency_stats(rows: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """``p50, p95, p99, mean, qps`` of latencies in milliseconds; requests a second are infinite if they take no time."""
    keys = list(keys)
    rows = rows if keys else rows.withColumn("_one", F.lit(1))
    by = keys or ["_one"]
    total = F.sum(value)
    sums = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(total > 0, F.count(value) * 1000.0 / total).otherwise(float("inf")).alias("qps"))
    return at_index(rows, by, value, BY_FRACTION).join(sums, by).drop("_one")


def variant_metrics(rows: DataFrame, variant: str = "variant", latency: str = "latency", error: str = "is_error") -> DataFrame:
    """``variant, n, total, mean, errors, p50, p95, p99`` for each variant; errors add to their own count only."""
    fine = rows.where(~F.col(error))
    sums = rows.groupBy(variant).agg(
        F.count_if(~F.col(error)).alias("n"),
        F.coalesce(F.sum(F.when(~F.col(error), F.col(latency))), F.lit(0.0)).alias("total"),
        F.coalesce(F.avg(F.when(~F.col(error), F.col(latency))), F.lit(0.0)).alias("mean"),
        F.count_if(F.col(error)).alias("errors"),
    )
    found = at_index(fine, [variant], latency, BY_HUNDREDTHS)
    return sums.join(found, variant, "left").fillna(0.0, ["p50", "p95", "p99"])


def score_distribution(rows: DataFrame, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """``mean, std`` (of the population), ``low, high``."""
    return rows.groupBy(*keys).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("low"), F.max(score).alias("high"))


def server_metrics(requests: DataFrame) -> DataFrame:
    """``requests, errors, avg_latency, avg_batch`` of rows ``latency_seconds, is_error, batch_size``; averages are 0 without requests."""
    return requests.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.coalesce(F.sum("latency_seconds") / F.count(F.lit(1)), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.avg("batch_size"), F.lit(0.0)).alias("avg_batch"),
    )


def exposition(metrics: DataFrame, prefix: str, uptime: float = 0.0) -> DataFrame:
    """The metrics' row as lines of the text exposition format, in ``body``."""
    series = [
        ("requests_total", "Requests so far.", "counter", F.col("requests").cast("string")),
        ("errors_total", "Errors so far.", "counter", F.col("errors").cast("string")),
        ("latency_seconds", "Mean latency of a request.", "gauge", F.format_string("%.6f", F.col("avg_latency"))),
        ("batch_size", "Mean size of a batch.", "gauge", F.format_string("%.2f", F.col("avg_batch"))),
        ("uptime_seconds", "Time since the start.", "gauge", F.format_string("%.2f", F.lit(float(uptime)))),
    ]
    lines: list[Column] = []
    for name, told, kind, value in series:
        lines += [F.lit(f"# HELP {prefix}_{name} {told}"), F.lit(f"# TYPE {prefix}_{name} {kind}"), F.concat(F.lit(f"{prefix}_{name} "), value)]
    return metrics.select(F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("body"))


def least_loaded(devices: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The healthy device with the fewest requests in flight, the first of several; no row if none is healthy."""
    picked = devices.where("healthy").groupBy(*keys).agg(F.min_by("device_id", F.struct("in_flight", "device_id")).alias("device_id"))
    return picked.where(F.col("device_id").isNotNull())


def within_target(stats: DataFrame, target: float = 20.0) -> DataFrame:
    """``stats`` with ``within_target``: whether half of the requests take at most ``target`` milliseconds."""
    return stats.withColumn("within_target", F.coalesce(F.col("p50") <= target, F.lit(False)))


def observed(scored: DataFrame, name: str = "scores") -> DataFrame:
    """``scored`` as it is; when it runs, its score distribution goes to listeners under ``name``, without a pass of its own."""
    s = F.col("score")
    return scored.observe(name, F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("low"), F.max(s).alias("high"))
