"""A/B tests over time: configurations in force from a moment on, and the requests they apply to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import md5_bucket


def configuration(a: Column, b: Column, retain: Column) -> Column:
    """Weights ``a, b`` and whether the test is on. A stopped test retains one variant, which then takes all requests."""
    on = retain.isNull()
    return F.struct(
        F.when(on, a).when(retain == "a", 1).otherwise(0).cast("long").alias("a"),
        F.when(on, b).when(retain == "a", 0).otherwise(1).cast("long").alias("b"),
        on.alias("active"),
    )


def configured(requests: DataFrame, configs: DataFrame, keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``requests`` (``name, at, ...``) with the last of ``configs`` (``name, at, weight_a, weight_b, retain``) at or before their time.

    Both go through one sort by key and time, configurations first, and each request takes the last one above it: one shuffle, no
    join of ranges. A request before any configuration has none: the test is inactive until configured.
    """
    marks = configs.select(*keys, "at", configuration(F.col("weight_a"), F.col("weight_b"), F.col("retain")).alias("config"), F.lit(None).cast(requests.select(F.struct(*requests.columns).alias("r")).schema["r"].dataType).alias("r"))
    asked = requests.select(*keys, "at", F.lit(None).cast(marks.schema["config"].dataType).alias("config"), F.struct(*requests.columns).alias("r"))
    order = Window.partitionBy(*keys).orderBy("at", F.col("r").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).withColumn("config", F.last("config", ignorenulls=True).over(order))
    return both.where(F.col("r").isNotNull()).select("r.*", "config")


def variant(key: Column, config: Column) -> Column:
    """The variant of a configured request, by hash; null without a configuration, ``a`` if nothing has weight."""
    total = config["a"] + config["b"]
    part = F.pmod(md5_bucket(key, 2**31), F.greatest(total, F.lit(1)))
    return F.when(config.isNull(), None).when(total == 0, "a").when(part < config["a"], "a").otherwise("b")
