"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialised, small


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or not larger) neighbours are tied to the smallest of its neighbours and itself. A node's neighbours are
    reduced to their minimum by partial sums, which is written; the join with it then has no sum in its stage, and a node of very
    many neighbours is split like any skewed key."""
    there = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m"))
    if large:
        there = there.unionByName(there.select(F.col("m").alias("n"), F.col("n").alias("m")))
    least = there.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low")).withColumnRenamed("n", "_n")
    least = materialised(least, "least")
    met = there.join(small(least), F.col("n") == F.col("_n"))
    if large:
        out = met.where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("low").alias("v"))
    else:
        out = met.select(F.col("m").alias("u"), F.col("low").alias("v")).unionByName(least.select(F.col("_n").alias("u"), F.col("low").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of an edge ``u, v``; the root is the component's smallest node. Loops and nulls are left out."""
    now = materialised(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == mark or state[0] == 0:
            break
        mark = state
        now = materialised(_stars(_stars(now, large=True), large=False), "edges")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
