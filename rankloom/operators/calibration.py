"""Calibration of scores: expected error, and fitting of Platt's curve."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.errors import CalibrationError


def expected_calibration_error(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``ece``: over bins of equal width of ``prob``, the mean gap to ``label`` (boolean), weighed by rows; 0 without rows."""
    if bins < 1:
        raise CalibrationError("at least one bin is needed")
    bin_ = F.least(F.floor(F.col("prob") * bins).cast("int"), F.lit(bins - 1))
    per = pairs.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("prob").alias("p"), F.sum(F.col("label").cast("double")).alias("y"))
    return per.agg(F.coalesce(F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def fit_platt(pairs: DataFrame, steps: int = 100) -> tuple[float, float]:
    """``a, b`` of 1 / (1 + e^(a score + b)) from ``score, label``, by Newton's method on smoothed targets.

    A step is one aggregation of five sums; rows never leave the executors. Fewer than ten rows or a null are errors.
    """
    data = pairs.select(F.col("score").cast("float").cast("double").alias("f"), F.col("label").cast("boolean").alias("y"))
    n, pos, bad = data.agg(F.count(F.lit(1)), F.count_if("y"), F.count_if(F.col("f").isNull() | F.col("y").isNull())).first()
    if n < 10:
        raise CalibrationError(f"at least 10 samples are needed, there are {n}")
    if bad:
        raise CalibrationError(f"{bad} samples lack a score or a label")
    neg = n - pos
    target = F.when(F.col("y"), (pos + 1.0) / (pos + 2.0)).otherwise(1.0 / (neg + 2.0))
    data = data.select("f", target.alias("t")).persist()
    a, b = 0.0, math.log((neg + 1.0) / (pos + 1.0))
    try:
        for _ in range(steps):
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("f") * a + b))
            rows = data.select("f", p.alias("p"), (F.col("t") - p).alias("d")).withColumn("w", F.col("p") * (F.lit(1.0) - F.col("p")))
            f = F.col("f")
            h11, h22, h21, g1, g2 = rows.agg(F.sum(f * f * F.col("w")), F.sum("w"), F.sum(f * F.col("w")), F.sum(f * F.col("d")), F.sum("d")).first()
            h11, h22 = h11 + 1e-3, h22 + 1e-3
            det = h11 * h22 - h21 * h21
            if abs(det) < 1e-15:
                break
            da, db = (h21 * g2 - h22 * g1) / det, (h21 * g1 - h11 * g2) / det
            a, b = a + da, b + db
            if abs(da) < 1e-5 and abs(db) < 1e-5:
                break
    finally:
        data.unpersist()
    return a, b
