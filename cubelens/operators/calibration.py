"""Reliability tables and calibration errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_index(p: Column, bins: int = 10) -> Column:
    """Bin of a probability by edges i * (1 / bins) as doubles, left-closed, the last bin closed."""
    index = F.lit(0)
    for i in range(1, bins):
        index = index + (p >= F.lit(i * (1.0 / bins))).cast("int")
    return index


def table(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``keys, bin, bin_left, bin_right, mean_pred, obs_rate, count`` of the bins that have rows (keys, y, p)."""
    found = rows.where("y is not null and p is not null").withColumn("bin", bin_index(F.col("p"), bins))
    found = found.groupBy(*keys, "bin").agg(F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate"), F.count(F.lit(1)).alias("count"))
    width = F.lit(1.0 / bins)
    return found.select(*keys, "bin", (F.col("bin") * width).alias("bin_left"), ((F.col("bin") + 1) * width).alias("bin_right"), "mean_pred", "obs_rate", "count")


def summary(rows: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """``keys, n, brier, ece, mce, positive_rate``: one aggregate by bin, one over the bins."""
    found = rows.where("y is not null and p is not null").withColumn("bin", bin_index(F.col("p"), bins))
    found = found.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    gap = F.abs(F.col("sp") / F.col("c") - F.col("sy") / F.col("c"))
    return found.groupBy(*keys).agg(
        F.sum("c").alias("n"), (F.sum("sq") / F.sum("c")).alias("brier"), (F.sum(gap * F.col("c")) / F.sum("c")).alias("ece"), F.max(gap).alias("mce"), (F.sum("sy") / F.sum("c")).alias("positive_rate"),
    )
