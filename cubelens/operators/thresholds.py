"""Threshold sweeps, best thresholds and fixed tiers, all from a histogram of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scores import safe_divide
from . import metrics


def _at(rows: DataFrame, keys: list[str], levels: list[int]) -> DataFrame:
    """Confusion counts at each threshold: a histogram of at most 22 cells a group, then the levels."""
    hist = rows.where("y is not null and bucket is not null").groupBy(*keys, "y", "bucket").agg(F.count(F.lit(1)).alias("c"))
    hist = hist.withColumn("threshold", F.explode(F.array(*map(F.lit, levels))))
    yes, pos = F.col("bucket") >= F.col("threshold"), F.col("y") == 1
    parts = {"tp": pos & yes, "fp": ~pos & yes, "tn": ~pos & ~yes, "fn": pos & ~yes}
    return hist.groupBy(*keys, "threshold").agg(F.sum("c").alias("n"), *[F.sum(F.when(t, F.col("c")).otherwise(0)).alias(k) for k, t in parts.items()])


def sweep(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, threshold`` 0 to 10 and macro-F1, precision, recall, MCC, positives and n, from rows (keys, y, bucket)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _at(rows, keys, list(range(11))).select(
        *keys, "threshold", metrics.macro_f1().alias("macro_f1"), safe_divide(tp, tp + fp).alias("precision"), safe_divide(tp, tp + fn).alias("recall"),
        metrics.mcc().alias("mcc"), (tp + fp).alias("positives_predicted"), F.col("n").alias("n_eval"),
    )


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The threshold with the best macro-F1, then MCC, then precision, then the smallest; compared rounded to 12 places."""
    order = W.partitionBy(*keys).orderBy(*[F.round(c, 12).desc() for c in ("macro_f1", "mcc", "precision")], "threshold")
    found = sweep(rows, keys).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return found.select(*keys, F.col("threshold").alias("best_threshold"), F.col("macro_f1").alias("best_macro_f1"), F.col("mcc").alias("mcc_at_best"), F.col("precision").alias("precision_at_best"), F.col("recall").alias("recall_at_best"), "n_eval")


def fixed_tiers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, threshold_label, threshold`` and eight metrics with AUROC (null with one class) at the three tiers."""
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    right = safe_divide(tp + tn, n)
    label = F.coalesce(*[F.when(F.col("threshold") == t, F.lit(f"{name} ({t}+)")) for name, t in K.TIERS])
    found = _at(rows, keys, [t for _, t in K.TIERS]).select(
        *keys, label.alias("threshold_label"), "threshold", right.alias("accuracy"), safe_divide(tp, tp + fp).alias("precision"), safe_divide(tp, tp + fn).alias("recall"),
        right.alias("micro_f1"), metrics.macro_f1().alias("macro_f1"), metrics.mcc().alias("mcc"), n.alias("n_eval"),
    )
    area = metrics.auc(rows.where("y is not null and bucket is not null"), keys, "y", "bucket").withColumnRenamed("auc", "auroc")
    return metrics._null_safe_join(found, area, keys)


def tier_pivot(tiers: DataFrame, model: str = "model_canon") -> DataFrame:
    """Mean macro-F1 of each model at each tier, wide."""
    names = [f"{name} ({t}+)" for name, t in K.TIERS]
    return tiers.groupBy(model).pivot("threshold_label", names).agg(F.avg("macro_f1"))
