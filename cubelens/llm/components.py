"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours go to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    down = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """``u, v`` with v the least node of u's component, for each u that isn't it; from edges ``a, b`` of longs.

    Every round is written to the shared folder. Loops are left out; no edges give no rows.
    """
    held = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    held = common.stored(held, "edges")
    before = _mark(held)
    while before[0]:
        held = common.stored(_small(_large(held)), "edges")
        after = _mark(held)
        if after == before:
            break
        before = after
    return held
