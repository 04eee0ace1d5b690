"""Order within keys without a task for each key: ranges of the sorted rows, and small tables of what each range holds.

Rows are put in ranges by key and order once and written to the shared folder, so that a key with a third of all rows
lies in many ranges, of like size. What depends on a row's place (its number, an order statistic, the last value before
it) is found within its range, and corrected by what the ranges before hold of the same key. Only the key with which a
range begins can have rows in earlier ranges, so these corrections are at most one row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stored

RANGE = "_range"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with the number ``_range`` of their range by keys and order; written once, so that numbers stay.

    Rows that are equal in all of these are dealt by their place in the input.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order, F.monotonically_increasing_id())
    return stored(ranged.withColumn(RANGE, F.spark_partition_id()), "ranges")


def null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Join on keys that may be null, ``b``'s copies dropped. ``small`` says that b has a row for each range at most."""
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"_b_{k}"]) for k in keys]
    return a.join(F.broadcast(b) if small else b, on, how).drop(*[f"_b_{k}" for k in keys])


def totals(ranged: DataFrame, keys: Sequence[str], size: Column | None = None) -> DataFrame:
    """``keys, _range, _n, _before, _total``: rows (or the sum of ``size``) of a key here, in earlier ranges, in all."""
    held = ranged.groupBy(*keys, RANGE).agg((F.count(F.lit(1)) if size is None else F.sum(size)).cast("long").alias("_n"))
    every = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(every.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.select(*keys, RANGE, "_n", before.alias("_before"), F.sum("_n").over(every).alias("_total"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], into: str) -> DataFrame:
    """The rows with their number from 0 within their key, in order; equal rows in any order."""
    ranged = in_ranges(df, keys, order)
    late = totals(ranged, keys).where("_before > 0").select(*keys, RANGE, "_before")
    own = F.row_number().over(W.partitionBy(*keys, RANGE).orderBy(*order)) - 1
    found = null_safe(ranged.withColumn("_own", own), late, [*keys, RANGE], "left", small=True)
    return found.withColumn(into, F.col("_own") + F.coalesce("_before", F.lit(0))).drop("_own", "_before", RANGE)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """``keys`` and an exact quantile for each name, between neighbours in proportion; nulls don't count.

    Equal values are counted before anything is ordered, so that a value which a third of the rows have is one row. Then
    the ranges in which a wanted rank lies, two for each quantile at most, are searched, and no others. A key without
    values has no row.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    return cell_quantiles(cells, keys, "_v", "_w", at)


def cell_quantiles(cells: DataFrame, keys: Sequence[str], value: str, weight: str, at: dict[str, float]) -> DataFrame:
    """:func:`quantiles` of values that are there ``weight`` times; each value once for a key, weights above 0."""
    ranged = in_ranges(cells, keys, [value])
    places = totals(ranged, keys, F.col(weight))
    spot = lambda q: F.lit(float(q)) * (F.col("_total") - 1)
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(spot(q)), F.ceil(spot(q))) for q in at.values()]))
    here = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    wanted = places.withColumn("_ranks", here).where(F.size("_ranks") > 0).select(*keys, RANGE, "_before", "_total", "_ranks")
    run = W.partitionBy(*keys, RANGE).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    found = null_safe(ranged.withColumn("_upto", F.sum(weight).over(run)), wanted, [*keys, RANGE])
    up = F.col("_before") + F.col("_upto")
    found = found.withColumn("_ranks", F.filter("_ranks", lambda r: (r < up) & (r >= up - F.col(weight)))).where(F.size("_ranks") > 0)
    found = found.groupBy(*keys).agg(F.max("_total").alias("_total"), F.map_from_entries(F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r, F.col(value)))))).alias("_values"))  # two entries for each quantile

    def between(q: float) -> Column:
        low, high = F.element_at("_values", F.floor(spot(q))), F.element_at("_values", F.ceil(spot(q)))
        return low + (high - low) * (spot(q) - F.floor(spot(q)))

    return found.select(*keys, *[between(q).alias(name) for name, q in at.items()])


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str) -> DataFrame:
    """The rows with the last ``value`` that isn't null at or before their place within their key, as ``into``.

    Nothing is carried on under a null key beyond its range. Values may be long, so they are joined, not sent: the join is
    by the keys by which the rows are dealt already.
    """
    ranged = in_ranges(df, keys, order)
    run = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = ranged.withColumn(into, F.last(value, ignorenulls=True).over(run))
    # only keys with which a range begins go on from another one: a row for each range
    heads = ranged.groupBy(RANGE).agg(F.min(F.struct(*keys)).alias("_k")).select("_k.*").distinct()
    going = null_safe(ranged, heads, keys, "left_semi", small=True)
    last = going.groupBy(*keys, RANGE).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_value"))
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    earlier = last.select(*keys, RANGE, F.last("_value", ignorenulls=True).over(before).alias("_earlier")).where("_earlier is not null")
    return own.join(earlier, [*keys, RANGE], "left").withColumn(into, F.coalesce(into, "_earlier")).drop("_earlier", RANGE)
