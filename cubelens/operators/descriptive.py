"""Cohort, processing and missingness summaries, and descriptive statistics with t intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonrepair, scores, stats
from ..functions.scores import count_percent
from ..roles import DEFAULT, Roles
from ..sources.scratch import stored
from . import metrics, ranges


def cohort(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``metric, value``: the number of rows, and of distinct values of each column (nulls don't count)."""
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(m) for m, c in columns.items()])
    return wide.unpivot([], ["rows", *columns], "metric", "value")


def parse_summary(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Outcome of parsing by folder, as ``x/y (z%)`` and as percents; sorted by nothing, a row for each folder."""
    tag = lambda t: F.count_if(F.col("json_repair_type") == t).alias(f"_{t}")
    blank = F.trim(F.coalesce("full_response", F.lit(""))) == ""
    raw = scores.number(F.col(roles.score))
    found = df.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(roles.subject).alias("_subjects"), F.count_if(blank).alias("_none"),
        F.sum(F.coalesce(F.col("json_schema_valid").cast("int"), F.lit(0))).alias("_valid"), F.count_if(raw >= 5).alias("_high"), *[tag(t) for t in jsonrepair.TAGS],
    ).where("folder is not null")
    n = F.col("n_rows")
    good = F.col("_raw_valid_json") + F.col("_extracted_embedded_json") + F.col("_repaired_json")
    share = lambda c: F.lit(100.0) * c / n
    text = {
        "unique_patients": F.col("_subjects"), "raw_valid_json": F.col("_raw_valid_json"), "extracted_embedded_json": F.col("_extracted_embedded_json"),
        "repaired_json": F.col("_repaired_json"), "schema_invalid": F.col("_schema_invalid"), "unparseable": F.col("_unparseable"),
        "no_repair_needed": F.col("_raw_valid_json"), "JSON_repaired": F.col("_repaired_json"), "no_response": F.col("_none"),
        "total_successful": good, "schema_valid_total": F.col("_valid"), "IBD_predicted_ge_5": F.col("_high"),
    }
    return found.select(
        "folder", F.lit("ok").alias("status"), *[count_percent(c, n).alias(k) for k, c in text.items()], share(good).alias("total_success_percent"),
        share(F.col("_raw_valid_json")).alias("no_repair_percent"), share(F.col("_valid")).alias("schema_valid_percent"), share(F.col("_high")).alias("percent_ge_5"),
        "n_rows", F.col("_empty").alias("n_empty_responses"),
    )


def merge_summary(parsed: DataFrame, merged: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Input rows, duplicates, merged rows and failed calls by folder."""
    failed = F.trim(F.coalesce("full_response", F.lit(""))).isin("", "{}") | (F.coalesce("json_parse_success", F.lit(0)) == 0)
    a = parsed.where("folder is not null").groupBy("folder").agg(F.count(F.lit(1)).alias("input_rows"), F.count_distinct(roles.subject).alias("post_dedup_rows"), F.count_if(failed).alias("api_failures"))
    b = merged.groupBy("folder").agg(F.count(F.lit(1)).alias("_merged"))
    return a.join(b, "folder", "left").select(
        "folder", F.concat("folder", F.lit("_merged.parquet")).alias("output"), "input_rows", F.greatest(F.col("input_rows") - F.col("post_dedup_rows"), F.lit(0)).alias("duplicates_dropped"),
        F.coalesce("_merged", "post_dedup_rows").alias("merged_rows"), "post_dedup_rows", "api_failures", F.lit("ok").alias("status"), F.lit("").alias("error"),
    )


def parse_outcomes(df: DataFrame, by: str = "source_parent") -> DataFrame:
    return df.groupBy(by, (F.col("json_parse_success") == 1).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


def statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys`` and mean, sd, n, t interval, median, IQR, corrected skew and kurtosis of a column's numbers.

    The numbers are written once, so that the input is run once; moments are one aggregate of them, and the quartiles
    are found in ranges of the sorted values, without a buffer of a group's values.
    """
    rows = stored(df.select(*keys, scores.number(F.col(value)).alias("_v")).where("_v is not null"), "statistics")
    found = rows.groupBy(*keys).agg(
        F.avg("_v").alias("mean"), F.coalesce(F.stddev_samp("_v"), F.lit(0.0)).alias("std_dev"), F.count("_v").alias("n"),
        stats.skewness("_v").alias("skewness"), stats.kurtosis("_v").alias("kurtosis"),
    )
    quartiles = ranges.quantiles(rows, keys, "_v", {"_q25": 0.25, "median": 0.5, "_q75": 0.75})
    found = ranges.null_safe(found, quartiles, keys)
    half = F.when((F.col("n") > 1) & (F.col("std_dev") > 0), stats.t_quantile_of(0.975, F.col("n") - 1) * F.col("std_dev") / F.sqrt("n")).otherwise(0.0)
    return found.select(*keys, "mean", "std_dev", "n", (F.col("mean") - half).alias("ci_lower"), (F.col("mean") + half).alias("ci_upper"), "median", (F.col("_q75") - F.col("_q25")).alias("iqr"), "skewness", "kurtosis")


def with_strings(table: DataFrame) -> DataFrame:
    """The statistics with ``mean% (lo%–hi%)`` and ``median% [iqr]``."""
    return table.withColumns({"percent_ci": F.format_string("%.1f%% (%.1f%%–%.1f%%)", "mean", "ci_lower", "ci_upper"), "median_iqr": F.format_string("%.1f%% [%.1f]", "median", "iqr")})


def breakdown(folders: DataFrame, measures: list[str]) -> DataFrame:
    """``attribute_type, attribute_value, metric`` and statistics of folder percents, each attribute on its fair rows."""
    fair = {"shot": ("temp", "seq"), "model": ("zero", "temp", "seq"), "temperature": ("zero", "seq"), "data_type": ("zero", "temp")}
    from .. import constants as K

    test = {"zero": F.col("shot") == K.ZERO_SHOT, "temp": F.col("temperature").isin("0_50", "0_60", "0_75", "1_00"), "seq": F.col("data_type").isin(*K.FAIR_SEQUENCES)}
    rows = folders.withColumns(scores.folder_parts(F.col("folder")))
    pairs = [F.when(reduce(lambda a, b: a & b, [test[t] for t in ts]), F.struct(F.lit(a).alias("attribute_type"), F.col(a).alias("attribute_value"))) for a, ts in fair.items()]
    rows = rows.withColumn("_p", F.explode(F.array_compact(F.array(*pairs)))).select("_p.*", *measures)
    long = rows.unpivot(["attribute_type", "attribute_value"], measures, "metric", "_x")
    return statistics(long, ["attribute_type", "attribute_value", "metric"], "_x")


def missingness(df: DataFrame) -> DataFrame:
    """``column, pct_missing`` of every column, rounded to two places."""
    wide = df.agg(*[F.bround(F.avg(F.col(c).isNull().cast("int")) * 100, 2).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column", "pct_missing")


def numeric_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` with exact quartiles; null for a column without values."""
    long = df.select(*[scores.number(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "column", "x")
    long = stored(long, "describe")
    found = long.groupBy("column").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    quartiles = ranges.quantiles(long, ["column"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return found.join(quartiles, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def score_means(df: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    cells = {"likelihood_mean": roles.score, "certainty_mean": roles.certainty, "complexity_mean": roles.complexity}
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(scores.number(F.col(c))).alias(k) for k, c in cells.items()])


def _dropped(roles: Roles) -> Column:
    return reduce(lambda a, b: a | b, [scores.number(F.col(c)).isNull() for c in (roles.score, roles.certainty, roles.complexity)])


def dropout(df: DataFrame, sets: list[list[str]], roles: Roles = DEFAULT) -> DataFrame:
    """``level`` (the grouping's columns), its keys and ``dropout_pct``: rows that lack a score, as grouping sets."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    grouped = df.groupingSets(sets, *keys).agg(F.avg(_dropped(roles).cast("int")).alias("_d"), *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    level = F.concat_ws("+", *[F.when(F.col(f"_g_{k}") == 0, F.lit(k)) for k in keys])
    return grouped.select(level.alias("level"), *keys, (F.col("_d") * 100).alias("dropout_pct"))


def bucket_summary(rows: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """``keys, bucket, accuracy, mean_certainty, mean_complexity, observed_rate, n`` of rows with truth and bucket."""
    right = (scores.prediction(F.col("bucket")) == F.col("y")).cast("int")
    return rows.where("y is not null and bucket is not null").groupBy(*keys, "bucket").agg(
        F.avg(right).alias("accuracy"), F.avg(scores.number(F.col(roles.certainty))).alias("mean_certainty"),
        F.avg(scores.number(F.col(roles.complexity))).alias("mean_complexity"), F.avg("y").alias("observed_rate"), F.count(F.lit(1)).alias("n"),
    )


def certainty_f1(rows: DataFrame, keys: list[str], roles: Roles = DEFAULT) -> DataFrame:
    """Macro-F1 by certainty, rounded half-even and held to 1 to 10."""
    c = F.greatest(F.lit(1), F.least(F.lit(10), F.bround(scores.number(F.col(roles.certainty))).cast("int")))
    found = rows.where("y is not null and bucket is not null").where(F.col(roles.certainty).isNotNull())
    found = found.withColumns({"certainty_bucket": c, "p": scores.prediction(F.col("bucket")).cast("double")})
    table = found.groupBy(*keys, "certainty_bucket").agg(*metrics.counts())
    return table.select(*keys, "certainty_bucket", metrics.macro_f1().alias("macro_f1"), "n")
