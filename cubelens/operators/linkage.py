"""Linking dated documents of a subject: band join, keep-best and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges

MISSING = "NOT_AVAILABLE"


def days_between(late: Column, early: Column) -> Column:
    """Whole days from early to late, rounded down; negative where late comes first."""
    micros = F.timestamp_diff("MICROSECOND", early, late)
    return F.floor(micros / F.lit(86400000000.0)).cast("long")


def band_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, days: int, into: str = "date_diff") -> DataFrame:
    """Inner join on the key where the times are at most ``days`` whole days apart; the distance is added.

    Time is cut into spans longer than the band, and a left row meets the right rows of its span and the two beside it:
    a key with very many rows is dealt by span, and only rows that are near in time are compared. Null times match none.
    """
    span = (days + 2) * 86_400_000_000  # a day more than the band, for clocks that are put on or back
    at = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(span))
    spread = left.withColumn("_span", F.explode(F.array(*[at(F.col(left_time)) + k for k in (-1, 0, 1)])))
    r = right.withColumnRenamed(key, "_key").withColumn("_right_span", at(F.col(right_time)))
    gap = F.abs(days_between(spread[left_time], r[right_time]))
    joined = spread.join(r, (spread[key] == r["_key"]) & (spread["_span"] == r["_right_span"]) & (gap <= days)).drop("_key", "_span", "_right_span")
    return joined.withColumn(into, F.abs(days_between(F.col(left_time), F.col(right_time))))


def keep_best(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in that order."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: dict[str, str],
    direction: str = "backward", window_days: int | None = None, order: str | None = None,
) -> DataFrame:
    """Each left row with the nearest right row on one side of it, or nulls; repeated left rows stay.

    Backward takes the latest row that lies before (whole days below 0, that is any earlier instant), forward the
    earliest at least 24 hours after (whole days above 0). ``values`` maps right columns to output names; of right rows of
    equal time the one with the least ``order``. Beyond ``window_days`` there is none.

    Both sides are one stream by time, and the last right value is carried on. The stream is cut into ranges by subject
    and time, so that a subject with half of all rows is dealt to many tasks and none meets all pairs of its rows.
    """
    ahead = direction == "forward"
    sign, shift = (-1, 86_400_000_000) if ahead else (1, 0)
    at = lambda c, more=0: F.lit(sign) * (F.unix_micros(F.col(c).cast("timestamp")) + F.lit(more))
    taken = F.struct(*[F.col(c).alias(v) for c, v in values.items()], F.col(right_time).alias("_at"))
    rank = -F.col(order) if order else F.lit(0)
    a = left.select(F.col(key).alias("_k"), at(left_time, shift).alias("_t"), F.lit(int(ahead)).alias("_side"), F.lit(0).cast("long").alias("_o"), F.struct(*left.columns).alias("_row"))
    b = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), at(right_time).alias("_t"), F.lit(int(not ahead)).alias("_side"), rank.cast("long").alias("_o"), taken.alias("_value"))
    # a left row without a key or time comes before all right rows, so that it meets none
    both = a.unionByName(b.where("_k is not null"), allowMissingColumns=True)
    found = ranges.carried(both, ["_k"], ["_t", "_side", "_o"], "_value", "_last").where("_row is not null")
    if window_days is not None:
        near = F.abs(days_between(F.col("_last._at"), F.col(f"_row.{left_time}"))) <= window_days
        found = found.withColumn("_last", F.when(near, F.col("_last")))
    return found.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values.values()])


def chronology(primary: DataFrame, secondary: DataFrame, notes: DataFrame, band_days: int = 2, window_days: int | None = None, max_cases: int | None = None) -> DataFrame:
    """Thirteen columns, a row for each subject and procedure date.

    primary (patient_id, sample_received_date, result_report), secondary (patient_id, procedure_date,
    Combined_Content), notes (patient_id, date_creation, clean_content). The report with the least day distance, then
    the earliest, is kept; the letters before and after are as-of joins.
    """
    linked = band_join(secondary, primary, "patient_id", "procedure_date", "sample_received_date", band_days)
    linked = keep_best(linked, ["patient_id", "procedure_date"], ["date_diff", "sample_received_date", "result_report"])
    out = linked
    for side, direction in (("preceding", "backward"), ("following", "forward")):
        values = {"clean_content": f"{side}_clinic_letter", "date_creation": f"{side}_clinic_date"}
        out = asof_join(out, notes, "patient_id", "procedure_date", "date_creation", values, direction, window_days)
    day = F.date_format("procedure_date", "yyyy-MM-dd")
    out = out.withColumns({
        "episode_id": F.concat_ws("::", "patient_id", day),
        "preceding_clinic_time_diff": days_between(F.col("procedure_date"), F.col("preceding_clinic_date")),
        "following_clinic_time_diff": days_between(F.col("following_clinic_date"), F.col("procedure_date")),
        "preceding_clinic_letter": F.coalesce("preceding_clinic_letter", F.lit(MISSING)),
        "following_clinic_letter": F.coalesce("following_clinic_letter", F.lit(MISSING)),
    })
    out = out.select(
        "patient_id", "episode_id", "procedure_date", "sample_received_date", "result_report", "Combined_Content", "preceding_clinic_letter", "following_clinic_letter",
        "preceding_clinic_date", "following_clinic_date", "preceding_clinic_time_diff", "following_clinic_time_diff", "date_diff",
    )
    return out.orderBy("patient_id", "procedure_date").limit(max_cases) if max_cases else out


def merge_reference(outputs: DataFrame, reference: DataFrame, key: str = "patient_id") -> tuple[DataFrame, DataFrame]:
    """(reference left-joined with the outputs, counts as ``metric, value``); outputs' clashing columns end in ``_llm``."""
    clash = {c: f"{c}_llm" for c in outputs.columns if c in reference.columns and c != key}
    right = outputs.withColumnsRenamed(clash).withColumn("_matched", F.lit(1))
    merged = reference.join(right, key, "left")
    counts = merged.agg(F.count(F.lit(1)).alias("merged_rows"), F.count("_matched").alias("matched_rows"))
    counts = counts.crossJoin(reference.agg(F.count(F.lit(1)).alias("reference_rows"))).crossJoin(outputs.agg(F.count(F.lit(1)).alias("parsed_rows")))  # one row each
    return merged.drop("_matched"), counts.unpivot([], ["reference_rows", "parsed_rows", "merged_rows", "matched_rows"], "metric", "value")
