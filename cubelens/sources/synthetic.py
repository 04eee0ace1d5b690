"""A synthetic corpus of subjects, dated documents and labels, reproducible from a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(seed: int, name: str, *key: str) -> Column:
    """A number in [0, 1) that depends on seed, name and key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *key), F.lit(1 << 40)) / float(1 << 40)


def patients(spark: SparkSession, n: int = 60, seed: int = 7) -> DataFrame:
    """Half of the subjects are positive; sites and age groups in turn."""
    i = F.col("id")
    pick = lambda values, c: F.array(*map(F.lit, values))[c.cast("int")]
    return spark.range(n).select(
        F.format_string("PT%05d", i + 1).alias("patient_id"), (i % 2).cast("int").alias("ground_truth"),
        pick(["18-29", "30-44", "45-59", "60-74", "75+"], F.floor(_u(seed, "age", "id") * 5)).alias("age_group"), pick(["F", "M"], F.floor(_u(seed, "sex", "id") * 2)).alias("sex"), pick(["north", "south", "east"], i % 3).alias("site"),
    )


def document_flags(people: DataFrame, seed: int = 7) -> DataFrame:
    """Marker columns that mostly follow the label; some are unknown."""
    def flag(name: str, right: float, known: float) -> Column:
        agree = F.when(_u(seed, name, "patient_id") < right, F.col("ground_truth")).otherwise(1 - F.col("ground_truth"))
        return F.when(_u(seed, f"{name}-known", "patient_id") < known, agree)

    rates = {"preceding_clinic_ibd_flag": (0.8, 0.9), "following_clinic_ibd_flag": (0.85, 0.9), "endoscopy_ibd_flag": (0.9, 0.97), "histology_ibd_flag": (0.95, 0.97)}
    return people.withColumns({c: flag(c, *r) for c, r in rates.items()})


def sources(people: DataFrame, seed: int = 7) -> dict[str, DataFrame]:
    """Primary reports, secondary reports and two notes for each subject."""
    start = F.lit("2024-01-01 09:00:00").cast("timestamp_ntz")
    shifted = lambda c: start + F.make_dt_interval(c.cast("int"))
    day = F.floor(_u(seed, "day", "patient_id") * 365)
    say = F.when(F.col("ground_truth") == 1, "active inflammation with ulceration").otherwise("normal mucosa, no evidence of disease")
    base = people.select("patient_id", day.alias("d"), say.alias("finding"))
    notes = base.withColumn("k", F.explode(F.array(F.lit(-20), F.lit(15))))
    return {
        "secondary": base.select("patient_id", shifted(F.col("d")).alias("procedure_date"), F.concat(F.lit("Colonoscopy: "), "finding").alias("Combined_Content")),
        "primary": base.select("patient_id", shifted(F.col("d") + 1).alias("sample_received_date"), F.concat(F.lit("Biopsy: "), "finding").alias("result_report")),
        "notes": notes.select("patient_id", shifted(F.col("d") + F.col("k")).alias("date_creation"), F.concat(F.lit("Clinic: "), "finding").alias("clean_content")),
    }


def batch(people: DataFrame, runner: str, experiment: str, accuracy: float = 0.8, seed: int = 7) -> DataFrame:
    """A wide batch of one runner and experiment: 5 % without a response, 7 % with text around the JSON."""
    key = F.concat_ws("|", "patient_id", F.lit(runner), F.lit(experiment))
    rows = people.withColumn("key", key)
    right = _u(seed, "right", "key") < accuracy
    positive = F.when(right, F.col("ground_truth")).otherwise(1 - F.col("ground_truth")) == 1
    score = F.when(positive, 6 + F.floor(_u(seed, "score", "key") * 5)).otherwise(F.floor(_u(seed, "score", "key") * 5))
    body = F.to_json(F.struct(
        F.lit("Summary").alias("Title"), F.array(F.lit("finding a"), F.lit("finding b")).alias("Features"), score.cast("int").alias("Likelihood of IBD"),
        (4 + F.floor(_u(seed, "cert", "key") * 7)).cast("int").alias("Certainty Level"), F.floor(_u(seed, "cplx", "key") * 11).cast("int").alias("Complexity of Case"),
    ))
    state = _u(seed, "state", "key")
    said = F.when(state < 0.05, "").when(state < 0.12, F.concat(F.lit("The answer: "), body)).otherwise(body)
    return rows.select("patient_id", said.alias(f"{runner}_Full_Response_{experiment}"), F.when(state >= 0.12, body).alias(f"{runner}_Json_Response_{experiment}"), F.lit("").alias(f"{runner}_Payload_{experiment}"), (_u(seed, "cut", "key") < 0.05).alias(f"Truncated_{experiment}"))
