"""Views that rebuild endpoints from single-document rows: cumulative, per subject, and their dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..roles import DEFAULT, Roles

TEXTS = ("full_response", "json_response", "payload", "clues_text", "reasoning_text", "Title", "Features", "Combined_Content", "result_report")
GROUP = ("runner_name", "model", "display_model")


def unique_text(order: str, column: str) -> Column:
    """The group's distinct texts that aren't blank, first seen first, an empty line between them."""
    text = F.col(column).cast("string")
    rows = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(order).alias("o"), text.alias("t")))))
    return F.array_join(F.array_distinct(F.transform(rows, lambda r: r["t"])), "\n\n")


def _collapsed(rows: DataFrame, keys: list[str], roles: Roles) -> DataFrame:
    """One row for each key: the columns of the row with the highest bucket (then the first), and the group's own."""
    rest = [c for c in rows.columns if c not in (*keys, "_bucket", *TEXTS, "json_parse_success", "json_schema_valid", "response_tokens", roles.truncated)]
    aggs = [F.max_by(F.struct(*rest), F.struct(F.coalesce("_bucket", F.lit(-1)), -F.col(roles.order))).alias("_w"), F.max("_bucket").alias("_best")]
    aggs += [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in ("json_parse_success", "json_schema_valid") if c in rows.columns]
    if roles.truncated in rows.columns:
        aggs.append(F.bool_or(F.coalesce(F.col(roles.truncated), F.lit(False))).alias(roles.truncated))
    if "response_tokens" in rows.columns:
        aggs.append(F.sum(F.coalesce("response_tokens", F.lit(0))).alias("response_tokens"))
    aggs += [unique_text(roles.order, c).alias(c) for c in TEXTS if c in rows.columns]
    made = [c for c in rows.columns if c in (*TEXTS, "json_parse_success", "json_schema_valid", "response_tokens", roles.truncated)]
    out = rows.groupBy(*keys).agg(*aggs)
    winner = [F.col("_best").cast("double").alias(roles.score) if c == roles.score else F.col(f"_w.{c}").alias(c) for c in rest]
    return out.select(*keys, *winner, *made)


def _components(df: DataFrame, roles: Roles) -> DataFrame:
    rows = df.where(F.col(roles.sequence).isin(*K.SINGLE_DOCUMENT))
    return rows.withColumn("_bucket", scores.clean_likelihood(F.col(roles.score)))


def _keys(df: DataFrame, roles: Roles) -> list[str]:
    return [c for c in (roles.subject, *GROUP, roles.model, roles.shot, roles.temperature) if c in df.columns]


def cumulative(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """For each subject and configuration a row for each document set, from the set's single-document rows.

    Without single-document rows the direct rows of those sets stay as they are.
    """
    rows = _components(df, roles)
    if rows.isEmpty():
        return df.where(F.col(roles.sequence).isin(*K.MULTI_DOCUMENT))
    of = {s: [m for m in K.MULTI_DOCUMENT if d in K.DOCUMENT_SETS[m]] for s, d in K.SINGLE_DOCUMENT.items()}
    sets = F.coalesce(*[F.when(F.col(roles.sequence) == s, F.array(*map(F.lit, ms))) for s, ms in of.items()])
    rows = rows.withColumn("_set", F.explode(sets)).drop(roles.sequence).withColumnRenamed("_set", roles.sequence)
    return _collapsed(rows, [*_keys(df, roles), roles.sequence], roles).select(*[c for c in df.columns])


def per_subject(df: DataFrame, roles: Roles = DEFAULT, final_truth: bool = False, document_truth: str = "patient_truth", chart_truth: str = "ground_truth") -> DataFrame:
    """One row for each subject and configuration, named by the patient sequence, with the truth of the endpoint."""
    rows = _components(df, roles)
    if rows.isEmpty():
        rows = df.withColumn("_bucket", scores.clean_likelihood(F.col(roles.score)))
    keys = _keys(df, roles)
    out = _collapsed(rows, keys, roles).withColumn(roles.sequence, F.lit(K.PATIENT_SEQUENCE))
    if roles.experiment in out.columns:
        out = out.withColumn(roles.experiment, F.lit("final_patient"))
    out = out.withColumn("is_primary_configuration", scores.is_primary(F.col(roles.model), F.col(roles.temperature), F.col(roles.shot)))
    source = document_truth if final_truth else chart_truth
    if source not in rows.columns:
        return out
    truth = rows.groupBy(*keys).agg(F.max(source).cast("double").alias("_truth")).withColumnsRenamed({k: f"_{k}" for k in keys})
    out = out.join(truth, [out[k].eqNullSafe(truth[f"_{k}"]) for k in keys]).drop(*[f"_{k}" for k in keys])
    return out.withColumns({roles.truth: F.col("_truth"), chart_truth: F.col("_truth")}).drop("_truth")


def validation_view(df: DataFrame, level: str, roles: Roles = DEFAULT) -> DataFrame:
    """The rows of a validation level: document, cumulative, final or doc2patient; any other level changes nothing."""
    if level == "document":
        return df.where(F.col(roles.sequence).isin(*K.SINGLE_DOCUMENT))
    if level == "cumulative":
        return cumulative(df, roles)
    if level in ("final", "doc2patient"):
        return per_subject(df, roles, level == "final")
    return df
