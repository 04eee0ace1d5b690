"""Tier tables: document, cumulative, final and doc2patient, by configuration or by model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..roles import DEFAULT, Roles
from . import metrics, truth

POLICIES = ("all_attempts", "complete_case")


def _rows(df: DataFrame, roles: Roles, label: str) -> DataFrame:
    out = df.withColumn("y", F.col(label).cast("int")).where("y is not null")
    return out.withColumn("bucket", scores.clean_likelihood(F.col(roles.score))).withColumn("p", scores.probability(F.col("bucket"))).withColumn(roles.temperature, scores.round_temperature(F.col(roles.temperature)))


def document_rows(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return metrics.policy_rows(_rows(truth.tier_truths(df, roles).where("tier = 'document'"), roles, "document_truth"), roles, POLICIES)


def cumulative_rows(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    return metrics.policy_rows(_rows(truth.tier_truths(df, roles).where("tier = 'cumulative'"), roles, "cumulative_truth"), roles, POLICIES)


def subject_votes(df: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """``denominator, subject, model, shot, temperature, bucket, p``: the highest bucket of a subject's single documents."""
    rows = df.where(F.col(roles.sequence).isin(*K.SINGLE_DOCUMENT))
    rows = rows.withColumn("bucket", scores.clean_likelihood(F.col(roles.score))).withColumn(roles.temperature, scores.round_temperature(F.col(roles.temperature)))
    rows = metrics.policy_rows(rows.withColumn("p", F.lit(0.0)), roles, POLICIES)
    votes = rows.groupBy("denominator", roles.subject, roles.model, roles.shot, roles.temperature).agg(F.max("bucket").alias("bucket"))
    return votes.withColumn("p", F.coalesce(scores.probability(F.col("bucket")), F.lit(0.0)))


def subject_rows(df: DataFrame, label: str, roles: Roles = DEFAULT) -> DataFrame:
    """Subject votes with each subject's label (of its rows the highest that is known)."""
    labels = df.groupBy(roles.subject).agg(F.max(F.col(label).cast("int")).alias("y")).where("y is not null")
    return subject_votes(df, roles).join(labels, roles.subject)


def tables(rows: DataFrame, roles: Roles = DEFAULT, per_sequence: bool = False, per_model: bool = False) -> DataFrame:
    """The eight metrics by denominator and configuration, by sequence too, or by model alone."""
    keys = ["denominator", roles.model] if per_model else ["denominator", roles.model, roles.shot, roles.temperature, *[roles.sequence] * per_sequence]
    return metrics.metric_table(rows, keys).withColumn("model_display", scores.model_label(F.col(roles.model)))
