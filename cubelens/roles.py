"""Which column plays which part: every operator takes its column names from here, so that any cube can be analysed."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import constants as K


@dataclass(frozen=True)
class Roles:
    subject: str = "patient_id"
    truth: str = "truth"
    score: str = "likelihood_score"
    certainty: str = "certainty_score"
    complexity: str = "complexity_score"
    model: str = "model_canon"
    shot: str = "shot_type"
    sequence: str = "report_sequence_name"
    temperature: str = "temperature"
    experiment: str = "experiment_name"
    truncated: str = "truncated"
    order: str = "ord"


DEFAULT = Roles()


def first_existing(items: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first candidate among the items."""
    have = {str(x) for x in items}
    return next((c for c in candidates if c in have), None)


# Columns that hold the whole text of a case, the first that is there counts.
FULL_CONTEXT = ("Combined_Content", "full_response", "reasoning_text", "clues_text", "full_context", "context_text")


def full_context_column(columns: Iterable[str]) -> str | None:
    return first_existing(columns, FULL_CONTEXT)


def subject_column(columns: Iterable[str]) -> str | None:
    return first_existing(columns, K.ID_COLUMNS)


def truth_column(columns: Iterable[str], candidates: Iterable[str] = K.TRUTH_COLUMNS) -> str | None:
    return first_existing(columns, candidates)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every double or float column: the engine knows one kind of missing."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Missing optional columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})
