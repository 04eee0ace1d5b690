"""Scores, predictions, names and labels as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

_NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def to_number(value: Column) -> Column:
    """A double, or null where the value isn't a number; guards against type suffixes that a cast would take."""
    text = value.cast("string")
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number(value: Column) -> Column:
    """A double without NaN, or null where the value isn't a number."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def clean_likelihood(score: Column) -> Column:
    """Bucket 0 to 10: up to 1 as a share cut at a half, above 1 rounded half up, outside 0 to 10 null."""
    x = number(score)
    return (
        F.when(x.between(0, 1), (x >= 0.5).cast("int"))
        .when((x > 1) & (x < 10), F.floor(x + 0.5).cast("int"))
        .when(x == 10, F.lit(10))
    )


def probability(bucket: Column) -> Column:
    return F.when(bucket.isNotNull(), F.least(F.greatest(bucket.cast("double") / 10, F.lit(0.0)), F.lit(1.0)))


def prediction(bucket: Column, threshold: int = K.DECISION_THRESHOLD, missing: str = "negative") -> Column:
    """1 from the threshold on; a missing bucket is 0 under "negative", null under "drop"."""
    if missing not in ("negative", "drop"):
        raise ValueError(f"unknown policy for missing scores: {missing}")
    found = (bucket >= threshold).cast("int")
    return F.coalesce(found, F.lit(0)) if missing == "negative" else found


def coerce_binary(df: DataFrame, column: str, threshold: float = K.DECISION_THRESHOLD, into: str | None = None) -> DataFrame:
    """The column as 0 or 1: as it is where all its values are, else from the threshold on. One aggregate decides."""
    x = number(F.col(column))
    plain = df.agg(F.bool_and(x.isin(0.0, 1.0)).alias("plain"))
    joined = df.crossJoin(F.broadcast(plain))  # one row
    found = F.when(F.col("plain"), x.cast("int")).otherwise((x >= threshold).cast("int"))
    return joined.withColumn(into or column, found).drop("plain")


def combine_truths(*flags: Column) -> Column:
    """1 if any, 0 if any is known, else null."""
    return F.greatest(*flags) if len(flags) > 1 else flags[0]


# Words that count as 1 and as 0.
_YES, _NO = ("true", "TRUE", "yes", "Y"), ("false", "FALSE", "no", "N")


def coerce_marker(value: Column) -> Column:
    """0, 1 or null from booleans, words and numbers; anything else is null."""
    text = value.cast("string")
    n = to_number(value)
    return F.when(text.isin(*_YES), 1).when(text.isin(*_NO), 0).when(n.isin(0.0, 1.0), n.cast("int"))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def parse_percent(cell: Column) -> Column:
    """Percent of a cell: a number up to 1 is a share, ``x/y (z%)`` gives z, booleans 100 or 0."""
    text = cell.cast("string")
    inner = F.regexp_extract(text, r"\(([-+]?\d+(?:\.\d+)?)%\)", 1)
    n = to_number(cell)
    share = F.when(n.between(0, 1), n * 100).otherwise(n)
    return F.when(F.lower(text) == "true", 100.0).when(F.lower(text) == "false", 0.0).when(inner != "", inner.cast("double")).otherwise(share)


def round_temperature(value: Column) -> Column:
    return F.bround(number(value), 2)


def numeric_ticks(low: float, high: float, step: float) -> list[float]:
    """The multiples of ``step`` that span low to high, two at least; none where a limit isn't finite."""
    if not (math.isfinite(low) and math.isfinite(high)):
        return []
    first, last = math.floor(low / step), math.ceil(high / step)
    return [round(k * step, 10) for k in range(first, max(last, first + 1) + 1)]


def temperature_group(value: Column) -> Column:
    """Four bins, right-closed."""
    t = number(value)
    bins = ((-0.01, 0.55, "low"), (0.55, 0.70, "midlow"), (0.70, 0.85, "midhigh"), (0.85, 1.10, "high"))
    return F.coalesce(*[F.when((t > a) & (t <= b), F.lit(name)) for a, b, name in bins])


def temperature_from_name(name: Column) -> Column:
    """Sampling temperature from a name's suffix: ``_t0_75``, ``_t075``, ``_t05`` or ``_t1``."""
    low = F.lower(F.trim(name))
    digits = F.regexp_extract(low, r"_t(\d{2,3})(?=_|$)", 1)
    pair = F.regexp_extract(low, r"_t(\d)_(\d{2})(?=_|$)", 1)
    one = F.regexp_extract(low, r"_t(\d)(?=_|$)", 1)
    dotted = lambda d: F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, 2, 2)).cast("double")
    return (
        F.when(pair != "", F.concat(pair, F.lit("."), F.regexp_extract(low, r"_t(\d)_(\d{2})(?=_|$)", 2)).try_cast("double"))
        .when(digits != "", F.when(digits != "", dotted(digits)))
        .when(one != "", one.try_cast("double"))
    )


def temperature_slug(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("t"), F.replace(F.format_string("%.2f", value), F.lit("."), F.lit("_"))))


def canonical_model(name: Column, mapping: dict[str, str] | None = None) -> Column:
    """The mapping's name, exactly or in any case, else the first family whose pattern is found, else the name trimmed."""
    stripped = F.trim(name)
    low = F.lower(stripped)
    steps = []
    if mapping:
        exact = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        folded = F.create_map(*[F.lit(x) for k, v in mapping.items() for x in (k.strip().lower(), v)])
        steps = [F.try_element_at(exact, stripped), F.try_element_at(folded, low)]
    steps += [F.when(low.rlike(p), F.lit(m)) for p, m in K.MODEL_FAMILIES]
    return F.coalesce(*steps, stripped)


def display_model(runner: Column, display: Column, canon: Column, temperature: Column, names: dict[str, str] | None = None) -> Column:
    """Runner metadata's name, else ``<canon>_t<temp>``, else the canon, else display name or runner."""
    key, c = F.trim(runner), F.trim(canon)
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key) if names else F.lit(None).cast("string")
    differs = (c != "") & (c != key)
    with_temp = F.when(differs & temperature.isNotNull(), F.concat(c, F.lit("_"), temperature_slug(temperature)))
    return F.coalesce(known, with_temp, F.when(differs, c), F.nullif(F.trim(display), F.lit("")), key)


def is_primary(model: Column, temperature: Column, shot: Column, sequence: Column | None = None) -> Column:
    """Zero shot at the model's primary temperature, and on the full document sequence where one is given."""
    expected = F.coalesce(*[F.when(model == m, F.lit(t)) for m, t in K.PRIMARY_TEMPERATURE.items()])
    ok = (shot == K.ZERO_SHOT) & (F.abs(temperature - expected) < 1e-6)
    if sequence is not None:
        ok = ok & sequence.isin("all_docs_in_sequence", K.PATIENT_SEQUENCE)
    return F.coalesce(ok, F.lit(False))


def tier(sequence: Column) -> Column:
    low = F.lower(F.trim(sequence))
    return F.when(low.isin(*K.SINGLE_DOCUMENT), "document").when(low.isin(*K.DOCUMENT_SETS), "cumulative").otherwise("unknown")


def model_pool(model: Column) -> Column:
    low = F.lower(model)
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in marks]), F.lit(pool)) for pool, marks in K.POOLS])


def pool_order(pool: Column) -> Column:
    return F.coalesce(*[F.when(pool == p, F.lit(i)) for i, p in enumerate(K.POOL_ORDER)], F.lit(len(K.POOL_ORDER)))


def is_small_model(model: Column) -> Column:
    return ~F.contains(F.lower(model), F.lit("32b"))


def folder_label(display: Column, shot: Column, sequence: Column) -> Column:
    return F.concat_ws("_", display, shot, F.lit("shot"), sequence)


def folder_parts(folder: Column) -> dict[str, Column]:
    """``model, temperature, shot, data_type`` of a folder label; null where the label has another form."""
    # The label's parts.
    forms = {"model": r"^(.+?)_t", "temperature": r"_t(\d+_\d{2})", "shot": r"_(zero|single|dual)_shot", "data_type": r"_(?:zero|single|dual)_shot_(.+)$"}
    return {name: F.nullif(F.regexp_extract(folder, form, 1), F.lit("")) for name, form in forms.items()}


def experiment_parts(name: Column) -> tuple[Column, Column]:
    """(shot type, sequence) of an experiment name; ``unknown`` and the whole name where it has another form."""
    form = r"^(zero|single|dual)_shot_(.+)$"
    shot = F.regexp_extract(name, form, 1)
    return F.when(shot != "", shot).otherwise("unknown"), F.when(shot != "", F.regexp_extract(name, form, 2)).otherwise(name)


def icl_shots(shot: Column) -> Column:
    return F.when(shot == "zero", 0).when(shot == "single", 1).when(shot == "dual", 2).otherwise(-1)


def outcome_flags(truth: Column, bucket: Column, raw: Column, certainty: Column) -> dict[str, Column]:
    """Outcome of a row, its certainty band and whether it failed catastrophically: an error, certain and extreme."""
    pred = prediction(bucket)
    false = F.lit(False)
    flag = lambda c: F.coalesce(c, false)
    error = flag(pred != truth)
    high, low = flag(certainty >= K.HIGH_CERTAINTY), flag(certainty < K.HIGH_CERTAINTY)
    extreme = flag((raw <= K.EXTREME_LOW) | (raw >= K.EXTREME_HIGH))
    return {
        "is_fp": flag((pred == 1) & (truth == 0)), "is_fn": flag((pred == 0) & (truth == 1)),
        "is_tp": flag((pred == 1) & (truth == 1)), "is_tn": flag((pred == 0) & (truth == 0)),
        "is_error": error, "high_certainty": high, "low_certainty": low, "is_extreme": extreme,
        "catastrophic": error & high & extreme,
    }


# ---- labels -------------------------------------------------------------------------------------------------------


def sentence_case(text: Column) -> Column:
    low = F.lower(F.trim(F.regexp_replace(F.translate(F.trim(text.cast("string")), "_-", "  "), r"\s+", " ")))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))


def _named(key: Column, names: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def model_label(model: Column) -> Column:
    low = F.lower(F.trim(model))
    compact = F.replace(F.replace(low, F.lit(" "), F.lit("")), F.lit("_"), F.lit("-"))
    part = lambda i: F.regexp_extract(low, r"^([a-z]+)[_-]?(\d+)([bm])", i)
    built = F.concat(F.upper(F.substring(part(1), 1, 1)), F.substr(part(1), F.lit(2)), F.lit("-"), part(2), F.upper(part(3)))
    return F.coalesce(_named(low, K.MODEL_NAMES), _named(compact, K.MODEL_NAMES), F.when(part(1) != "", built), sentence_case(model))


def temperature_label(value: Column) -> Column:
    n = to_number(value)
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", n), "0+$", ""), r"\.$", "")
    raw = F.trim(value.cast("string"))
    slug = F.when(raw.rlike(r"^\d+_\d+$"), F.replace(raw, F.lit("_"), F.lit("."))).otherwise(raw)
    return F.when(value.isNull(), "Missing").when(n.isNotNull(), short).otherwise(slug)


def shot_label(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.coalesce(_named(low, K.SHOT_NAMES), sentence_case(low))


# Parts of a sequence name and how they are said; the longest part at a place counts.
_SEQUENCE_PARTS = {
    "all_docs_in_sequence": "All documents in sequence",
    "preceding_clinic": "Preceding clinic letter",
    "pre_clinic": "Preceding clinic letter",
    "following_clinic": "Following clinic letter",
    "follow_clinic": "Following clinic letter",
    "preceding": "Preceding",
    "pre": "Preceding",
    "following": "Following",
    "follow": "Following",
    "clinic": "Clinic letter",
    "endoscopy": "Endoscopy",
    "endo": "Endoscopy",
    "histology": "Histology",
    "hist": "Histology",
    "all": "All",
    "docs": "documents",
    "in": "in",
    "sequence": "sequence",
    "report": "report",
    "letter": "letter",
}


def sequence_label(value: Column) -> Column:
    """The sequence's name; of an unknown one its parts by name, as an order of documents where it holds any."""
    low = F.lower(F.trim(value))
    several = [p.replace("_", "[_/]+") + "(?![^_/])" for p in _SEQUENCE_PARTS if "_" in p]
    parts = F.transform(F.regexp_extract_all(low, F.lit("(" + "|".join([*several, "[^_/]+"]) + ")"), F.lit(1)), lambda p: F.regexp_replace(p, "[_/]+", "_"))
    said = F.array_join(F.transform(parts, lambda p: F.coalesce(_named(p, _SEQUENCE_PARTS), sentence_case(p))), " / ")
    said = F.concat(F.upper(F.substring(said, 1, 1)), F.substr(said, F.lit(2)))
    ordered = said.rlike(r"(?i)\b(endoscopy|histology|clinic letter)\b")
    return F.coalesce(_named(low, K.SEQUENCE_NAMES), F.when(ordered, F.concat(said, F.lit(" narrative order"))).otherwise(said))


def factor_label(factor: str, value: Column) -> Column:
    if factor in ("model", "model_canon"):
        return model_label(value)
    if factor == "temperature":
        return temperature_label(value)
    if factor in ("shot", "shot_type"):
        return shot_label(value)
    if factor in ("report_sequence_name", "dataset"):
        return sequence_label(value)
    return sentence_case(value)


def count_percent(x: Column, total: Column) -> Column:
    """``x/y (z%)``."""
    share = F.when(total > 0, F.lit(100.0) * x / total).otherwise(F.lit(0.0))
    return F.format_string("%d/%d (%.1f%%)", x.cast("long"), total.cast("long"), F.bround(share, 1))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
