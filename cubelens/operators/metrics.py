"""Confusion counts and what follows from them; every table is one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..functions.scores import safe_divide
from ..roles import DEFAULT, Roles

METRICS = ("brier", "macro_f1", "recall", "mcc", "precision", "accuracy", "specificity", "npv")
FACTORS = {"shot_type": "shot", "model": "model", "temperature": "temperature", "data_type": "sequence"}


def counts(y: str = "y", p: str = "p") -> list[Column]:
    """Aggregates ``n, tp, fp, tn, fn, sq`` of truth y and probability p; a prediction is p >= 0.5."""
    yes = F.col(p) >= 0.5
    pos = F.col(y) == 1
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(pos & yes).alias("tp"), F.count_if(~pos & yes).alias("fp"),
        F.count_if(~pos & ~yes).alias("tn"), F.count_if(pos & ~yes).alias("fn"),
        # as decimals, so that the sum doesn't depend on the order of the rows
        F.sum(((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).cast("decimal(18,8)")).cast("double").alias("sq"),
    ]


def macro_f1() -> Column:
    """Mean F1 over the classes that occur in truth or prediction."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    has1, has0 = (tp + fp + fn > 0).cast("int"), (tn + fp + fn > 0).cast("int")
    f1, f0 = safe_divide(2 * tp, 2 * tp + fp + fn), safe_divide(2 * tn, 2 * tn + fp + fn)
    return safe_divide(f1 * has1 + f0 * has0, (has1 + has0).cast("double"))


def mcc() -> Column:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return safe_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def point() -> dict[str, Column]:
    """The eight metrics of count columns; an undefined ratio is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return {
        "brier": safe_divide(F.col("sq"), F.col("n")), "macro_f1": macro_f1(), "recall": safe_divide(tp, tp + fn), "mcc": mcc(),
        "precision": safe_divide(tp, tp + fp), "accuracy": safe_divide(tp + tn, F.col("n")),
        "specificity": safe_divide(tn, tn + fp), "npv": safe_divide(tn, tn + fn),
    }


def metric_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` and the eight metrics of rows (keys, y, p); a null key is a group."""
    return rows.groupBy(*keys).agg(*counts()).select(*keys, "n", *[c.alias(m) for m, c in point().items()])


def binary_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The other definition: what is undefined is null; with F1, prevalence and AUC. Rows: keys, y, pred, score (0 to 10)."""
    base = rows.withColumn("p", F.col("pred").cast("double")).withColumn("share", scores.probability(F.col("score")))
    tp, fp, tn, fn, n = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn", "n"))
    div = F.try_divide
    found = base.groupBy(*keys).agg(*counts(), F.avg((F.col("share") - F.col("y")) * (F.col("share") - F.col("y"))).alias("brier"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    found = found.select(
        *keys, "n", div(tp + tn, n).alias("accuracy"), safe_divide(tp, tp + fp).alias("precision"), safe_divide(tp, tp + fn).alias("recall"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tn, tn + fp).alias("specificity"), div(tn, tn + fn).alias("npv"),
        div(tp * tn - fp * fn, root).alias("mcc"), "brier", div(tp + fn, n).alias("prevalence"),
    )
    by_auc = auc(rows.select(*keys, "y", "score"), keys)
    return _null_safe_join(found, by_auc, keys)


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
    return a.join(b, on, how).drop(*[f"_{k}" for k in keys])


def auc(rows: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """``keys, auc`` by midranks; null with one class. Ranks run over distinct scores, not over rows."""
    hist = rows.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return hist.groupBy(*keys).agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


# ---- policies and the factor table --------------------------------------------------------------------------------


def prepared(cube: DataFrame, roles: Roles = DEFAULT, truth: str | None = None) -> DataFrame:
    """Rows with a truth, with ``y``, ``bucket`` and ``p`` (null where the score is missing) and the temperature rounded."""
    y = scores.number(F.col(truth or roles.truth)).cast("int")
    out = cube.withColumn("y", y).withColumn("bucket", scores.clean_likelihood(F.col(roles.score))).where("y is not null")
    out = out.withColumn("p", scores.probability(F.col("bucket")))
    return out.withColumn(roles.temperature, scores.round_temperature(F.col(roles.temperature))) if roles.temperature in out.columns else out


def policy_rows(rows: DataFrame, roles: Roles = DEFAULT, policies: tuple[str, ...] = ("all_attempts", "complete_case", "non_truncated_only")) -> DataFrame:
    """Each row once for each policy that it belongs to: one explode instead of a union of scans.

    all_attempts counts a missing score as probability 0; complete_case leaves it out; non_truncated_only leaves out
    truncated rows too.
    """
    have = F.col("bucket").isNotNull()
    whole = ~F.coalesce(F.col(roles.truncated), F.lit(False)) if roles.truncated in rows.columns else F.lit(True)
    test = {"all_attempts": F.lit(True), "complete_case": have, "non_truncated_only": have & whole}
    names = F.array_compact(F.array(*[F.when(test[p], F.lit(p)) for p in policies]))
    return rows.withColumn("denominator", F.explode(names)).withColumn("p", F.coalesce("p", F.lit(0.0)))


def fair_predicates(roles: Roles = DEFAULT) -> dict[str, Column]:
    """For each factor the rows on which the other factors are held."""
    zero = F.col(roles.shot) == K.ZERO_SHOT
    temps = F.col(roles.temperature).isin(*K.FAIR_TEMPERATURES)
    sequences = F.col(roles.sequence).isin(*K.FAIR_SEQUENCES)
    return {"shot_type": temps & sequences, "model": zero & temps & sequences, "temperature": zero & sequences, "data_type": zero & temps}


def factor_rows(rows: DataFrame, roles: Roles = DEFAULT, skip: set[str] = frozenset()) -> DataFrame:
    """Each row once for each factor whose comparison it belongs to, as (factor, value)."""
    held = fair_predicates(roles)
    pairs = [F.when(held[f], F.struct(F.lit(f).alias("factor"), F.col(getattr(roles, r)).cast("string").alias("value"))) for f, r in FACTORS.items() if f not in skip and getattr(roles, r) in rows.columns]
    return rows.withColumn("_pair", F.explode(F.array_compact(F.array(*pairs)))).withColumns({"factor": F.col("_pair.factor"), "value": F.col("_pair.value")}).drop("_pair")


def factor_metrics(cube: DataFrame, roles: Roles = DEFAULT, truth: str | None = None, skip: set[str] = frozenset()) -> DataFrame:
    """``denominator, factor, value, n`` and the eight metrics: one scan, one shuffle."""
    return metric_table(factor_rows(policy_rows(prepared(cube, roles, truth), roles), roles, skip), ["denominator", "factor", "value"])


def primary_rows(cube: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows of the primary configurations, once as ``pooled`` (null model and temperature) and once as ``by_model``."""
    rows = prepared(cube, roles).where(scores.is_primary(F.col(roles.model), F.col(roles.temperature), F.col(roles.shot), F.col(roles.sequence)))
    rows = policy_rows(rows, roles, ("all_attempts",)).withColumn("scope", F.explode(F.array(F.lit("pooled"), F.lit("by_model"))))
    mine = F.col("scope") == "by_model"
    return rows.withColumns({c: F.when(mine, F.col(c)) for c in (roles.model, roles.temperature)})


def by_metric(table: DataFrame, metric: str) -> DataFrame:
    """The table with its best rows first: the Brier score and calibration errors ascending, all else descending."""
    low = metric.split("_")[0] in ("brier", "ece", "mce")
    return table.orderBy(F.col(metric).asc_nulls_last() if low else F.col(metric).desc_nulls_last())


def primary_estimand(cube: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Metrics of the primary configurations, pooled and by model and temperature, as grouping sets."""
    rows = prepared(cube, roles).where(scores.is_primary(F.col(roles.model), F.col(roles.temperature), F.col(roles.shot), F.col(roles.sequence)))
    rows = policy_rows(rows, roles, ("all_attempts",))
    keys = [roles.model, roles.temperature]
    grouped = rows.groupingSets([[], keys], *keys).agg(*counts(), F.grouping_id().alias("g"))
    return grouped.where("n > 0").select(F.when(F.col("g") > 0, "pooled").otherwise("by_model").alias("scope"), *keys, "n", *[c.alias(m) for m, c in point().items()])
