"""Paired tests between models and a logistic model of correctness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, stats
from ..roles import DEFAULT, Roles


def correctness(truth: Column, bucket: Column) -> Column:
    """1 or 0 where the truth is known; a missing bucket predicts 0."""
    return (scores.prediction(bucket) == truth.cast("int")).cast("int")


# Truth columns in the order in which the first that is there counts.
TRUTHS = ("_document_level_truth", "ground_truth", "document_truth_label", "patient_truth_label", "truth_label")


def with_correctness(rows: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Rows with ``ok``: from ``y`` and ``bucket`` where a stage has made them, else from the role's truth or the first
    of ``TRUTHS`` and the raw score; null where the truth is."""
    if {"y", "bucket"} <= set(rows.columns):
        return rows.withColumn("ok", correctness(scores.number(F.col("y")), F.col("bucket")))
    truth = next((c for c in (roles.truth, *TRUTHS) if c in rows.columns), None)
    if truth is None:
        return rows.withColumn("ok", F.lit(None).cast("int"))
    return rows.withColumn("ok", correctness(scores.number(F.col(truth)), scores.clean_likelihood(F.col(roles.score))))


def mcnemar_pairs(cube: DataFrame, roles: Roles = DEFAULT) -> DataFrame:
    """Exact McNemar tests of all model pairs on the subjects and experiments that both have.

    Of a model's rows with one key the one with the lowest temperature counts, then the first.
    """
    keys = [roles.subject, roles.experiment]
    rows = with_correctness(cube, roles).where("ok is not null")
    order = W.partitionBy(*keys, roles.model).orderBy(F.col(roles.temperature).asc_nulls_last(), roles.order)
    rows = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, F.col(roles.model).alias("m"), "ok")
    b = rows.select(*keys, F.col("m").alias("model_b"), F.col("ok").alias("ok_b"))
    pairs = rows.withColumnsRenamed({"m": "model_a", "ok": "ok_a"}).join(b, keys).where("model_a < model_b")
    cell = lambda x, y: F.count_if((F.col("ok_a") == x) & (F.col("ok_b") == y))
    table = pairs.groupBy("model_a", "model_b").agg(
        F.count(F.lit(1)).alias("n_pairs"), cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"),
        F.avg("ok_a").alias("accuracy_a"), F.avg("ok_b").alias("accuracy_b"),
    )
    return table.withColumns({"p_exact_mcnemar": stats.mcnemar_p(F.col("n10"), F.col("n01")), "accuracy_diff": F.col("accuracy_a") - F.col("accuracy_b")})


#: Fixed effects; the temperature group only where models don't differ, with which it is confounded.
FACTORS = ("model", "shot", "sequence", "temperature_group")


def _design(cube: DataFrame, factors: tuple[str, ...], roles: Roles) -> tuple[DataFrame, list[str], list, list[tuple[str, str]], np.ndarray]:
    """(rows with ``ok`` and the factors as strings, their columns, counts by pattern of levels, dummies, a pattern's row of the design).

    A missing level is one of its own, "nan".
    """
    rows = with_correctness(cube, roles).where("ok is not null").dropna(subset=[roles.subject])
    if "temperature_group" in factors:
        rows = rows.withColumn("temperature_group", scores.temperature_group(scores.round_temperature(F.col(roles.temperature))))
    columns = [c for f in factors if (c := getattr(roles, f, f)) in rows.columns]
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns})
    counted = rows.groupBy(*columns).agg(F.sum("ok").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # a row for each pattern
    levels = {c: sorted({r[c] for r in counted}) for c in columns}
    if len(levels.get(roles.model, ())) > 1 and "temperature_group" in columns:
        columns.remove("temperature_group")
    sums: dict[tuple, list] = {}
    for r in counted:
        both = sums.setdefault(tuple(r[c] for c in columns), [0, 0])
        both[0], both[1] = both[0] + (r["good"] or 0), both[1] + r["n"]
    cells = [{**dict(zip(columns, key, strict=True)), "good": good, "n": n} for key, (good, n) in sorted(sums.items())]
    dummies = [(c, v) for c in columns if len(levels[c]) > 1 for v in levels[c][1:]]
    return rows, columns, cells, dummies, np.array([[1.0, *[float(r[c] == v) for c, v in dummies]] for r in cells])


def _subject_cells(rows: DataFrame, columns: list[str], cells: list, roles: Roles) -> DataFrame:
    """``cells``, a row for each subject: array of (pattern k, rows n, right ones good), at most one for each pattern."""
    known = F.create_map(*[F.lit(x) for k, r in enumerate(cells) for x in ("\x1f".join(r[c] for c in columns), k)])
    pattern = F.try_element_at(known, F.concat_ws("\x1f", *columns)).cast("long")
    per = rows.withColumn("k", pattern).groupBy(roles.subject, "k").agg(F.sum("ok").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    return per.groupBy(roles.subject).agg(F.collect_list(F.struct("k", "n", "good")).alias("cells")).select("cells")


def _subject_scores(subjects: DataFrame, x: np.ndarray, mu: np.ndarray) -> DataFrame:
    """``i, j, m`` of each task: sums over subjects of the products of their scores i and j; for -1, -1 the subjects."""
    terms = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meat, count = np.zeros((terms, terms)), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                cells = batch.column(0).slice(low, 1000)
                sizes, flat = pc.list_value_length(cells).to_numpy(), cells.flatten()
                k, n, good = (flat.field(c).to_numpy() for c in ("k", "n", "good"))
                of, gap = np.repeat(np.arange(len(cells)), sizes), good - n * mu[k]
                scores_ = np.stack([np.bincount(of, gap * x[k, j], len(cells)) for j in range(terms)])
                meat, count = meat + scores_ @ scores_.T, count + len(cells)
        i, j = np.divmod(np.arange(terms * terms), terms)
        yield pa.record_batch([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(meat.ravel(), float(count)))], ["i", "j", "m"])

    return subjects.mapInArrow(run, "i bigint, j bigint, m double")


def clustered_logistic(cube: DataFrame, roles: Roles = DEFAULT, factors: tuple[str, ...] = FACTORS, least_rows: int = 50) -> DataFrame:
    """Logistic regression of correctness on factors, with standard errors clustered by subject.

    Rows are reduced to counts by covariate pattern, on which Newton's steps run; the sandwich's middle is a sum over
    subjects' scores, in NumPy over Arrow batches of their cells. A factor of one level is left out; too few rows or no factor give no rows. Columns:
    ``term, estimate_log_odds, std_error, p_value, odds_ratio, n_rows``.
    """
    schema = "term string, estimate_log_odds double, std_error double, p_value double, odds_ratio double, n_rows bigint"
    spark = cube.sparkSession
    rows, columns, cells, dummies, x = _design(cube, factors, roles)
    n, good = np.array([r["n"] for r in cells], float), np.array([r["good"] for r in cells], float)
    n_rows = int(n.sum())
    if n_rows < least_rows or not dummies:
        return spark.createDataFrame([], schema)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ beta))
        bread = (x * (n * mu * (1 - mu))[:, None]).T @ x + 1e-10 * np.eye(len(beta))
        step = np.linalg.solve(bread, x.T @ (good - n * mu))
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    p = len(beta)
    found = _subject_scores(_subject_cells(rows, columns, cells, roles), x, 1 / (1 + np.exp(-x @ beta)))
    sums = {(r["i"], r["j"]): r["m"] for r in found.groupBy("i", "j").agg(F.sum("m").alias("m")).collect()}  # a row for each pair of terms
    meat = np.array([[sums[i, j] for j in range(p)] for i in range(p)])
    inverse = np.linalg.inv(bread)
    g = sums[-1, -1]
    scale = g / (g - 1) * (n_rows - 1) / max(1, n_rows - p) if g > 1 else 1.0
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * scale, 0))
    names = ["Intercept", *[f"{c}[T.{v}]" for c, v in dummies]]
    out = [(t, float(b), float(s), math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else None, float(np.exp(b)), n_rows) for t, b, s in zip(names, beta, se, strict=True)]
    return spark.createDataFrame(out, schema)


NODES, INNER, CLOSE = 11, 12, 1e-9  # quadrature nodes, most steps of a subject's own update, the step at which it ends
PRIOR_SD, PRIOR_LOG_SD = 2.0, 1.0  # of the fixed effects, and of the logarithm of the intercepts' standard deviation


def _subject_posterior(subjects: DataFrame, etas: np.ndarray, spreads: np.ndarray, precision: float) -> DataFrame:
    """``k, p, q`` of each task: sums of n E[mu] and n E[mu (1 - mu)] by pattern k; for k = -1 of E[b^2], and the subjects;
    for k = -2 by how much about the sum of E[b^2] falls as the precision rises.

    A subject's intercept is normal with mean b and variance v; a cell's linear predictor is normal with the mean
    etas[k] + b and the variance spreads[k] + v, and expectations over it are sums over Gauss-Hermite nodes.
    """
    at, weight = np.polynomial.hermite_e.hermegauss(NODES)
    weight = weight / weight.sum()

    def solve(k: np.ndarray, n: np.ndarray, good: np.ndarray, of: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray, float, float]:
        b, v = np.zeros(subjects), np.full(subjects, 1 / (1 + precision))
        eta, spread, mu = etas[k], spreads[k], np.empty(len(k))

        def expected() -> tuple[np.ndarray, np.ndarray]:
            mean, sd, first, second = eta + b[of], np.sqrt(spread + v[of]), np.zeros(len(k)), np.zeros(len(k))
            for node, share in zip(at, weight, strict=True):
                np.multiply(sd, -node, out=mu)
                np.subtract(mu, mean, out=mu)
                np.exp(mu, out=mu)
                np.add(mu, 1, out=mu)
                np.divide(1, mu, out=mu)
                first += share * mu
                np.multiply(mu, mu, out=mu)
                second += share * mu
            return n * first, n * (first - second)

        for _ in range(INNER):
            p, q = expected()
            bend = np.bincount(of, q, subjects) + precision
            step, last = np.clip((np.bincount(of, good - p, subjects) - precision * b) / bend, -2, 2), v
            b, v = b + step, 1 / bend
            if max(np.abs(step).max(), np.abs(v - last).max()) < CLOSE:
                break
        p, q = expected()
        return np.bincount(k, p, len(etas)), np.bincount(k, q, len(etas)), float((b * b + v).sum()), float((v * (2 * b * b + v)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, square, count, falls = np.zeros(len(etas)), np.zeros(len(etas)), 0.0, 0, 0.0
        for batch in batches:
            for low in range(0, batch.num_rows, 250):
                cells = batch.column(0).slice(low, 250)
                sizes, flat = pc.list_value_length(cells).to_numpy(), cells.flatten()
                k, n, good = (flat.field(c).to_numpy() for c in ("k", "n", "good"))
                more = solve(k, n, good, np.repeat(np.arange(len(cells)), sizes), len(cells))
                p, q, square, count, falls = p + more[0], q + more[1], square + more[2], count + len(cells), falls + more[3]
        yield pa.record_batch([pa.array(np.append(np.arange(len(etas)), [-1, -2])), pa.array(np.append(p, [square, falls])), pa.array(np.append(q, [float(count), 0.0]))], ["k", "p", "q"])

    return subjects.mapInArrow(run, "k bigint, p double, q double")


def log_sd_posterior(total: float, n: float, power: float = 0.0, precision: float = 1.0) -> tuple[float, float]:
    """(mean, variance) of the log standard deviation of n intercepts whose expected squares sum to ``total``.

    With a ``power`` the sum is ``total`` at ``precision`` and goes with the precision to the power -``power``.
    """
    t, w = 0.5 * math.log(max(total / n, 1e-12)), 1 / (1 / PRIOR_LOG_SD**2 + 2 * n)
    pulled = lambda: total * precision**power * math.exp((1 - power) * (2 * w - 2 * t))
    for _ in range(200):
        pull = pulled()
        move = (pull - n - t / PRIOR_LOG_SD**2) / (2 * (1 - power) * pull + 1 / PRIOR_LOG_SD**2)
        t, last = t + max(-1.0, min(1.0, move)), w
        w = 1 / (1 / PRIOR_LOG_SD**2 + 2 * pulled())
        if abs(move) < 1e-12 and abs(w - last) < 1e-14:
            break
    return t, w


def mixed_logistic(cube: DataFrame, roles: Roles = DEFAULT, factors: tuple[str, ...] = FACTORS, least_rows: int = 50, rounds: int = 60) -> DataFrame:
    """Logistic regression of correctness with a random intercept for each subject, by mean-field variational Bayes.

    Fixed effects, intercepts and the logarithm of the intercepts' standard deviation are independent normals, with
    priors of standard deviation ``PRIOR_SD`` and ``PRIOR_LOG_SD`` for the first and last; their means and variances
    maximise the evidence bound by coordinate steps. Each round updates every subject's intercept from its own cells, many
    at once in NumPy; what comes back is two sums for each pattern of levels, on which the fixed effects take a Newton
    step, and the sum of the intercepts' squares with its slope by their precision, so that the standard deviation too
    moves by about a Newton step instead of many small ones. Columns: ``term, estimate_log_odds, posterior_sd, p_value, odds_ratio,
    n_rows``; the term ``subject_log_sd`` is the logarithm's mean, ``subject_sd`` its exponential. Too few rows or no
    factor that varies give no rows.
    """
    schema = "term string, estimate_log_odds double, posterior_sd double, p_value double, odds_ratio double, n_rows bigint"
    spark = cube.sparkSession
    rows, columns, cells, dummies, x = _design(cube, factors, roles)
    n_rows = sum(r["n"] for r in cells)
    if n_rows < least_rows or not dummies:
        return spark.createDataFrame([], schema)
    good = np.array([r["good"] for r in cells], float)
    subjects = _subject_cells(rows, columns, cells, roles).persist()
    m, s2, t, w = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1), math.log(0.7), 0.01
    try:
        for _ in range(rounds):
            precision = math.exp(-2 * t + 2 * w)
            found = _subject_posterior(subjects, x @ m, x**2 @ s2, precision).groupBy("k").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).collect()
            sums = {r["k"]: (r["p"], r["q"]) for r in found}  # a row for each pattern
            weight = np.array([sums[k][1] for k in range(len(cells))])
            bread = (x * weight[:, None]).T @ x + np.eye(len(m)) / PRIOR_SD**2
            move = np.clip(np.linalg.solve(bread, x.T @ (good - np.array([sums[k][0] for k in range(len(cells))])) - m / PRIOR_SD**2), -2, 2)
            (total, count), last = sums[-1], t
            m, s2 = m + move, 1 / np.diag(bread)
            goal, w = log_sd_posterior(total, count, min(1.0, precision * sums[-2][0] / total), precision)
            t += max(-2.0, min(2.0, goal - t))
            if np.abs(move).max() < 1e-4 and abs(t - last) < 1e-4:
                break
    finally:
        subjects.unpersist()
    names = ["Intercept", *[f"{c}[T.{v}]" for c, v in dummies]]
    out = [(term, float(b), float(d), math.erfc(abs(b / d) / math.sqrt(2)), float(np.exp(b)), n_rows) for term, b, d in zip(names, m, np.sqrt(s2), strict=True)]
    return spark.createDataFrame([*out, ("subject_log_sd", t, math.sqrt(w), None, None, n_rows), ("subject_sd", math.exp(t), None, None, None, n_rows)], schema)
