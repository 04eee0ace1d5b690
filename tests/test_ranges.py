"""Numbers, order statistics and as-of values found in ranges, and the bootstrap of any metric, against plain Python."""

from __future__ import annotations

import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelens.functions import stats
from cubelens.operators import bootstrap, descriptive, linkage, ranges


@pytest.fixture(params=[1, 4, 13])
def parts(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def skewed(n=600, seed=1):
    """Rows (key, v, id) of which one key has half; a value stands in a third of the rows; keys and values may be null."""
    rng = random.Random(seed)
    return [("hot" if i % 2 else rng.choice(["a", "b", None]), None if i % 17 == 0 else 3.0 if i % 3 == 0 else round(rng.gauss(0, 5), 2), i) for i in range(n)]


def test_numbers_within_keys(spark, parts):
    rows = skewed()
    got = ranges.numbered(spark.createDataFrame(rows, "k string, v double, id long"), ["k"], ["v", "id"], "j").collect()
    order = defaultdict(list)
    for k, v, i in rows:
        order[k].append((v is not None, v or 0.0, i))
    want = {i: (k, n) for k, xs in order.items() for n, (_, _, i) in enumerate(sorted(xs))}
    assert {r["id"]: (r["k"], r["j"]) for r in got} == want
    assert sorted(r["j"] for r in ranges.numbered(spark.range(40), [], ["id"], "j").collect()) == list(range(40))
    assert ranges.numbered(spark.createDataFrame([], "k string, v double"), ["k"], ["v"], "j").count() == 0


def test_a_hot_key_is_dealt_to_all_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    ranged = ranges.in_ranges(rows, ["k"], ["id"])
    sizes = sorted(r["count"] for r in ranged.groupBy("_range").count().collect())
    assert len(sizes) == 4 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert ranges.totals(ranged, ["k"]).where("_before > 0").count() <= 4


def test_quantiles_are_exact(spark, parts):
    rows = skewed()
    at = {"low": 0.025, "q25": 0.25, "mid": 0.5, "q90": 0.9, "top": 1.0}
    got = {r["k"]: [r[n] for n in at] for r in ranges.quantiles(spark.createDataFrame(rows, "k string, v double, id long"), ["k"], "v", at).collect()}
    values = defaultdict(list)
    for k, v, _ in rows:
        if v is not None:
            values[k].append(v)
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile(vs, list(at.values())), atol=1e-9)
    whole = ranges.quantiles(spark.createDataFrame(rows, "k string, v double, id long"), [], "v", {"m": 0.5}).first()["m"]
    assert math.isclose(whole, float(np.median([v for _, v, _ in rows if v is not None])))


def test_no_group_is_buffered_and_the_input_is_run_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame(skewed(), "k string, v double, id long").mapInPandas(count, "k string, v double, id long")
    table = descriptive.statistics(rows, ["k"], "v")
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    got = table.collect()
    assert len(got) == 4 and seen.value == 600 and "percentile" not in plan and "median(" not in plan


def test_t_quantiles_of_a_column(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 2, 5, 30, 199, 200, 201, 250, 1000, 10**6)], "n long")
    for p in (0.9, 0.975, 0.995):
        for r in df.select("n", stats.t_quantile_of(p, F.col("n")).alias("t")).collect():
            assert (r["t"] is None) if r["n"] < 1 else math.isclose(r["t"], stats.t_quantile(p, r["n"]), abs_tol=1e-7 if r["n"] > 1000 else 1e-9)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_of_a_hot_subject(spark, parts, direction):
    rng = random.Random(3)
    day = datetime.datetime(2024, 1, 1)
    at = lambda: None if rng.random() < 0.03 else day + datetime.timedelta(hours=rng.randrange(0, 2400, 6))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left, right = [(i, key(), at()) for i in range(200)], [(i, key(), at()) for i in range(150)]
    got = linkage.asof_join(
        spark.createDataFrame(left, "a long, k string, t timestamp"), spark.createDataFrame(right, "b long, k string, s timestamp"), "k", "t", "s", {"b": "b"}, direction, 9, "b",
    )
    found = {r["a"]: r["b"] for r in got.collect()}
    assert len(found) == 200
    for a, k, t in left:
        near = [] if k is None or t is None else [(abs(t - s), b) for b, q, s in right if q == k and s is not None and (s < t if direction == "backward" else s - t >= datetime.timedelta(days=1))]
        best = min(near, default=None)
        # whole days are counted from the right row's side, rounded down
        if best is not None and (math.floor(-best[0].total_seconds() / 86400) if direction == "backward" else math.floor(best[0].total_seconds() / 86400)).__abs__() > 9:
            best = None
        assert found[a] == (best and best[1]), (a, k, t)


# ---- the bootstrap of any metric ------------------------------------------------------------------------------------


def labelled(n=400):
    rng = random.Random(8)
    return [(rng.choice(["m1", "m2"]), f"P{rng.randrange(40)}", int(rng.random() < 0.4), float(rng.randrange(11)) if rng.random() > 0.05 else None) for _ in range(n)]


def poisson(model, patient, b, seed=42):
    import hashlib

    u = int(hashlib.md5(f"{seed}|{model}|{patient}|{b}".encode()).hexdigest()[:12], 16) / (1 << 48)
    total, w = 0.0, 0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        w += u >= total
    return w


def _auc(pairs):
    pos, neg = Counter(), Counter()
    for y, v, w in pairs:
        (pos if y else neg)[v] += w
    a, b = sum(pos.values()), sum(neg.values())
    return sum(p * (sum(n for x, n in neg.items() if x < v) + neg[v] / 2) for v, p in pos.items()) / (a * b) if a * b else None


def _want(rows, metric, n):
    out = {}
    for model in ("m1", "m2"):
        own = [r for r in rows if r[0] == model and r[3] is not None]
        each = [metric([(y, v, 1 if b < 0 else poisson(model, c, b)) for _, c, y, v in own]) for b in range(-1, n)]
        drawn = [x for x in each[1:] if x is not None]
        out[model] = [each[0], np.mean(drawn), *np.quantile(drawn, [0.025, 0.975])]
    return out


@pytest.mark.parametrize("metric, plain", [
    (bootstrap.auc_of, _auc),
    (bootstrap.quantile_of(0.5), lambda ps: float(np.median([v for _, v, w in ps for _ in range(w)]))),
    (bootstrap.quantile_of(0.9), lambda ps: float(np.quantile([v for _, v, w in ps for _ in range(w)], 0.9))),
    (bootstrap.calibration_of(lambda v: v / 10), lambda ps: sum(abs(sum(w * (y - v / 10) for y, v, w in ps if v == u)) for u in range(11)) / sum(w for *_, w in ps)),
])
def test_metrics_of_histograms(spark, metric, plain):
    rows = labelled()
    df = spark.createDataFrame(rows, "model string, patient string, y int, v double")
    got = {r["model"]: [r["point"], r["mean"], r["low"], r["high"]] for r in bootstrap.histogram_interval(df, ["model"], "patient", "v", metric, 30).collect()}
    want = _want(rows, plain, 30)
    assert set(got) == set(want)
    for model in want:
        assert np.allclose(got[model], want[model], atol=1e-9)


def user_metric():
    """Functions of a user: inside another one, so that executors get them by value."""

    def cells(rows, weights):
        state = np.zeros((weights.shape[1], 2, 11))
        for y, v in {(y, v) for y, v in zip(rows["y"], rows["v"], strict=True) if v == v}:
            state[:, y, int(v)] += weights[(rows["y"] == y) & (rows["v"] == v)].sum(axis=0)
        return state

    def auc(state):
        neg, pos = state[:, 0], state[:, 1]
        below = np.cumsum(neg, axis=1) - neg
        with np.errstate(invalid="ignore"):
            return (pos * (below + neg / 2)).sum(axis=1) / (pos.sum(axis=1) * neg.sum(axis=1))

    return bootstrap.Mergeable(cells, auc)


@pytest.mark.parametrize("split", [1, 7])
def test_a_users_metric_of_rows_and_weights(spark, split):
    rows = labelled()
    df = spark.createDataFrame(rows, "model string, patient string, y int, v double").repartition(split)
    auc = user_metric()
    got = {r["model"]: r for r in bootstrap.user_interval(df, ["model"], "patient", auc, ["y", "v"], 60).collect()}
    hashes = {r["patient"]: r["h"] for r in df.select("patient", F.xxhash64("patient").alias("h")).distinct().collect()}
    for model in ("m1", "m2"):
        own = [r for r in rows if r[0] == model and r[3] is not None]
        weights = bootstrap.row_weights(np.array([hashes[r[1]] for r in own]), 60, 42)
        each = [_auc([(y, v, int(w)) for (_, _, y, v), w in zip(own, weights[:, b], strict=True)]) for b in range(61)]
        assert math.isclose(got[model]["point"], each[0]) and math.isclose(got[model]["mean"], np.mean(each[1:]))
        assert np.allclose([got[model]["low"], got[model]["high"]], np.quantile(each[1:], [0.025, 0.975]))
    whole = bootstrap.user_interval(df, [], "patient", auc, ["y", "v"], 20).collect()
    assert len(whole) == 1 and math.isclose(whole[0]["point"], _auc([(y, v, 1) for _, _, y, v in rows if v is not None]))


def test_drawn_weights_are_poisson():
    w = bootstrap.row_weights(np.arange(2000), 50, 1)[:, 1:]
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and (w == bootstrap.row_weights(np.arange(2000), 50, 1)[:, 1:]).all()
