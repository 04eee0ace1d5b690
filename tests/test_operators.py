"""Truth, views, linkage, prompts, metrics and inference on small frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubelens.operators import bootstrap, calibration, descriptive, inference, linkage, metrics, prompts, thresholds, truth, views

T = dt.datetime


def test_document_truth_lenient_and_strict(spark):
    rows = [("all_docs_in_sequence", 1, None, 0), ("endo_hist", 0, 0, None), ("hist", 0, 1, 1)]
    df = spark.createDataFrame(rows, "report_sequence_name string, preceding_clinic_IBD int, endoscopy_IBD int, histology_IBD int")
    out = truth.document_truth(truth.document_truth(df, into="a"), strict=True, into="b").collect()
    assert [r["a"] for r in out] == [1.0, 0.0, 1.0] and [r["b"] for r in out] == [None, None, 1.0]


def test_marker_columns_need_a_label_word(spark):
    df = spark.createDataFrame([("hist", 1, "x", 3)], "report_sequence_name string, endoscopy_date int, histology_flag string, endo_label int")
    assert truth.resolve_markers(df) == {}
    assert truth.documents_of("all_docs_sequence_follow") == ("preceding_clinic", "endoscopy", "histology", "following_clinic")
    assert truth.documents_of("clinic_endo") == ("endoscopy", "preceding_clinic") and truth.documents_of("") == ()
    none, column = truth.prepare_truth(df, "document")
    assert column is None and none.columns == df.columns


CUBE = "ord int, patient_id string, runner_name string, model_canon string, shot_type string, temperature double, report_sequence_name string, likelihood_score double, certainty_score double, complexity_score double, truncated boolean, ground_truth int, full_response string"


def test_subject_view_keeps_the_winner(spark):
    rows = [(1, "p1", "r", "m", "zero", 0.6, "hist", 2.0, 9.0, 1.0, False, 1, "a"), (2, "p1", "r", "m", "zero", 0.6, "endo", 6.0, 8.0, 5.0, True, 0, "b"), (3, "p1", "r", "m", "zero", 0.6, "all_docs_in_sequence", 10.0, 1.0, 1.0, False, 0, "c"), (4, "p1", "r", "m", "zero", 0.6, "clinic_preceding", 6.0, 1.0, 1.0, False, 0, "a")]
    df = spark.createDataFrame(rows, CUBE)
    got = views.per_subject(df).collect()[0]
    assert (got["likelihood_score"], got["certainty_score"], got["complexity_score"], got["truncated"]) == (6.0, 8.0, 5.0, True)
    assert got["full_response"] == "a\n\nb" and got["ground_truth"] == 1.0 and got["report_sequence_name"] == "patient_aggregated_from_documents"
    cumulative = {r["report_sequence_name"]: r["likelihood_score"] for r in views.cumulative(df).collect()}
    assert cumulative["endo_hist"] == 6.0 and cumulative["all_docs_in_sequence"] == 6.0 and len(cumulative) == 10
    direct = df.where("report_sequence_name = 'all_docs_in_sequence'")
    assert views.cumulative(direct).collect()[0]["likelihood_score"] == 10.0


def chronology(spark, primary, secondary, notes, **more):
    return linkage.chronology(
        spark.createDataFrame(primary, "patient_id string, sample_received_date timestamp_ntz, result_report string"),
        spark.createDataFrame(secondary, "patient_id string, procedure_date timestamp_ntz, Combined_Content string"),
        spark.createDataFrame(notes, "patient_id string, date_creation timestamp_ntz, clean_content string"), **more,
    ).collect()


def test_chronology_links_one_report_and_both_letters(spark):
    got = chronology(spark, [("P1", T(2024, 1, 11), "rep")], [("P1", T(2024, 1, 10), "scope")], [("P1", T(2024, 1, 9, 9), "before"), ("P1", T(2024, 1, 12, 10), "after")])
    assert len(got) == 1 and len(got[0]) == 13
    r = got[0]
    assert (r["date_diff"], r["preceding_clinic_letter"], r["following_clinic_letter"], r["episode_id"]) == (1, "before", "after", "P1::2024-01-10")


def test_chronology_keeps_the_nearest_report_and_respects_the_window(spark):
    got = chronology(spark, [("P1", T(2024, 1, 1), "a"), ("P1", T(2024, 1, 2), "b")], [("P1", T(2024, 1, 1), "s")], [("P1", T(2020, 1, 1), "old"), ("P1", T(2023, 12, 20), "recent"), ("P1", T(2024, 1, 1, 10), "same day")], window_days=60)
    assert [(r["result_report"], r["preceding_clinic_letter"], r["following_clinic_letter"]) for r in got] == [("a", "recent", "NOT_AVAILABLE")]


def test_whole_days_round_down(spark):
    p = dt.datetime(2024, 1, 10)
    rows = [(p, p + d) for d in (dt.timedelta(days=-2, hours=9, minutes=15), dt.timedelta(hours=10), dt.timedelta(days=1), dt.timedelta(days=4, hours=14))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(linkage.days_between(F.col("b"), F.col("a"))).collect()] == [-2, 0, 1, 4]
    assert [r[0] for r in df.select(linkage.days_between(F.col("a"), F.col("b"))).collect()] == [1, -1, -1, -5]


def test_merge_suffixes_and_counts(spark):
    ref = spark.createDataFrame([("a", 1), ("b", 2)], "patient_id string, site int")
    out = spark.createDataFrame([("a", 5), ("a", 6), ("z", 7)], "patient_id string, site int")
    merged, counts = linkage.merge_reference(out, ref)
    assert merged.columns == ["patient_id", "site", "site_llm"] and merged.count() == 3
    assert {r["metric"]: r["value"] for r in counts.collect()} == {"reference_rows": 2, "parsed_rows": 3, "merged_rows": 3, "matched_rows": 2}


def test_sections_and_timing(spark):
    rows = spark.createDataFrame([("rep", " ", "pre", None)], "result_report string, Combined_Content string, preceding_clinic_letter string, following_clinic_letter string")
    asked = F.array(F.lit("ENDOSCOPY REPORT"), F.lit("CLINIC LETTER"), F.lit("UNKNOWN"), F.lit("PRIMARY REPORT"))
    got = rows.select(prompts.sections(asked, F.lit("both")).alias("s")).first()["s"]
    assert [tuple(x) for x in got] == [("ENDOSCOPY REPORT", "NOT_AVAILABLE"), ("PRECEDING CLINIC LETTER", "pre"), ("FOLLOWING CLINIC LETTER", "NOT_AVAILABLE"), ("HISTOPATHOLOGY REPORT", "rep")]
    assert prompts.experiments(spark, {"zero": "a", "dual": "b"}, {"x": ["y"], "z": []}).count() == 4


def test_budget_cuts_long_sections_and_keeps_later_ones():
    tokens = prompts.Words()
    long = " ".join(f"w{i}" for i in range(500))
    text, cut, labels = prompts.fit("Judge this.", [("A", long), ("B", "short one"), ("C", long)], tokens, 120)
    assert cut and labels == ["A", "C"] and "short one" in text and "**C**" in text and len(tokens.encode(text)) <= 120
    assert prompts.fit("t", [("A", "x")], tokens, 100)[1:] == (False, [])
    assert prompts.fit("many words in a frame " * 50, [("A", "x")], tokens, 30)[1:] == (True, ["A"])


def metric_rows(spark, rows):
    return spark.createDataFrame(rows, "g string, c string, y int, p double")


def test_point_metrics_with_one_class(spark):
    rows = [("all", "a", 1, 0.9), ("all", "b", 1, 0.8), ("mixed", "a", 1, 0.9), ("mixed", "a", 0, 0.7), ("mixed", "b", 0, 0.1), ("mixed", "b", 1, 0.2)]
    got = {r["g"]: r for r in metrics.metric_table(metric_rows(spark, rows), ["g"]).collect()}
    assert (got["all"]["macro_f1"], got["all"]["mcc"], got["all"]["specificity"]) == (1.0, 0.0, 0.0)
    assert got["mixed"]["accuracy"] == 0.5 and got["mixed"]["macro_f1"] == 0.5 and got["mixed"]["brier"] == pytest.approx((0.01 + 0.49 + 0.01 + 0.64) / 4)


def test_bootstrap_of_a_constant_has_no_spread(spark):
    rows = metric_rows(spark, [("g", str(i), 1, 0.9) for i in range(20)])
    for method in ("multinomial", "poisson"):
        got = bootstrap.intervals(rows, ["g"], "c", 50, method=method).collect()[0]
        assert got["accuracy_lo"] == pytest.approx(0) and got["accuracy_hi"] == pytest.approx(0) and got["accuracy_mean"] == 1.0
    mixed = metric_rows(spark, [("g", str(i % 7), i % 2, 0.9 if i % 3 else 0.1) for i in range(70)])
    got = bootstrap.intervals(mixed, ["g"], "c", 200).collect()[0]
    assert got["accuracy_ci_low"] <= got["accuracy_mean"] <= got["accuracy_ci_high"]


def test_threshold_and_calibration_invariants(spark):
    rows = spark.createDataFrame([("m", (i * 7) % 3 % 2, i % 11, (i % 11) / 10) for i in range(200)], "m string, y int, bucket int, p double")
    sweep = thresholds.sweep(rows, ["m"]).orderBy("threshold").collect()
    assert [r["threshold"] for r in sweep] == list(range(11)) and all(a["recall"] >= b["recall"] for a, b in zip(sweep, sweep[1:], strict=False))
    table = calibration.table(rows, ["m"]).collect()
    assert sum(r["count"] for r in table) == 200
    bins = spark.createDataFrame([(i / 10,) for i in range(11)], "p double").select(calibration.bin_index(F.col("p")).alias("b"))
    assert [r["b"] for r in bins.collect()] == [0, 1, 2, 2, 4, 5, 5, 6, 8, 9, 9]


def test_descriptive_statistics(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10)] + [("b", 5.0), ("c", None)], "k string, x double")
    got = {r["k"]: r for r in descriptive.statistics(rows, ["k"], "x").collect()}
    a = got["a"]
    assert (a["mean"], a["n"], a["median"], a["iqr"]) == (4.0, 5, 3.0, 2.0)
    assert a["std_dev"] == pytest.approx(3.5355339) and a["ci_upper"] - a["mean"] == pytest.approx(2.7764451 * 3.5355339 / 5**0.5)
    assert a["skewness"] == pytest.approx(1.6970563) and a["kurtosis"] == pytest.approx(3.152)
    assert (got["b"]["std_dev"], got["b"]["ci_lower"], got["b"]["skewness"]) == (0.0, 5.0, 0.0) and "c" not in got


def test_clustered_logistic_recovers_odds(spark):
    rows = [(i, f"p{i % 40}", "zero" if i % 2 else "dual", "m", 0.6, 8.0 if (i * 13) % 100 < (80 if i % 2 else 50) else 1.0, 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "ord int, patient_id string, shot_type string, model_canon string, temperature double, likelihood_score double, truth int")
    got = {r["term"]: r for r in inference.clustered_logistic(df).collect()}
    assert set(got) == {"Intercept", "shot_type[T.zero]"}
    right = {s: [r[5] == 8.0 for r in rows if r[2] == s] for s in ("zero", "dual")}
    odds = {s: sum(x) / (len(x) - sum(x)) for s, x in right.items()}
    assert got["shot_type[T.zero]"]["odds_ratio"] == pytest.approx(odds["zero"] / odds["dual"], rel=1e-6)
    assert inference.clustered_logistic(df.limit(10)).count() == 0


def variational(y, x, subject, rounds=200):
    """The same updates in a plain loop over rows: mean-field normals, ten-point quadrature by numpy."""
    import numpy as np

    at, weight = np.polynomial.hermite_e.hermegauss(15)
    weight = weight / weight.sum()
    m, s2, t, w = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1), 0.0, 0.01
    b, v = np.zeros(subject.max() + 1), np.full(subject.max() + 1, 0.5)

    def expected():
        mu = 1 / (1 + np.exp(-((x @ m + b[subject])[:, None] + np.sqrt(x**2 @ s2 + v[subject])[:, None] * at)))
        return mu @ weight, (mu * (1 - mu)) @ weight

    for _ in range(rounds):
        for _ in range(3):
            p, q = expected()
            precision = np.exp(-2 * t + 2 * w)
            bend = np.bincount(subject, q) + precision
            b, v = b + (np.bincount(subject, y - p) - precision * b) / bend, 1 / bend
        p, q = expected()
        bread = (x * q[:, None]).T @ x + np.eye(len(m)) / 4
        m, s2 = m + np.linalg.solve(bread, x.T @ (y - p) - m / 4), 1 / np.diag(bread)
        total = (b**2 + v).sum()
        for _ in range(50):
            pull = total * np.exp(-2 * t + 2 * w)
            t += (pull - len(b) - t) / (2 * pull + 1)
            w = 1 / (1 + 2 * total * np.exp(-2 * t + 2 * w))
    return m, np.sqrt(s2), t


def test_mixed_logistic_is_the_variational_fit(spark):
    import math
    import random

    import numpy as np

    rng = random.Random(5)
    rows = []
    for s in range(2000):
        own = rng.gauss(0, 1.0)
        for i in range(12):
            zero = i % 2
            p = 1 / (1 + math.exp(-(-0.3 + 0.9 * zero + own)))
            rows.append((i, f"p{s}", "zero" if zero else "dual", "m", 0.6, 8.0 if rng.random() < p else 1.0, 1))
    df = spark.createDataFrame(rows, "ord int, patient_id string, shot_type string, model_canon string, temperature double, likelihood_score double, truth int")
    got = {r["term"]: r for r in inference.mixed_logistic(df).collect()}
    assert got["shot_type[T.zero]"]["estimate_log_odds"] == pytest.approx(0.9, abs=0.1)
    assert got["subject_sd"]["estimate_log_odds"] == pytest.approx(1.0, abs=0.15)
    y = np.array([float(r[5] == 8.0) for r in rows])
    x = np.array([[1.0, float(r[2] == "zero")] for r in rows])
    m, sd, t = variational(y, x, np.array([int(r[1][1:]) for r in rows]))
    for k, term in enumerate(("Intercept", "shot_type[T.zero]")):
        assert got[term]["estimate_log_odds"] == pytest.approx(m[k], abs=0.005) and got[term]["posterior_sd"] == pytest.approx(sd[k], abs=0.002)
    assert got["subject_log_sd"]["estimate_log_odds"] == pytest.approx(t, abs=0.01) and got["subject_sd"]["estimate_log_odds"] == pytest.approx(math.exp(t), abs=0.01)
    assert inference.mixed_logistic(df.limit(10)).count() == 0


def test_correctness_by_either_path(spark):
    rows = spark.createDataFrame([(8.0, 1, "0"), (None, 0, "1"), (2.0, None, "1"), (0.7, 1, None)], "likelihood_score double, ground_truth int, truth_label string")
    assert [r["ok"] for r in inference.with_correctness(rows).collect()] == [1, 1, None, 0]
    assert [r["ok"] for r in inference.with_correctness(rows.drop("ground_truth")).collect()] == [0, 0, 0, None]
    made = rows.selectExpr("cast(ground_truth as double) y", "cast(null as int) bucket", "likelihood_score")
    assert [r["ok"] for r in inference.with_correctness(made).collect()] == [0, 1, None, 0]
    assert [r["ok"] for r in inference.with_correctness(rows.select("likelihood_score")).collect()] == [None] * 4



def test_mixed_logistic_settles_in_few_rounds_without_subject_effects(spark, monkeypatch):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(i, f"p{s}", "zero" if i % 2 else "dual", "m", 0.6, 8.0 if rng.random() < 0.5 else 1.0, 1) for s in range(300) for i in range(12)]
    df = spark.createDataFrame(rows, "ord int, patient_id string, shot_type string, model_canon string, temperature double, likelihood_score double, truth int")
    calls, whole = [], inference._subject_posterior
    monkeypatch.setattr(inference, "_subject_posterior", lambda *a: calls.append(1) or whole(*a))
    got = {r["term"]: r for r in inference.mixed_logistic(df).collect()}
    assert len(calls) <= 15
    # the fixed point: from its standard deviation the plain step leads back to it
    t = got["subject_log_sd"]["estimate_log_odds"]
    m = np.array([got[k]["estimate_log_odds"] for k in ("Intercept", "shot_type[T.zero]")])
    s2 = np.array([got[k]["posterior_sd"] for k in ("Intercept", "shot_type[T.zero]")]) ** 2
    w = got["subject_log_sd"]["posterior_sd"] ** 2
    b, v, node, share = np.zeros(300), np.full(300, 0.01), *np.polynomial.hermite_e.hermegauss(11)
    x = np.array([[1.0, float(r[2] == "zero")] for r in rows])
    y, of = np.array([float(r[5] == 8.0) for r in rows]), np.array([int(r[1][1:]) for r in rows])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-((x @ m + b[of])[:, None] + np.sqrt(x**2 @ s2 + v[of])[:, None] * node)))
        p, q = mu @ share / share.sum(), (mu * (1 - mu)) @ share / share.sum()
        bend = np.bincount(of, q) + np.exp(-2 * t + 2 * w)
        b, v = b + (np.bincount(of, y - p) - np.exp(-2 * t + 2 * w) * b) / bend, 1 / bend
    assert inference.log_sd_posterior(float((b * b + v).sum()), 300)[0] == pytest.approx(t, abs=1e-4)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_cube_parses_props_once_a_row(spark):
    from cubelens.operators import metrics
    from cubelens.plans.surrogate import cube

    rows = metrics.prepared(cube(spark, "/root/testdata/sf0.001")).where("bucket is not null").select("y", "bucket")
    assert optimized(rows).count("get_json_object") == 1


def test_subject_scores_are_summed_over_tasks(spark):
    import numpy as np

    x, mu = np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([0.5, 0.25])
    cells = [[(0, 2.0, 1.0), (1, 4.0, 3.0)], [(1, 4.0, 0.0)], [(0, 1.0, 1.0)]]
    df = spark.createDataFrame([(c,) for c in cells], "cells array<struct<k: bigint, n: double, good: double>>").repartition(3)
    got = {(r["i"], r["j"]): r["m"] for r in inference._subject_scores(df, x, mu).groupBy("i", "j").sum("m").withColumnRenamed("sum(m)", "m").collect()}
    want = [np.array([2.0, 2.0]), np.array([-1.0, -1.0]), np.array([0.5, 0.0])]
    meat = sum(np.outer(s, s) for s in want)
    assert got[-1, -1] == 3 and all(got[i, j] == pytest.approx(meat[i, j]) for i in range(2) for j in range(2))


def test_histograms_draw_once_for_a_list_of_values(spark, monkeypatch):
    from cubelens.operators import bootstrap

    rows = spark.createDataFrame([("m" if i % 3 else None, f"p{i % 4}" if i % 7 else None, float(i % 11), i % 2) for i in range(300)], "m string, c string, s double, y int")
    whole = sorted(map(str, bootstrap.histograms(rows, ["m"], "c", "s", n_boot=5).collect()))
    monkeypatch.setattr(bootstrap, "LISTED", 2)
    assert sorted(map(str, bootstrap.histograms(rows, ["m"], "c", "s", n_boot=5).collect())) == whole and whole


def test_multinomial_draws_meet_their_clusters_in_one_shuffle(spark):
    from cubelens.operators import bootstrap

    rows = spark.createDataFrame([("m", f"p{i}", i % 2, 0.9) for i in range(20)], "model string, c string, y int, p double")
    found = bootstrap.replicates(rows, ["model"], "c", 3)
    assert "count(1) AS w#" not in optimized(found) and [r["n"] for r in found.collect()] == [20] * 3


def test_topics_read_a_stored_sample(spark):
    from cubelens.operators import topics

    rows = spark.range(50).selectExpr("id as ord", "'a b' as t", "id % 2 = 0 as is_fp", "id % 2 = 1 as is_fn")
    found = topics.stored_sample(rows, "ord", ["t"])
    assert "parquet" in optimized(found) and "Range" not in optimized(found) and found.count() == 50 and found.columns == ["ord", "t", "is_fp", "is_fn", "outcome"]


def test_texts_are_searched_once_however_many_rows_hold_them(spark):
    from cubelens.operators import narrative

    flags = ("is_fp", "is_fn", "is_tp", "is_tn", "catastrophic", "other_error")
    rows = spark.range(40).selectExpr("concat('Crohn disease ', id % 2) as t", *[f"id % 4 = {i} as {f}" for i, f in enumerate(flags)])
    for found in (narrative.theme_prevalence(rows, "t", {"a": ["crohn"]}), narrative.deltas(rows, [], "t", {"a": ["crohn"]}), narrative.diverging(rows, "t", 1)):
        assert "regexp" not in optimized(found).rsplit("Aggregate", 1)[1].split("\n", 1)[1]  # below the first aggregate
    got = {r["outcome_group"]: (r["n_documents"], r["mean_density_per_100_tokens"]) for r in narrative.theme_prevalence(rows, "t", {"a": ["crohn"]}).collect()}
    assert got == {g: (10, 50.0) for g in ("False positive", "False negative", "True positive", "True negative")}
    assert {r["term"]: (r["fp_count"], r["fn_count"]) for r in narrative.diverging(rows, "t", 1).collect()} == {"crohn": (10, 10), "disease": (10, 10)}


def test_top_ngrams_shuffle_only_full_buckets(spark):
    from cubelens.operators import narrative

    texts = [f"Same words here. {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} KelvinK é{i}x {chr(97 + i * 7 % 26)}" for i in range(400)] + [None, "", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    low = df.selectExpr("lower(coalesce(t, '')) as low")
    for n in (1, 3):
        want = {}
        for t in texts:
            words = "".join(c if "a" <= c <= "z" else " " for c in (t or "").lower()).split()
            for i in range(len(words) - n + 1):
                want[" ".join(words[i : i + n])] = want.get(" ".join(words[i : i + n]), 0) + 1
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))
        for top in (1, 30):
            assert [(r["term"], r["count"]) for r in narrative.ngram_top(df, "t", n, top).collect()] == best[:top]
    assert narrative._heavy(low, 3, 1).count() < len(want) / 2
