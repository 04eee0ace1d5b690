"""Hostile responses, statistics against closed forms, batches, stage folders and call limits."""

from __future__ import annotations

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from cubelens.functions import jsonrepair, scores, stats, text
from cubelens.operators import bootstrap, inference, metrics, prompts
from cubelens.sources import sinks
from cubelens.streaming import incremental


def test_bad_responses_never_raise(spark):
    deep = "[" * 100_000 + "]" * 100_000
    texts = [deep, '{"a": ' + deep + "}", '{"Likelihood of IBD": 1' + "0" * 400 + ', "Certainty Level": 5, "Complexity of Case": 5}', '{"OUTCOME": {"Likelihood of IBD": NaN}}', None, "```json\n{\n```"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(jsonrepair.parse_response("t").alias("r")).collect()
    assert [r["r"]["repair_type"] for r in got[:3]] == ["unparseable", "unparseable", "schema_invalid"]
    assert "out_of_range:Likelihood of IBD" in got[2]["r"]["schema_errors"]


def test_scores_that_are_words_are_null(spark):
    rows = [(x,) for x in ("0.0", "0.3", "0.7", "3", "7.4", "9.6", "15", "bad", None, "NaN")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(scores.clean_likelihood(F.col("s"))).collect()]
    assert got == [0, 0, 1, 3, 7, 10, None, None, None, None]


def test_ticks_and_temperature_groups(spark):
    assert scores.numeric_ticks(0.13, 0.88, 0.25) == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert scores.numeric_ticks(0.5, 0.5, 0.5) == [0.5, 1.0] and scores.numeric_ticks(math.nan, 1, 0.1) == []
    got = spark.createDataFrame([(0.5,), (0.6,), (0.75,), (1.0,), (2.0,), (None,)], "t double").select(scores.temperature_group(F.col("t"))).collect()
    assert [r[0] for r in got] == ["low", "midlow", "midhigh", "high", None, None]


def test_mcnemar_is_the_binomial_tail(spark):
    pairs = [(0, 0), (0, 1), (3, 9), (10, 10), (40, 60), (500, 560), (0, 900), (40_000, 41_000), (10**8, 10**8 + 30_000)]

    def exact(a, b):
        n, k = a + b, min(a, b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0

    got = spark.createDataFrame(pairs, "a long, b long").select(stats.mcnemar_p(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(pairs[:7], got, strict=False):
        assert r[0] == pytest.approx(exact(a, b), rel=1e-9)
    for (a, b), r in zip(pairs[7:], got[7:], strict=True):  # the normal law with its correction
        z = (abs(a - b) - 1) / math.sqrt(a + b)
        assert r[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=0.02)


def test_densities_count_every_keyword_alone(spark):
    rng = random.Random(41)
    lexicon = {"x": ["known", "known crohn", "crohn", "no active", "?", "follow-up"], "y": ["active", "up", "crohn known", "follow up"]}
    parts = ["known", "Crohn", "no", "active", "?", "a?b", "follow-up", "follow", "up", "upper", "\n", "  ", ".", "é", "colitis"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "   ", "known" * 3]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.densities(F.col("t"), lexicon).alias("d")).collect()
    for t, r in zip(texts, got, strict=True):
        low = (t or "").lower()
        words = max(1, len(re.findall(r"\b[a-z]{2,}\b", low)))
        want = {f: 100.0 * sum(len(re.findall(text.keyword_pattern(k), low)) for k in ks) / words if low.strip() else 0.0 for f, ks in lexicon.items()}
        assert {x["family"]: x["value"] for x in r["d"]} == pytest.approx(want), t


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_batches_are_full_whatever_the_partitions(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        for parts in (1, 8):
            rows = spark.range(29).repartition(parts).withColumn("k", 28 - F.col("id"))
            got = sinks.with_batches(rows, 3, ["k"]).collect()
            assert sorted((r["k"], r["batch"]) for r in got) == [(k, k // 3) for k in range(29)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sinks.with_batches(spark.range(0), 3, ["id"]).count() == 0


def test_tables_of_an_earlier_run_go(spark, tmp_path):
    root, t = f"{tmp_path}/out", spark.range(2)
    sinks.write_tables({"a": t, "b": t}, root, stage="one")
    sinks.write_tables({"c": t}, root, stage="two")
    index = sinks.write_tables({"a": t}, root, stage="one")
    assert {(r["table"], r["stage"]) for r in index.collect()} == {("a", "one"), ("c", "two")}
    assert not sinks.exists(spark, f"{root}/b") and sinks.read_table(spark, root, "b", "c").count() == 2 and sinks.read_table(spark, root, "b") is None
    sinks.write_tables({"d": t}, root)
    assert not sinks.exists(spark, f"{root}/a") and not sinks.exists(spark, f"{root}/c")
    sinks.write_json({"a": [1]}, f"{root}/x/y.json")
    assert spark.read.json(f"{root}/x/y.json", multiLine=True).first()["a"] == [1]


def test_calls_end_at_their_timeout():
    began = time.time()
    slow = incremental.CallPolicy(retries=2, wait=0.01, timeout=0.2)
    assert [r[0] for r in incremental.call_each(lambda m: time.sleep(5) or m, ["a", "b"], slow)] == [incremental.FAILED] * 2
    assert time.time() - began < 4 and incremental.call_one(lambda m: [x.upper() for x in m], "a", incremental.CallPolicy(timeout=5)) == ("A", 1, None)


def test_bootstrap_of_any_metric(spark):
    rng = random.Random(42)
    rows = [("m", i % 40, rng.random(), int(rng.random() < 0.4)) for i in range(800)]
    frame = spark.createDataFrame(rows, "k string, c int, x double, y int")
    got = bootstrap.metric_interval(frame, ["k"], "c", {"xs": F.col("x") * F.col("y"), "n": F.col("y")}, F.try_divide(F.col("xs"), F.col("n")), n_boot=300).first()
    point = sum(x * y for _, _, x, y in rows) / sum(y for *_, y in rows)
    assert got["low"] < point < got["high"] and got["mean"] == pytest.approx(point, abs=0.01) and got["high"] - got["low"] < 0.2
    again = bootstrap.metric_interval(frame.repartition(5), ["k"], "c", {"xs": F.col("x") * F.col("y"), "n": F.col("y")}, F.try_divide(F.col("xs"), F.col("n")), n_boot=300).first()
    assert again["low"] == pytest.approx(got["low"]) and bootstrap.metric_interval(frame.limit(0), ["k"], "c", {"n": F.col("y")}, F.col("n")).count() == 0


def test_fixed_effects_of_the_logistic_models(spark):
    rng = random.Random(43)
    rows = [(f"p{i % 50}", i % 2, rng.choice([1.0, 8.0]), m, s, q, t, i) for i, (m, s, q, t) in enumerate((rng.choice("AB"), rng.choice(["zero", "single"]), rng.choice(["hist", "endo"]), rng.choice([0.5, 0.75])) for _ in range(600))]
    frame = spark.createDataFrame(rows, "patient_id string, truth int, likelihood_score double, model_canon string, shot_type string, report_sequence_name string, temperature double, ord int")
    terms = lambda df: {r["term"] for r in df.collect()}
    assert terms(inference.clustered_logistic(frame)) == {"Intercept", "model_canon[T.B]", "shot_type[T.zero]", "report_sequence_name[T.hist]"}
    alone = frame.where("model_canon = 'A'")
    assert "temperature_group[T.midhigh]" in terms(inference.clustered_logistic(alone)) and "temperature_group[T.midhigh]" in terms(inference.mixed_logistic(alone))


def test_primary_rows_have_intervals(spark):
    rows = [(f"p{i}", i % 2, float(i % 10), "mixtral7b", "zero", "all_docs_in_sequence", 0.75, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "patient_id string, truth int, likelihood_score double, model_canon string, shot_type string, report_sequence_name string, temperature double, ord int")
    got = bootstrap.with_intervals(metrics.primary_rows(frame), ["scope", "model_canon", "temperature"], "patient_id", 50, method="poisson").collect()
    assert {(r["scope"], r["model_canon"], r["n"]) for r in got} == {("pooled", None, 40), ("by_model", "mixtral7b", 40)}
    assert all(r["accuracy_lo"] >= 0 and r["accuracy_hi"] >= 0 and r["accuracy_lo"] + r["accuracy_hi"] > 0 for r in got)
    assert [r["brier"] for r in metrics.by_metric(spark.createDataFrame([(0.3,), (0.1,)], "brier double"), "brier").collect()] == [0.1, 0.3]


def test_budgets_by_a_tokenizer_file(spark):
    tokenizer = prompts.Words()
    message, cut, which = prompts.fit("T", [("A", "one two three"), ("B", "word " * 500)], tokenizer, 120)
    assert cut and which == ["B"] and len(tokenizer.encode(message)) <= 120 and "one two three" in message


def test_payloads_as_dotted_columns(spark):
    rows = [('{"a": 1, "b": {"c": "x", "d": {"e": [1, 2]}}, "f": {}}',), ("not json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(jsonrepair.flattened(F.col("p"))).collect()]
    assert got == [{"a": "1", "b.c": "x", "b.d.e": "[1,2]", "f": "{}"}, {}, {}]


def test_hashes_and_columns_of_a_run(spark, tmp_path):
    import hashlib

    from cubelens import roles
    from cubelens.sources import batches

    (tmp_path / "a.bin").write_bytes(b"abc")
    assert batches.file_hashes(spark, f"{tmp_path}/a.bin").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert roles.full_context_column(["x", "clues_text", "full_response"]) == "full_response" and roles.full_context_column(["x"]) is None


def test_mirror_of_written_tables(spark, tmp_path):
    root, t = f"{tmp_path}/out", spark.createDataFrame([(1, 0.5)], "a int, skew_score double")
    sinks.write_tables({"x": t, "y": t}, root)
    for layout in ({"x": "one/two", "gone": "z"}, {"y": "one"}):
        index = sinks.mirror_tables(spark, root, "clean", layout, {"skew_score": "skew"})
    assert [r["table"] for r in index.collect()] == ["y"] and not sinks.exists(spark, f"{root}/clean/one/two/x")
    assert spark.read.parquet(f"{root}/clean/one/y").columns == ["a", "skew"] and sinks.read_table(spark, root, "y").columns == t.columns


def test_topic_shares_are_of_all_weights(spark):
    from cubelens.operators import topics

    rows = [("fp", [1.0, 3.0]), ("fp", [0.0, 4.0]), ("fn", [2.0, 2.0])]
    got = topics.table(spark.createDataFrame(rows, "outcome string, weights array<double>"), [["a"], ["b"]]).collect()
    assert [(r["topic"], r["fp_weight"], r["fn_weight"]) for r in got] == [("One", 0.875, 0.5), ("Zero", 0.125, 0.5)]
    assert got[0]["skew_score"] == pytest.approx(0.375 / 1.375) and got[0]["exploratory_signal"] and got[1]["top_terms"] == "a"
