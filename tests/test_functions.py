"""Scores, names, JSON repair, text and statistics."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from cubelens.functions import jsonrepair, scores, stats, text
from cubelens.roles import first_existing, with_columns, without_nan


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_likelihood(spark):
    got = one(spark, [0.0, 0.3, 0.7, 3.0, 7.4, 9.6, 15.0, None, math.nan, -1.0, 10.0, 1.0, 2.5], scores.clean_likelihood, "double")
    assert got == [0, 0, 1, 3, 7, 10, None, None, None, None, 10, 1, 3]
    assert one(spark, ["3", "bad", "7f", "1d", " 4.5 ", "1e1", None], scores.to_number) == [3.0, None, None, None, 4.5, 10.0, None]


def test_probability_and_predictions(spark):
    assert one(spark, [0, 5, 10, 15, None], scores.probability, "int") == [0.0, 0.5, 1.0, 1.0, None]
    assert one(spark, [0, 4, 5, None], scores.prediction, "int") == [0, 0, 1, 0]
    assert one(spark, [0, 4, 5, None], lambda c: scores.prediction(c, missing="drop"), "int") == [0, 0, 1, None]
    with pytest.raises(ValueError):
        scores.prediction(F.lit(1), missing="other")


def test_combined_truths_and_markers(spark):
    rows = spark.createDataFrame([(1, 0), (0, None), (None, 1), (None, None)], "a int, b int")
    assert [r[0] for r in rows.select(scores.combine_truths(F.col("a"), F.col("b"))).collect()] == [1, 0, 1, None]
    assert one(spark, ["true", "Yes", "y", "Y", "N", "1", "0.0", "2", None], scores.coerce_marker) == [1, None, None, 1, 0, 1, 0, None, None]


def test_names(spark):
    names = ["model_t075", "model_t060", "deepseek14_t05_runner", "mixtral_t1_runner", "no_temp_here", "x_t0_75", "x_t100"]
    assert one(spark, names, scores.temperature_from_name) == [0.75, 0.6, 0.5, 1.0, None, 0.75, 1.0]
    assert one(spark, ["deepseek_r1_14b", " MIXTRAL ", "other ", "Key"], lambda c: scores.canonical_model(c, {"key": "mapped"})) == ["deepseek14b", "mixtral7b", "other", "mapped"]
    assert one(spark, ["a_b-c  d", "", "X"], scores.sentence_case) == ["A b c d", "", "X"]
    assert one(spark, ["mixtral_7b", "foo-12b", "strange name"], scores.model_label) == ["Mixtral-7B (2024)", "Foo-12B", "Strange name"]
    assert one(spark, ["hist_endo", "endo_clinic_following"], scores.sequence_label) == ["Histology / Endoscopy narrative order", "Endoscopy / Clinic letter / Following narrative order"]
    assert one(spark, ["0.50", "1.0", "0_75", None, "odd"], scores.temperature_label) == ["0.5", "1", "0.75", "Missing", "odd"]
    assert one(spark, ["a b/c", "__x__"], scores.slug) == ["a_b_c", "x"]


def test_percent_cells(spark):
    assert one(spark, ["3/4 (75.0%)", "0.25", "40", "true", "n/a", None], scores.parse_percent) == [75.0, 25.0, 40.0, 100.0, None, None]
    assert one(spark, [5, 0], lambda c: scores.count_percent(c, F.lit(16)), "int") == ["5/16 (31.2%)", "0/16 (0.0%)"]


def test_folder_labels_round_trip(spark):
    rows = spark.createDataFrame([("deepseek14b_t0_50_zero_shot_all_docs_in_sequence",), ("free text",)], "f string")
    got = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in scores.folder_parts(F.col("f")).items()]).collect()]
    assert got == [("deepseek14b", "0_50", "zero", "all_docs_in_sequence"), (None, None, None, None)]


GOOD = '{"OUTCOME": {"Likelihood of IBD": 7, "Certainty Level": 5, "Complexity of Case": 3}}'


@pytest.mark.parametrize(
    ("raw", "tag"),
    [
        (GOOD, "raw_valid_json"), (f"Sure: {GOOD} bye", "extracted_embedded_json"), (GOOD[:-1], "repaired_json"), (GOOD.replace('"', "“"), "raw_valid_json"),
        (GOOD.replace("3}", "3,}"), "repaired_json"), ("plain words", "unparseable"), ("", "empty"), (None, "empty"), (GOOD.replace("7", "99"), "schema_invalid"),
        (f"```json\n{GOOD}\n```", "raw_valid_json"), ("[1, 2]", "unparseable"), ('{"a": [1, {"b": "}"', "unparseable"), ('{"a": [1, 2', "schema_invalid"),
    ],
)
def test_repair_tags(raw, tag):
    payload, got, valid, errors = jsonrepair.parse(raw)
    assert got == tag and valid == (tag in ("raw_valid_json", "extracted_embedded_json", "repaired_json")) and bool(errors) == (tag == "schema_invalid")
    assert payload is None or isinstance(json.loads(payload), dict)


def test_native_brackets_agree_with_python(spark):
    texts = ['{"a": "}{", "b": [1, 2', "{", "x", '{"a": "un', '{"q": "\\"{"', "[[{"]
    assert one(spark, texts, text.balanced) == [jsonrepair.close_brackets(t) for t in texts]


def test_nested_scores_are_read_only_when_asked(spark):
    got = one(spark, [GOOD], lambda c: F.struct(jsonrepair.payload_number(c, "Certainty Level").alias("a"), jsonrepair.payload_number(c, "Certainty Level", True).alias("b")))[0]
    assert (got["a"], got["b"]) == (None, 5.0)


def test_text(spark):
    assert one(spark, ["The  cat's 2 mats", None], text.word_tokens) == [["the", "cat", "s", "mats"], []]
    assert one(spark, [["a", "b", "c"], ["a"]], lambda c: text.ngrams(c, 2), "array<string>") == [["a b", "b c"], []]
    assert one(spark, ["Known  Crohn disease, crohn", " "], lambda c: F.round(text.density(c, ["known crohn", "crohn"]), 4)) == [75.0, 0.0]
    assert one(spark, ["say ```json\n{\"a\": 1}\n``` end", "x {\"b\": 2} y", "none"], text.client_json) == ['{"a": 1}', '{"b": 2}', None]


def test_statistics(spark):
    assert [round(stats.t_quantile(0.975, d), 4) for d in (1, 10, 30)] == [12.7062, 2.2281, 2.0423]
    rows = spark.createDataFrame([(10, 2), (0, 0), (3, 3), (1500, 1400)], "a int, b int")
    got = [r[0] for r in rows.select(stats.mcnemar_p(F.col("a"), F.col("b"))).collect()]
    exact = min(1.0, 2 * sum(math.comb(12, k) for k in range(3)) / 2**12)
    assert got[0] == pytest.approx(exact) and got[1] == 1.0 and got[2] == 1.0 and 0 < got[3] < 1


def test_roles(spark):
    assert first_existing(["b", "a"], ("a", "b")) == "a" and first_existing([], ("a",)) is None
    df = without_nan(spark.createDataFrame([(math.nan,), (1.0,)], "x double"))
    assert [r["x"] for r in df.collect()] == [None, 1.0]
    assert with_columns(df, {"y": "int"}).columns == ["x", "y"]
