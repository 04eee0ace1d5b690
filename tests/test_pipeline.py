"""Sources, sinks, configuration, streaming and the stages end to end on a synthetic corpus."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from cubelens.plans import pipeline
from cubelens.sources import batches, config, sinks, spreadsheets, synthetic
from cubelens.streaming import incremental

RUNNERS = ("mixtral_t075", "qwen32_t060")
EXPERIMENTS = ("zero_shot_hist", "zero_shot_endo", "zero_shot_all_docs_in_sequence", "single_shot_hist")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    people = synthetic.patients(spark, 30)
    for r in RUNNERS:
        for e in EXPERIMENTS:
            synthetic.batch(people, r, e).coalesce(1).write.parquet(f"{root}/run/{r}/{e}/tmp")
            part = next((root / "run" / r / e / "tmp").glob("part-*.parquet"))
            part.rename(root / "run" / r / e / "batch_0.parquet")
    synthetic.document_flags(people).write.parquet(f"{root}/reference.parquet")
    return root


def analysis(root, **more):
    return config.AnalysisConfig(f"{root}/run", f"{root}/reference.parquet", f"{root}/out", bootstrap_iterations=10, **more)


def test_scan_and_normalise(spark, corpus):
    assert len(batches.find_batches(spark, f"{corpus}/run")) == 8
    rows = batches.normalise(batches.read_batches(spark, f"{corpus}/run"))
    got = rows.select("runner_name", "model_canon", "temperature", "shot_type", "report_sequence_name", "display_model").distinct().collect()
    assert {(r["model_canon"], r["temperature"]) for r in got} == {("mixtral7b", 0.75), ("qwen32b", 0.6)} and len(got) == 8
    assert {r["display_model"] for r in got} == {"mixtral7b_t0_75", "qwen32b_t0_60"}
    tags = {r["json_repair_type"]: r["count"] for r in rows.groupBy("json_repair_type").count().collect()}
    assert sum(tags.values()) == 240 and tags["raw_valid_json"] > 180 and set(tags) <= {"raw_valid_json", "extracted_embedded_json", "empty"}
    assert rows.where("json_parse_success = 1 and likelihood_score is null").count() == 0
    with pytest.raises(FileNotFoundError):
        batches.read_batches(spark, f"{corpus}/nothing")


def test_csv_source_quirks(spark, tmp_path):
    (tmp_path / "s.csv").write_text('id,day,say\n p1 ,2024-01-05,"a, ""b"""\n,2024-01-06,\np2,not a date,x\n')
    got = batches.read_source(spark, str(tmp_path / "s.csv"), "id", "day", "say", "yyyy-MM-dd", ("patient_id", "d", "t")).orderBy("d").collect()
    assert [(r["patient_id"], r["t"]) for r in got] == [("P1", 'a, "b"'), ("NAN", "")]


def test_response_columns():
    got = batches.response_columns(["r_Json_Response_e", "r_Full_Response_e", "r_Payload_e", "Truncated_e", "Truncated_Sections_e", "x"])
    assert {k: len(v) for k, v in got.items()} == {"json": 1, "full": 1, "payload": 1, "truncated": 2}


def test_all_stages(spark, corpus):
    out = pipeline.run_all(spark, analysis(corpus))
    names = {"parsed_outputs", "llm_json_processing_summary", "dropout_summary", "missingness_summary", "best_thresholds_by_model", "overall_performance_by_factor_fair", "primary_estimand", "mcnemar_model_pairs", "narrative_error_mechanisms", "document_overall", "cumulative_overall", "final_per_model", "doc2patient_overall", "strict_marker_sensitivity"}
    assert names <= set(out)
    perf = spark.read.parquet(f"{corpus}/out/overall_performance_by_factor_fair").collect()
    assert perf and all(0 <= r["accuracy"] <= 1 and r["accuracy_lo"] >= -1e-9 for r in perf)
    assert {r["factor"] for r in perf} == {"shot_type", "model", "data_type"}
    assert spark.read.parquet(f"{corpus}/out/output_index").count() == len(out)
    final = out["final_per_model"].where("denominator = 'all_attempts'").collect()
    assert {r["n"] for r in final} == {60} and all(r["recall"] > 0.5 for r in final)


def test_document_mode_has_no_fallback(spark, corpus):
    rows = batches.normalise(batches.read_batches(spark, f"{corpus}/run"))
    assert pipeline.full_performance(rows, "document") == {} and "calibration_table" not in pipeline.missingness_threshold(rows, "document")


def test_views_change_only_configuration(corpus):
    cfg = analysis(corpus).variant("final", "patient")
    assert (cfg.validation_level, cfg.truth_mode) == ("final", "patient") and cfg.output_dir.endswith("out_final_patient")


def test_configuration_errors(tmp_path):
    with pytest.raises(config.ConfigError):
        config.AnalysisConfig("a", "b", "c", truth_mode="other")
    (tmp_path / "c.json").write_text(json.dumps({"batch_root": "x", "reference_path": "y"}))
    with pytest.raises(config.ConfigError, match="output_dir"):
        config.load_analysis(str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text(json.dumps({"batch_root": "x", "reference_path": "y", "output_dir": "z"}))
    assert config.load_analysis(str(tmp_path / "c.json")).batch_root == str(tmp_path / "x")
    with pytest.raises(config.ConfigError):
        config.load_analysis(str(tmp_path / "none.json"))


def client(root, spark, **more):
    people = synthetic.patients(spark, 6)
    for name, df in synthetic.sources(people).items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    day = "yyyy-MM-dd HH:mm:ss"
    ids = {"id_column": "patient_id", "date_format": day}
    sources = {
        "primary": {"path": f"{root}/primary.parquet", "date_column": "sample_received_date", "text_column": "result_report", **ids},
        "secondary": {"path": f"{root}/secondary.parquet", "date_column": "procedure_date", "text_column": "Combined_Content", **ids},
        "context_notes": {"path": f"{root}/notes.parquet", "date_column": "date_creation", "text_column": "clean_content", **ids},
    }
    runners = {f"r{i}": config.Runner(f"R{i}", "http://x", i != 1) for i in range(3)}
    return config.ClientConfig(sources, runners, {"zero": "Judge."}, {"all_docs": ["PRIMARY REPORT", "ENDOSCOPY REPORT"], "hist": ["PRIMARY REPORT"]}, f"{root}/answers", **more)


def test_a_configuration_in_sections_runs(spark, tmp_path):
    people = synthetic.patients(spark, 6)
    for name, df in synthetic.sources(people).items():
        spreadsheets.write(df.coalesce(1), f"{tmp_path}/{name}")
    (tmp_path / "zero.txt").write_text("Judge.")
    source = lambda name, date, text, **more: {"path": f"./{name}/part-00000.xlsx", "patient_id_column": "patient_id", "date_column": date, "text_column": text, **more}
    raw = {
        "general": {"batch_size": 4, "version": "v1", "output_dir": "./out", "max_parallel_runners": 2, "max_retries": 2, "retry_delay_seconds": 0, "tokenizer_encoding": "x"},
        "data_sources": {
            "primary_reports": source("primary", "sample_received_date", "result_report", label="PRIMARY REPORT", date_format=None), "secondary_reports": source("secondary", "procedure_date", "Combined_Content", label="SECONDARY REPORT"),
            "clinic_letters": source("notes", "date_creation", "clean_content", preceding_label="A", following_label="B"),
        },
        "matching": {"max_days_between_primary_and_secondary": 2}, "prompt_templates": {"zero": "zero.txt"}, "report_sequences": {"both": ["PRIMARY REPORT", "SECONDARY REPORT"]},
        "runner_endpoints": {"r0": {"enabled": True, "display_name": "R0", "url": "http://x"}, "r1": {"enabled": False}},
    }
    at = tmp_path / "client.json"
    at.write_text(json.dumps(raw))
    cfg = config.load_client(str(at))
    assert cfg.save_format == "xlsx" and cfg.output_dir == f"{tmp_path}/out/v1" and list(cfg.active()) == ["r0"] and cfg.prompt_templates == {"zero": "Judge."}
    assert pipeline.run_experiments(spark, cfg).count() == 6
    assert sorted(p.name for p in (tmp_path / "out/v1/batches/r0/zero_shot_both").glob("*.xlsx")) == ["batch_0.xlsx", "batch_1.xlsx"]
    broken = [("general", "version", "version"), ("data_sources", "primary_reports", "primary"), ("prompt_templates", None, "prompt_templates")]
    for section, key, said in broken:
        less = json.loads(json.dumps(raw))
        less.pop(section) if key is None else less[section].pop(key)
        at.write_text(json.dumps(less))
        with pytest.raises(config.ConfigError, match=said):
            config.load_client(str(at))
    at.write_text(json.dumps(raw | {"prompt_templates": {"zero": "gone.txt"}}))
    with pytest.raises(config.ConfigError, match="zero"):
        config.load_client(str(at))
    at.write_text(json.dumps(raw | {"general": raw["general"] | {"save_format": "doc"}}))
    with pytest.raises(config.ConfigError, match="save_format"):
        config.load_client(str(at))


def test_date_formats_with_percent_codes(spark):
    assert batches.spark_format("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm" and batches.spark_format("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH" and batches.spark_format("dd.MM.yyyy") == "dd.MM.yyyy"
    with pytest.raises(ValueError):
        batches.spark_format("%Q")


def test_experiments_resume(spark, tmp_path):
    cfg = client(tmp_path, spark, batch_size=2)
    assert list(cfg.active()) == ["r0", "r2"]
    first = pipeline.run_experiments(spark, cfg)
    assert first.count() == 6 * 2 * 2 and first.where("json_response like '%Likelihood%'").count() == 24
    assert sinks.next_batch(spark, f"{cfg.output_dir}/responses") == 3
    assert pipeline.run_experiments(spark, cfg, lambda m: 1 / 0).count() == 24  # nobody is asked again
    cases = spark.read.parquet(cfg.sources["secondary"]["path"]).select("patient_id", "procedure_date").withColumn("episode_id", F.concat_ws("::", "patient_id", F.date_format("procedure_date", "yyyy-MM-dd")))
    sinks.export_answers(first, cases, f"{tmp_path}/export")
    wide = batches.read_batches(spark, f"{tmp_path}/export")
    assert wide.count() == 24 and len(list((tmp_path / "export/r0/zero_shot_hist").glob("batch_*.xlsx"))) == 3
    assert batches.normalise(wide).where("json_parse_success = 1 and likelihood_score is not null").count() == 24
    lines = sinks.read_manifest(spark, f"{cfg.output_dir}/manifest")
    assert lines.count() == 24 and lines.where("message_sha256 is null or batch_number != row_index div 2").count() == 0
    with pytest.raises(config.ConfigError):
        client(tmp_path, spark, max_parallel_runners=9)
    with pytest.raises(config.ConfigError):
        client(tmp_path, spark, batches_per_commit=0)


def answers(spark, root):
    names = ["runner_name", "experiment_name", "batch", "row_index", "episode_id", "message", "full_response", "json_response", "attempts", "error"]
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/responses").select(*names).collect())


def test_a_run_that_ends_in_its_third_batch_goes_on_there(spark, tmp_path):
    whole = client(tmp_path / "whole", spark, batch_size=1, batches_per_commit=1)
    pipeline.run_experiments(spark, whole)
    cut = client(tmp_path / "cut", spark, batch_size=1, batches_per_commit=1)
    jobs, write = [], sinks.write_partitions

    def ends(df, root, by):
        jobs.append(1)
        write(df, root, by)
        if len(jobs) == 3:  # its rows stand, its commit is missing
            raise KeyboardInterrupt

    sinks.write_partitions = ends
    try:
        with pytest.raises(KeyboardInterrupt):
            pipeline.run_experiments(spark, cut)
    finally:
        sinks.write_partitions = write
    assert set(sinks.answered(spark, f"{cut.output_dir}/commits").values()) == {2}
    seen = spark.sparkContext.accumulator(0)

    def respond(messages):
        seen.add(len(messages))
        return incremental.stub(messages)

    pipeline.run_experiments(spark, cut, respond)
    assert seen.value == 4 * 2 * 2  # four of six batches, two runners, two experiments
    assert answers(spark, cut.output_dir) == answers(spark, whole.output_dir)


def test_a_batch_that_was_not_full_is_asked_again_with_more_cases(spark, tmp_path):
    few = client(tmp_path, spark, batch_size=4, max_cases=5)
    pipeline.run_experiments(spark, few)
    more = client(tmp_path, spark, batch_size=4)
    pipeline.run_experiments(spark, more)
    found = answers(spark, more.output_dir)
    assert len(found) == len({f[:4] for f in found}) == 6 * 2 * 2 and set(sinks.answered(spark, f"{more.output_dir}/commits").values()) == {6}


def test_one_bad_message_fails_alone(spark):
    def respond(messages):
        if messages[0] == "message 77":
            raise RuntimeError("no")
        if messages[0] == "message 78":
            time.sleep(60)
        return ["  "] if messages[0] == "message 79" else incremental.stub(messages)

    cases = spark.createDataFrame([(i, f"message {i}") for i in range(200)], "id int, message string").repartition(2)
    began = time.time()
    got = incremental.respond_to(cases, respond, policy=incremental.CallPolicy(2, 0.01, 1.0, 8)).collect()
    assert time.time() - began < 40
    bad = {r["id"]: r for r in got if r["error"] is not None}
    assert len(got) == 200 and set(bad) == {77, 78, 79}
    assert all(r["full_response"] == r["json_response"] == incremental.FAILED and r["attempts"] == 2 for r in bad.values())
    assert "no" in bad[77]["error"] and "Timeout" in bad[78]["error"] and "empty" in bad[79]["error"]
    assert all(r["attempts"] == 1 and "Likelihood" in r["json_response"] for r in got if r["id"] not in bad)


def test_calls_are_tried_again_and_paced():
    tries, pauses = [], []

    def flaky(messages):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return ["{}"]

    policy = incremental.CallPolicy(retries=3, wait=1.0)
    assert incremental.call_one(flaky, "a", policy, pauses.append) == ("{}", 3, None) and pauses == [1.0, 2.0]
    assert incremental.call_one(lambda m: 1 / 0, "a", incremental.CallPolicy(2, 0), lambda s: None)[:2] == (incremental.FAILED, 2)
    starts = []
    each = {"x": lambda m: starts.append(("x", time.monotonic())) or ["x"], "y": lambda m: starts.append(("y", time.monotonic())) or ["y"]}
    got = incremental.call_each(each, list("abcdef"), incremental.CallPolicy(), list("xyxyxy"), incremental.Pace(0.1))
    assert [g[0] for g in got] == list("xyxyxy") and incremental.call_each(each, [], incremental.CallPolicy()) == []
    for name in "xy":
        at = sorted(t for n, t in starts if n == name)
        assert all(b - a > 0.08 for a, b in zip(at, at[1:], strict=False))


def test_streaming_answers_only_new_cases(spark, tmp_path):
    cases = spark.createDataFrame([(i, f"message {i}") for i in range(5)], "id int, message string")
    cases.write.parquet(f"{tmp_path}/in")
    for expect in (5, 5):
        stream = incremental.read_cases(spark, f"{tmp_path}/in", "id int, message string")
        incremental.run_available(stream, incremental.stub, f"{tmp_path}/out", f"{tmp_path}/mark")
        assert spark.read.parquet(f"{tmp_path}/out").count() == expect
    cases.where("id = 0").write.mode("append").parquet(f"{tmp_path}/in")
    incremental.run_available(incremental.read_cases(spark, f"{tmp_path}/in", "id int, message string"), incremental.stub, f"{tmp_path}/out", f"{tmp_path}/mark")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_streaming_summaries_match_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    rows = spark.read.parquet(src).select("ts", F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("likelihood_score"), F.col("value").alias("certainty_score"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = incremental.start_summary(incremental.dropout_counts(stream, ["model"]), f"{tmp_path}/out", f"{tmp_path}/mark")
    query.awaitTermination()
    got = {(str(r["window"]["start"]), r["model"]): (r["n"], r["dropped"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(str(r["window"]["start"]), r["model"]): (r["n"], r["dropped"]) for r in rows.groupBy(F.window("ts", "1 day"), "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("likelihood_score").isNull()).alias("dropped")).collect()}
    assert got and got.items() <= want.items()  # windows behind the watermark are closed


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, [str(i)]) for i in range(23)], "id int, tags array<string>")
    sinks.write_table(df, f"{tmp_path}/c", "csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 23
    numbered = sinks.with_batches(df, 5, ["id"]).collect()
    assert max(sum(r["batch"] == b for r in numbered) for b in {r["batch"] for r in numbered}) <= 5 and sorted(r["id"] for r in numbered) == list(range(23))
    sinks.write_batches(sinks.with_batches(df, 10, ["id"]), f"{tmp_path}/b", "r", "e", ["id"])
    assert sinks.next_batch(spark, f"{tmp_path}/b") == 3 and sinks.next_batch(spark, f"{tmp_path}/none") == 0
    assert batches.read_batches(spark, f"{tmp_path}/b").where("runner_name = 'r' and experiment_name = 'e'").count() == 23
    for _ in range(2):
        sinks.write_table(df, f"{tmp_path}/x", "xlsx")
    assert spreadsheets.read(spark, f"{tmp_path}/x").count() == 23
    with pytest.raises(ValueError):
        sinks.write_table(df, f"{tmp_path}/y", "doc")
    sinks.write_json({"a": 1}, f"{tmp_path}/j/x.json")
    assert json.loads((tmp_path / "j/x.json").read_text()) == {"a": 1}
