"""The six stages as functions from DataFrames to named tables, and the run variants."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scores
from ..operators import bootstrap, calibration, descriptive, inference, linkage, metrics, narrative, prompts, ranges, thresholds, tiers, topics, truth, views
from ..roles import Roles
from ..shipping import ship
from ..sources import batches, sinks
from ..sources.config import AnalysisConfig, ClientConfig
from ..sources.scratch import stored
from ..streaming import incremental

Tables = dict[str, DataFrame]
ROLES = Roles(truth="ground_truth")


def data_prep(spark: SparkSession, cfg: AnalysisConfig) -> Tables:
    """Scan, normalise, view, summaries, reference join, truths."""
    ship(spark)
    parsed = batches.normalise(batches.read_batches(spark, cfg.batch_root), cfg.runner_metadata, cfg.model_mapping).persist()
    reference = batches.read_file(spark, cfg.reference_path, infer=True)
    merged, counts = linkage.merge_reference(parsed, reference, cfg.id_column)
    markers = {d: c for d, c in (cfg.document_flag_columns or K.FLAG_COLUMNS).items() if c in merged.columns}
    if markers:
        merged = truth.document_truth(merged, markers=markers, into="_document_sequence_truth_lenient")
        merged = truth.document_truth(merged, markers=markers, strict=True, into="_document_sequence_truth_strict")
        merged = truth.subject_truth(merged, markers=markers, into="patient_truth")
    view = views.validation_view(merged.where(F.col("report_sequence_name").isNotNull()), cfg.validation_level, ROLES)
    return {
        "parsed_outputs": parsed, "merged_outputs": view.persist(), "llm_json_processing_summary": descriptive.parse_summary(parsed, ROLES),
        "merge_processing_summary": descriptive.merge_summary(parsed, merged.where("folder is not null"), ROLES), "merge_counts": counts,
        "total_study_cohort": descriptive.cohort(parsed, {"patients": cfg.id_column, "experiments": "experiment_name", "runners": "runner_name", "models": "model_canon"}),
    }


def dropout(summary: DataFrame) -> Tables:
    """Folder percents by attribute."""
    return {"dropout_summary": descriptive.with_strings(descriptive.breakdown(summary, ["total_success_percent", "no_repair_percent", "schema_valid_percent", "percent_ge_5"]))}


def with_truth(cube: DataFrame, mode: str) -> tuple[DataFrame, Roles | None]:
    """(rows, roles with the truth column of the mode); no roles where the mode has no labels."""
    rows, column = truth.prepare_truth(cube, mode)
    return rows, Roles(truth=column) if column else None


def missingness_threshold(cube: DataFrame, mode: str = "patient") -> Tables:
    """Missingness, dropout, sweeps, tiers and calibration; what needs a truth is left out without one."""
    context = ["temperature", "shot_type", "report_sequence_name", "model_canon"]
    out = {
        "missingness_summary": descriptive.missingness(cube), "overall_numeric_summary": descriptive.numeric_describe(cube, ["likelihood_score", "certainty_score", "complexity_score"]),
        "model_level_summary": descriptive.score_means(cube, ["model_canon"]), "grouped_summary": descriptive.score_means(cube, ["model_canon", "report_sequence_name", "shot_type", "temperature"]),
        "dropout_by_factor": descriptive.dropout(cube, [[c] for c in context] + [["report_sequence_name", "temperature"], ["model_canon", "temperature"]]),
    }
    rows, roles = with_truth(cube, mode)
    if roles is None:
        return out
    have = metrics.prepared(rows, roles).where("bucket is not null").withColumn("model_pool", scores.model_pool(F.col("model_canon")))
    for name, keys in (("model", ["model_canon"]), ("model_temperature", ["model_canon", "temperature"]), ("model_pool", ["model_pool"])):
        out[f"macro_f1_threshold_curves_by_{name}"] = thresholds.sweep(have, keys)
        out[f"best_thresholds_by_{name}"] = metrics.by_metric(thresholds.best(have, keys), "best_macro_f1")
    fixed = thresholds.fixed_tiers(have, ["model_canon", "temperature", "report_sequence_name"])
    return out | {
        "basic_threshold_performance": fixed, "basic_threshold_pivot": thresholds.tier_pivot(fixed),
        "bucket_summary": descriptive.bucket_summary(have, [], roles).orderBy("bucket"), "grey_zone_3_6_summary": descriptive.bucket_summary(have.where("bucket between 3 and 6"), [], roles).orderBy("bucket"),
        "bucket_summary_by_model_pool": descriptive.bucket_summary(have, ["model_pool"], roles).orderBy(scores.pool_order(F.col("model_pool")), "model_pool", "bucket"), "macro_f1_by_certainty_bucket_model_pool": descriptive.certainty_f1(have, ["model_pool"], roles),
        "calibration_table": calibration.table(have, ["model_canon"]), "calibration_summary_by_model": metrics.by_metric(calibration.summary(have, ["model_canon"]), "brier"),
        "calibration_summary_by_pool": calibration.summary(have, ["model_pool"]).orderBy(scores.pool_order(F.col("model_pool")), "model_pool"),
    }


def full_performance(cube: DataFrame, mode: str = "patient", n_boot: int = 1000, seed: int = 42, skip_temperature: bool = True, method: str = "poisson") -> Tables:
    """Factor tables, primary estimand and strict sensitivity with clustered intervals, paired tests and the logistic models."""
    rows, roles = with_truth(cube, mode)
    if roles is None:
        return {}
    policies = metrics.policy_rows(metrics.prepared(rows, roles), roles)
    skip = {"temperature"} if skip_temperature else frozenset()
    keys = ["denominator", "factor", "value"]
    arms = lambda long, by: bootstrap.with_intervals(long, by, roles.subject, n_boot, seed, method)
    out = {
        "overall_performance_by_factor_fair": arms(metrics.factor_rows(policies, roles, skip), keys),
        "primary_estimand": arms(metrics.primary_rows(rows, roles), ["scope", roles.model, roles.temperature]),
        "mcnemar_model_pairs": inference.mcnemar_pairs(rows, roles), "mixed_effects_correctness": inference.mixed_logistic(rows, roles), "clustered_logistic_correctness": inference.clustered_logistic(rows, roles),
    }
    if "_document_sequence_truth_strict" in rows.columns:
        strict = metrics.policy_rows(metrics.prepared(rows, roles, "_document_sequence_truth_strict"), roles, ("all_attempts", "complete_case"))
        out["strict_marker_sensitivity"] = arms(metrics.factor_rows(strict, roles, skip), keys)
    return out


def narrative_analysis(cube: DataFrame, column: str, mode: str = "patient") -> Tables:
    rows, roles = with_truth(cube, mode)
    if roles is None:
        return {}
    flagged = narrative.flagged(rows, roles)
    cues = narrative.deltas(flagged, [roles.model], column, K.CUES)
    out = {
        "reasoning_cue_deltas_all_models": cues, "narrative_error_mechanisms": narrative.mechanisms(cues, roles.model), "theme_prevalence_by_outcome": narrative.theme_prevalence(flagged, column, K.THEMES),
        "heuristic_theme_skew": narrative.theme_skew(flagged, column, K.THEMES).orderBy(F.desc("skew_score")),
        "certainty_error_rates": narrative.certainty_error_rates(flagged, roles).orderBy("model"), "catastrophic_failure_rates": narrative.catastrophic_rates(flagged, roles).orderBy("model"),
        "top_examples": narrative.top_examples(flagged, [roles.subject, column, roles.score], roles),
    }
    for n in (1, 3, 5):
        for side in ("fp", "fn"):
            out[f"ngrams_{n}_{side}"] = narrative.ngram_top(flagged.where(f"is_{side}"), column, n)
    for factor in ("shot_type", "model", "temperature", "report_sequence_name"):
        for name, lexicon in (("cue", K.CUES), ("heuristic_theme", K.THEMES)):
            out[f"{factor}_{name}_deltas"] = narrative.factor_deltas(rows, factor, column, lexicon, roles)
    return out | topics.section(flagged, column, roles.order)


def tiered_performance(cube: DataFrame, n_boot: int = 1000, seed: int = 42, chart_truth: str = "ground_truth", method: str = "poisson") -> Tables:
    """The four tiers; document and cumulative resample subjects, the subject tiers their rows, which are subjects."""
    def arms(rows: DataFrame, by: list[str], cluster: str) -> DataFrame:
        return bootstrap.with_intervals(rows, by, cluster, n_boot, seed, method).withColumn("model_display", scores.model_label(F.col("model_canon")))

    keys = ["denominator", "model_canon", "shot_type", "temperature"]
    out = {}
    per_row = {"document": tiers.document_rows(cube), "cumulative": tiers.cumulative_rows(cube)}
    for name, rows in per_row.items():
        out[f"{name}_overall"] = arms(rows, keys, "patient_id")
        out[f"{name}_per_data_type"] = arms(rows, [*keys, "report_sequence_name"], "patient_id")
    for name, label in (("final", "patient_truth"), ("doc2patient", chart_truth)):
        if label in cube.columns:
            rows = tiers.subject_rows(cube, label)
            out[f"{name}_overall"] = arms(rows, keys, "patient_id")
            cluster = rows.withColumn("_row", F.concat_ws("|", "patient_id", "shot_type", F.col("temperature").cast("string")))
            out[f"{name}_per_model"] = arms(cluster, keys[:2], "_row")
    return out


# Where the narrative's tables stand once more, and how their columns are called there.
MIRROR = {
    "reasoning_cue_deltas_all_models": "reasoning_audit",
    "narrative_error_mechanisms": "error_profiles",
    "certainty_error_rates": "error_profiles",
    "catastrophic_failure_rates": "error_profiles",
    "theme_prevalence_by_outcome": "heuristic_themes/full_context",
    "heuristic_theme_skew": "heuristic_themes/full_context",
    "topic_skew_lda": "topic_models/full_context",
    "topic_skew_nmf": "topic_models/full_context",
    "shot_topic_skew_lda": "comparisons/by_shot_type",
    "shot_type_cue_deltas": "comparisons/by_shot_type",
    "model_cue_deltas": "comparisons/by_model",
    "temperature_cue_deltas": "comparisons/by_temperature",
    "report_sequence_name_cue_deltas": "comparisons/by_clinical_context",
}
HEADERS = {
    "fp_weight": "false_positive_topic_share",
    "fn_weight": "false_negative_topic_share",
    "skew_score": "false_positive_minus_false_negative_skew",
    "top_terms": "top_topic_terms",
    "zero": "zero_shot",
    "single": "single_shot",
    "dual": "dual_shot",
    "high_minus_low_error_rate": "high_certainty_minus_low_certainty_error_rate",
}


def run_all(spark: SparkSession, cfg: AnalysisConfig, column: str = "full_response") -> Tables:
    """Every stage over one persisted fact table; each table is written below the output folder."""
    out = data_prep(spark, cfg)
    try:
        cube = out["merged_outputs"]
        out |= dropout(out["llm_json_processing_summary"]) | missingness_threshold(cube, cfg.truth_mode)
        out |= full_performance(cube, cfg.truth_mode, cfg.bootstrap_iterations, cfg.random_seed, not cfg.enable_temperature_analysis)
        out |= narrative_analysis(cube, column, cfg.truth_mode) | tiered_performance(cube, cfg.bootstrap_iterations, cfg.random_seed)
        sinks.write_tables(out, cfg.output_dir)
        sinks.mirror_tables(spark, cfg.output_dir, "narrative_outputs", MIRROR, HEADERS)
    finally:
        release(out)
    return out


def release(tables: Tables) -> None:
    """Give back what ``data_prep`` holds in memory."""
    for held in ("parsed_outputs", "merged_outputs"):
        if held in tables:
            tables[held].unpersist()


VIEWS = (("document", "document"), ("cumulative", "document"), ("final", "patient"), ("doc2patient", "patient"))


def run_views(spark: SparkSession, cfg: AnalysisConfig) -> dict[str, Tables]:
    """The pipeline once for each validation level with its truth mode."""
    return {level: run_all(spark, cfg.variant(level, mode)) for level, mode in VIEWS}


def run_experiments(spark: SparkSession, cfg: ClientConfig, respond: incremental.Respond = incremental.stub) -> DataFrame:
    """Link the sources, ask every runner of every experiment about each case, batch by batch, and go on where a run ended.

    Cases are numbered in order, and ``batch_size`` of them are a batch. ``batches_per_commit`` batches are one Spark job
    over all runners and experiments: its rows go to ``responses/runner_name=/experiment_name=/batch=``, a line for each
    call to ``manifest``, and last a line for each runner and experiment to ``commits``, which says how many cases it
    has answered. A later run begins at the batch after those, whatever an ended job has left: its partitions are
    overwritten. A batch that was not full is asked again once there are more cases. Cases without any report are left out.
    If the configuration saves spreadsheets or CSV, all answers stand beside their cases as files in ``batches`` too.
    """
    ship(spark)
    names = {"primary": ("patient_id", "sample_received_date", "result_report"), "secondary": ("patient_id", "procedure_date", "Combined_Content"), "context_notes": ("patient_id", "date_creation", "clean_content")}
    read = {k: batches.read_source(spark, s["path"], s["id_column"], s["date_column"], s["text_column"], s.get("date_format"), names[k]) for k, s in cfg.sources.items() if k in names}
    cases = linkage.chronology(read["primary"], read["secondary"], read["context_notes"], cfg.band_days, cfg.window_days, cfg.max_cases)
    cases = stored(ranges.numbered(cases, [], ["patient_id", "procedure_date"], "row_index"), "cases")
    n, size = cases.count(), cfg.batch_size
    cases = cases.withColumn("batch", F.floor(F.col("row_index") / size).cast("int"))

    out, log, manifest = (f"{cfg.output_dir}/{x}" for x in ("responses", "commits", "manifest"))
    done = sinks.answered(spark, log)
    asked = prompts.experiments(spark, cfg.prompt_templates, cfg.report_sequences)
    pairs = [(r, cfg.runners[r].url, e["experiment_name"]) for r in cfg.active() for e in asked.select("experiment_name").collect()]  # a configuration's size
    todo = [(r, url, e, done.get((r, e), 0) // size) for r, url, e in pairs if done.get((r, e), 0) < n]
    if todo:
        work = asked.join(F.broadcast(spark.createDataFrame(todo, "runner_name string, url string, experiment_name string, from_batch int")), "experiment_name")
        fit = prompts.budgeted(functools.partial(prompts.TokenizerFile, cfg.tokenizer) if cfg.tokenizer else prompts.Words, cfg.token_limit)
        policy = incremental.CallPolicy(cfg.max_retries, cfg.retry_delay_seconds, cfg.timeout_seconds, cfg.calls_at_once, cfg.calls_per_second)
        for low in range(min(t[3] for t in todo), -(-n // size), cfg.batches_per_commit):
            high = low + cfg.batches_per_commit
            part = cases.where(F.col("batch").between(low, high - 1)).crossJoin(F.broadcast(work)).where("batch >= from_batch")
            part = part.withColumn("sections", prompts.sections(F.col("report_sequence"), F.col("context_note_timing"))).where(prompts.rendered(F.col("sections")) != "")
            part = part.withColumn("m", fit(F.col("prompt_content"), F.col("sections")))
            part = part.select(
                "runner_name", "url", "experiment_name", "batch", "row_index", "patient_id", "episode_id", "prompt_name", "report_sequence_name", "report_sequence", "context_note_timing", F.sha2("prompt_content", 256).alias("prompt_template_sha256"),
                F.col("m.message").alias("message"), F.col("m.truncated").alias("truncated"), F.array_join("m.truncated_sections", ",").alias("truncated_sections"),
            )
            rows = incremental.respond_to(spread(part), respond, policy=policy, endpoint="runner_name")
            sinks.write_partitions(rows, out, ["runner_name", "experiment_name", "batch"])
            reach = [(r, e, low, high - 1, min(high * size, n)) for r, _, e, first in todo if first < high]
            mine = spark.read.parquet(out).where(F.col("batch").between(low, high - 1)).join(F.broadcast(work.select("runner_name", "experiment_name", "from_batch")), ["runner_name", "experiment_name"]).where("batch >= from_batch")
            sinks.append_lines(sinks.call_lines(mine, cfg.token_limit), manifest)
            sinks.append_lines(spark.createDataFrame(reach, sinks.COMMIT).select(F.to_json(F.struct("*")).alias("value")).coalesce(1), log)
    if cfg.save_format != "parquet":
        sinks.export_answers(spark.read.parquet(out), cases.drop("batch", "row_index"), f"{cfg.output_dir}/batches", cfg.save_format)
    return spark.read.parquet(out)


def spread(df: DataFrame) -> DataFrame:
    """Over all tasks, in rows and not in bytes: calls take long and messages are short."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
