"""Named queries over the driver's tables, each with its DuckDB counterpart.

Measures are rounded to 6 places on both sides, after all arithmetic.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import jsonrepair, scores, text
from ..shipping import ship
from ..operators import bootstrap, calibration, descriptive, inference, linkage, metrics, narrative, prompts, ranges, thresholds, tiers, topics, truth, views
from ..sources import batches, scratch, sinks, spreadsheets
from ..streaming import incremental
from .surrogate import CUBE, MACRO_F1, MCC, POINT, PREPARED, bucket_sql, cube, point_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _r(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    """Doubles rounded to 6 places, -0.0 as 0.0."""
    return df.select(*keys, *[((F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)) for c, kind in df.dtypes if c not in keys])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["fair_factor_metrics"](spark, sf_dir)


# ---- scores, names and labels -------------------------------------------------------------------------------------


@query("clean_likelihood", f"WITH {CUBE}, v AS (SELECT ord, unnest([likelihood_score, k::DOUBLE / 40, k::DOUBLE / 8, -likelihood_score]) AS raw, unnest([0, 1, 2, 3]) AS part FROM cube) SELECT ord, part, {bucket_sql('raw')} AS bucket, round({bucket_sql('raw')}::DOUBLE / 10, 6) AS probability FROM v")
def _(spark: SparkSession, d: str) -> DataFrame:
    raws = F.array(F.col("likelihood_score"), F.col("k").cast("double") / 40, F.col("k").cast("double") / 8, -F.col("likelihood_score"))
    rows = cube(spark, d).select("ord", F.posexplode(raws).alias("part", "raw"))
    bucket = scores.clean_likelihood(F.col("raw"))
    return rows.select("ord", "part", bucket.alias("bucket"), F.round(scores.probability(bucket), 6).alias("probability"))


@query("predictions", f"WITH {CUBE}, v AS (SELECT ord, {bucket_sql('likelihood_score')} AS b FROM cube) SELECT ord, coalesce((b >= 5)::INT, 0) AS pred_negative, (b >= 5)::INT AS pred_drop FROM v")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = scores.clean_likelihood(F.col("likelihood_score"))
    return cube(spark, d).select("ord", scores.prediction(b).alias("pred_negative"), scores.prediction(b, missing="drop").alias("pred_drop"))


@query("coerce_binary", f"WITH {CUBE} SELECT ord, (certainty_score >= 5)::INT AS certain, truth AS truth_flag FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = scores.coerce_binary(cube(spark, d), "certainty_score", into="certain")
    return scores.coerce_binary(rows, "truth", into="truth_flag").select("ord", "certain", "truth_flag")


@query("combine_truths", f"WITH {CUBE} SELECT ord, CASE WHEN endoscopy_ibd_flag = 1 OR histology_ibd_flag = 1 THEN 1 WHEN endoscopy_ibd_flag IS NOT NULL OR histology_ibd_flag IS NOT NULL THEN 0 END AS either FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    return cube(spark, d).select("ord", scores.combine_truths(F.col("endoscopy_ibd_flag"), F.col("histology_ibd_flag")).alias("either"))


@query("coerce_marker", """SELECT event_id, v AS raw, CASE WHEN v IN ('true', 'TRUE', 'yes', 'Y', '1', '1.0') THEN 1 WHEN v IN ('false', 'FALSE', 'no', 'N', '0') THEN 0 END AS flag
FROM (SELECT event_id, ['true', 'FALSE', 'yes', 'no', 'Y', 'N', 'Yes', 'y', '1', '0', '2', '1.0', 'maybe', NULL][event_id % 14 + 1] AS v FROM events)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    values = F.array(*map(F.lit, ["true", "FALSE", "yes", "no", "Y", "N", "Yes", "y", "1", "0", "2", "1.0", "maybe", None]))
    rows = _table(spark, d, "events").select("event_id", values[(F.col("event_id") % 14).cast("int")].alias("raw"))
    return rows.select("event_id", "raw", scores.coerce_marker(F.col("raw")).alias("flag"))


@query("temperature_from_name", f"WITH {CUBE}, v AS (SELECT ord, temperature AS want, CASE i % 3 WHEN 0 THEN runner_name WHEN 1 THEN model_canon || '_t' || CASE temperature WHEN 0.5 THEN '050' WHEN 0.6 THEN '060' WHEN 0.75 THEN '075' WHEN 1.0 THEN '100' ELSE '090' END || '_x' ELSE CASE WHEN temperature = 1.0 THEN model_canon || '_t1' ELSE 'no_temp_here' END END AS name, i FROM cube) SELECT ord, name, CASE WHEN name = 'no_temp_here' THEN NULL ELSE want END AS temperature FROM v")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("temperature")
    digits = F.when(t == 0.5, "050").when(t == 0.6, "060").when(t == 0.75, "075").when(t == 1.0, "100").otherwise("090")
    last = F.when(t == 1.0, F.concat("model_canon", F.lit("_t1"))).otherwise("no_temp_here")
    name = F.when(F.col("ord") % 3 == 0, F.col("runner_name")).when(F.col("ord") % 3 == 1, F.concat("model_canon", F.lit("_t"), digits, F.lit("_x"))).otherwise(last)
    return cube(spark, d).select("ord", name.alias("name")).withColumn("temperature", scores.temperature_from_name(F.col("name")))


@query("model_canonical", """SELECT p_partkey, CASE WHEN n LIKE 'deepseek%' THEN 'deepseek' || regexp_extract(n, '(\\d+)b', 1) || 'b' WHEN n LIKE 'mix%' THEN 'mixtral7b' WHEN n LIKE 'qwen%' THEN 'qwen32b' WHEN n LIKE 'special%' THEN 'mapped' ELSE trim(p_name) END AS model
FROM (SELECT p_partkey, p_name, lower(CASE p_partkey % 5 WHEN 0 THEN 'DeepSeek-R1-' || [14, 32, 70][p_partkey % 3 + 1] || 'B' WHEN 1 THEN 'mixtral-' || p_name WHEN 2 THEN 'Qwen 2.5 32b' WHEN 3 THEN ' Special ' ELSE p_name END) AS n0, ltrim(n0) AS n FROM part)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    size = F.array(*map(F.lit, ["14", "32", "70"]))[(key % 3).cast("int")]
    name = F.when(key % 5 == 0, F.concat(F.lit("DeepSeek-R1-"), size, F.lit("B"))).when(key % 5 == 1, F.concat(F.lit("mixtral-"), "p_name")).when(key % 5 == 2, "Qwen 2.5 32b").when(key % 5 == 3, " Special ").otherwise(F.col("p_name"))
    return _table(spark, d, "part").select("p_partkey", scores.canonical_model(name, {"special": "mapped"}).alias("model"))


@query("folder_labels", f"WITH {CUBE} SELECT DISTINCT folder, model_canon AS model, replace(printf('%.2f', temperature), '.', '_') AS temperature, shot_type AS shot, report_sequence_name AS data_type FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = scores.folder_label(scores.display_model(F.col("runner_name"), F.col("runner_name"), F.col("model_canon"), F.col("temperature")), F.col("shot_type"), F.col("report_sequence_name"))
    return cube(spark, d).select(made.alias("folder")).distinct().withColumns(scores.folder_parts(F.col("folder"))).select("folder", "model", "temperature", "shot", "data_type")


@query("experiment_parts", f"WITH {CUBE} SELECT DISTINCT experiment_name, shot_type, report_sequence_name, CASE shot_type WHEN 'zero' THEN 0 WHEN 'single' THEN 1 ELSE 2 END AS icl_shots FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    shot, sequence = scores.experiment_parts(F.col("experiment_name"))
    return cube(spark, d).select("experiment_name").distinct().select("experiment_name", shot.alias("shot_type"), sequence.alias("report_sequence_name"), scores.icl_shots(shot).alias("icl_shots"))


@query("percent_parse", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN round((event_id % 50) * 2.0, 6) WHEN 1 THEN round((event_id % 100) / 100.0 * 100, 6) WHEN 2 THEN 40.5 END::DOUBLE AS pct FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    cell = F.when(i % 4 == 0, scores.count_percent(i % 50, F.lit(50))).when(i % 4 == 1, F.format_string("%.2f", (i % 100) / 100)).when(i % 4 == 2, "40.5").otherwise("n/a")
    return _table(spark, d, "events").select("event_id", F.round(scores.parse_percent(cell), 6).alias("pct"))


@query("labels_display", f"""WITH {CUBE} SELECT DISTINCT model_canon, report_sequence_name, shot_type, temperature,
  CASE model_canon {" ".join(f"WHEN '{m}' THEN '{K.MODEL_NAMES[m]}'" for m in ("mixtral7b", "m42_8b", "deepseek32b", "qwen32b", "gemma4_31b"))} END AS model_label,
  CASE shot_type WHEN 'zero' THEN 'Zero shot' WHEN 'single' THEN 'Single shot' ELSE 'Dual shot' END AS shot_label,
  CASE temperature WHEN 0.5 THEN '0.5' WHEN 0.6 THEN '0.6' WHEN 0.75 THEN '0.75' WHEN 1.0 THEN '1' ELSE '0.9' END AS temperature_label,
  CASE WHEN model_canon LIKE 'gemma%' THEN 'Gemma (2026)' WHEN model_canon LIKE 'qwen%' OR model_canon LIKE 'deepseek%' THEN 'Thinking (2025)' ELSE 'Non-thinking (2024)' END AS pool,
  upper(report_sequence_name[1]) || replace(report_sequence_name[2:], '_', ' ') AS data_type_label FROM cube""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).select("model_canon", "report_sequence_name", "shot_type", "temperature").distinct()
    return rows.select("*", scores.model_label(F.col("model_canon")).alias("model_label"), scores.shot_label(F.col("shot_type")).alias("shot_label"), scores.temperature_label(F.col("temperature")).alias("temperature_label"), scores.model_pool(F.col("model_canon")).alias("pool"), scores.sentence_case(F.col("report_sequence_name")).alias("data_type_label"))


@query("outcome_flags", f"""WITH {CUBE}, {PREPARED}, v AS (SELECT *, coalesce((bucket >= 5)::INT, 0) AS pred FROM prepared)
SELECT ord, pred = 1 AND y = 0 AS is_fp, pred = 0 AND y = 1 AS is_fn, pred = 1 AND y = 1 AS is_tp, pred = 0 AND y = 0 AS is_tn, pred <> y AS is_error, coalesce(certainty_score >= 7, false) AS high_certainty,
 coalesce(certainty_score < 7, false) AS low_certainty, coalesce(likelihood_score <= 2 OR likelihood_score >= 8, false) AS is_extreme, pred <> y AND coalesce(certainty_score >= 7, false) AND coalesce(likelihood_score <= 2 OR likelihood_score >= 8, false) AS catastrophic FROM v""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.prepared(cube(spark, d))
    return rows.select("ord", *[c.alias(n) for n, c in scores.outcome_flags(F.col("y"), F.col("bucket"), F.col("likelihood_score"), F.col("certainty_score")).items()])


# ---- responses ----------------------------------------------------------------------------------------------------


@query("json_repair_tags", f"WITH {CUBE} SELECT ord, tag AS repair_type, tag IN ('raw_valid_json', 'extracted_embedded_json', 'repaired_json') AS schema_valid, CASE WHEN tag IN ('empty', 'unparseable') THEN NULL WHEN i % 8 = 7 THEN 99.0 ELSE (k % 11)::DOUBLE END AS likelihood, CASE WHEN tag NOT IN ('empty', 'unparseable') THEN (k % 10)::DOUBLE END AS certainty, CASE WHEN tag = 'schema_invalid' THEN 'out_of_range:Likelihood of IBD' ELSE '' END AS errors FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).select("ord", jsonrepair.parse_response("full_response").alias("r"))
    return rows.select("ord", "r.repair_type", "r.schema_valid", jsonrepair.payload_number(F.col("r.payload"), "Likelihood of IBD").alias("likelihood"), jsonrepair.payload_number(F.col("r.payload"), "Certainty Level").alias("certainty"), F.array_join("r.schema_errors", ",").alias("errors"))


@query("json_native_repair", f"WITH {CUBE} SELECT ord, CASE i % 8 WHEN 2 THEN replace(full_response, '\"c\"],}}', '\"c\"]}}') WHEN 3 THEN full_response || '}}' WHEN 5 THEN trim(replace(replace(full_response, '```json', ''), '```', ''), chr(10)) WHEN 4 THEN '   ' ELSE full_response END AS repaired, i % 8 IN (0, 1, 2, 5, 7) AND i % 8 <> 2 AS client_ok FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    plain = text.fence_body(text.straight_quotes(F.col("full_response")))
    return cube(spark, d).select("ord", text.balanced(text.without_trailing_commas(plain)).alias("repaired"), text.client_json(F.col("full_response")).isNotNull().alias("client_ok"))


@query("prompt_section_extract", f"WITH {CUBE} SELECT ord, CASE WHEN i % 3 = 0 THEN '' ELSE 'clue ' || k END AS clues, CASE WHEN i % 3 = 0 THEN '' ELSE 'because ' || i END AS reasoning FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, i = F.col("k").cast("string"), F.col("ord").cast("string")
    said = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("**CLUES:** only "), k)).otherwise(F.concat(F.lit("**CLUES:**\n clue "), k, F.lit("\n**REASONING:** because "), i, F.lit(" \n**OUTCOME:** {}")))
    clues, why = text.prompt_sections(said)
    return cube(spark, d).select("ord", clues.alias("clues"), why.alias("reasoning"))


@query("token_count", "SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))::INT AS tokens, sha256(text) AS digest FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", text.token_count(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("digest"))


# ---- truth and views ----------------------------------------------------------------------------------------------

_FLAGS = {d: c for d, c in K.FLAG_COLUMNS.items()}


def _truth_sql(sets: dict[str, tuple[str, ...]], strict: bool = False) -> str:
    cases = []
    for s, ds in sets.items():
        cols = [_FLAGS[x] for x in ds]
        best = f"greatest({', '.join(cols)})" if len(cols) > 1 else cols[0]
        cases.append(f"WHEN '{s}' THEN " + (f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in cols)} THEN {best} END" if strict else best))
    return f"(CASE report_sequence_name {' '.join(cases)} END)::DOUBLE"


_SHOWN = {s: K.TRUTH_DOCUMENTS[s] for s in K.TRUTH_DOCUMENTS if s in K.DOCUMENT_SETS} | {s: truth.documents_of(s) for s in K.DOCUMENT_SETS}


@query("document_truth", f"WITH {CUBE} SELECT ord, {_truth_sql(_SHOWN)} AS lenient, {_truth_sql(_SHOWN, True)} AS strict FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = list(K.DOCUMENT_SETS)
    rows = truth.document_truth(cube(spark, d), sequences=names, into="lenient")
    return truth.document_truth(rows, sequences=names, strict=True, into="strict").select("ord", "lenient", "strict")


_ANY = f"greatest({', '.join(_FLAGS.values())})"


@query("patient_truth", f"WITH {CUBE} SELECT patient_id, max({_ANY})::DOUBLE AS patient_truth, count(*) AS n FROM cube GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = truth.subject_truth(cube(spark, d))
    return rows.groupBy("patient_id").agg(F.max("patient_truth").alias("patient_truth"), F.count(F.lit(1)).alias("n"))


@query("tier_truths", f"WITH {CUBE} SELECT ord, CASE WHEN report_sequence_name IN ({', '.join(repr(s) for s in K.SINGLE_DOCUMENT)}) THEN 'document' ELSE 'cumulative' END AS tier, {_truth_sql({s: (x,) for s, x in K.SINGLE_DOCUMENT.items()})} AS document_truth, {_truth_sql({s: K.DOCUMENT_SETS[s] for s in K.MULTI_DOCUMENT})} AS cumulative_truth FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    return truth.tier_truths(cube(spark, d)).select("ord", "tier", "document_truth", "cumulative_truth")


_VIEW_KEYS = "patient_id, runner_name, model_canon, shot_type, temperature"
_VIEW_SQL = f"""SELECT {_VIEW_KEYS}{{seq}}, max(bucket)::DOUBLE AS likelihood_score, max(certainty_score) FILTER (r = 1) AS certainty_score, max(complexity_score) FILTER (r = 1) AS complexity_score,
  bool_or(truncated) AS truncated, max(ord) FILTER (r = 1) AS ord, count(*) AS rows_in, coalesce(string_agg(Combined_Content, chr(10) || chr(10) ORDER BY ord) FILTER (f = 1), '') AS Combined_Content FROM ranked GROUP BY {_VIEW_KEYS}{{seq}}"""
_SINGLE = f"single AS (SELECT *, {bucket_sql('likelihood_score')} AS bucket FROM cube WHERE report_sequence_name IN ({', '.join(repr(s) for s in K.SINGLE_DOCUMENT)}))"
_RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(bucket, -1) DESC, ord) AS r, row_number() OVER (PARTITION BY {keys}, Combined_Content ORDER BY ord) AS f FROM {source})"""
_MEMBERS = ", ".join(f"('{s}', '{m}')" for s, x in K.SINGLE_DOCUMENT.items() for m in K.MULTI_DOCUMENT if x in K.DOCUMENT_SETS[m])


def _view(df: DataFrame, spark_keys: list[str], rows: DataFrame) -> DataFrame:
    n = rows.groupBy(*spark_keys).agg(F.count(F.lit(1)).alias("rows_in"))
    return df.join(n, spark_keys).select(*spark_keys, "likelihood_score", "certainty_score", "complexity_score", "truncated", "ord", "rows_in", "Combined_Content")


@query("cumulative_view", f"WITH {CUBE}, {_SINGLE}, member(s, m) AS (VALUES {_MEMBERS}), long AS (SELECT single.* REPLACE (m AS report_sequence_name) FROM single JOIN member ON report_sequence_name = s), {_RANKED.format(keys=_VIEW_KEYS + ', report_sequence_name', source='long')} {_VIEW_SQL.format(seq=', report_sequence_name')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d)
    keys = [*_VIEW_KEYS.split(", "), "report_sequence_name"]
    of = F.coalesce(*[F.when(F.col("report_sequence_name") == s, F.array(*[F.lit(m) for m in K.MULTI_DOCUMENT if x in K.DOCUMENT_SETS[m]])) for s, x in K.SINGLE_DOCUMENT.items()])
    long = rows.withColumn("report_sequence_name", F.explode(of))
    return _view(views.cumulative(rows), keys, long)


@query("patient_view", f"WITH {CUBE}, {_SINGLE}, {_RANKED.format(keys=_VIEW_KEYS, source='single')} {_VIEW_SQL.format(seq='')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d)
    return _view(views.per_subject(rows), _VIEW_KEYS.split(", "), rows.where(F.col("report_sequence_name").isin(*K.SINGLE_DOCUMENT)))


@query("validation_views", f"WITH {CUBE} SELECT 'document' AS level, count(*) AS n FROM cube WHERE report_sequence_name IN ({', '.join(repr(s) for s in K.SINGLE_DOCUMENT)}) UNION ALL SELECT 'none', count(*) FROM cube UNION ALL SELECT 'final', count(*) FROM (SELECT DISTINCT {_VIEW_KEYS} FROM cube WHERE report_sequence_name IN ({', '.join(repr(s) for s in K.SINGLE_DOCUMENT)}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d)
    out = [views.validation_view(rows, level).agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n")) for level in ("document", "none", "final")]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---- performance --------------------------------------------------------------------------------------------------

_FACTOR_CASES = """
factors AS (
  SELECT *, unnest(list_filter([
    CASE WHEN temp AND seq THEN {'factor': 'shot_type', 'value': shot_type} END, CASE WHEN zero AND temp AND seq THEN {'factor': 'model', 'value': model_canon} END,
    CASE WHEN zero AND seq THEN {'factor': 'temperature', 'value': temperature::VARCHAR} END, CASE WHEN zero AND temp THEN {'factor': 'data_type', 'value': report_sequence_name} END], lambda x: x IS NOT NULL)) AS pair
  FROM (SELECT *, shot_type = 'zero' AS zero, temperature IN (0.5, 0.6, 0.75, 1.0) AS temp, report_sequence_name IN ('all_docs_in_sequence', 'endo', 'hist', 'clinic_preceding', 'clinic_following') AS seq FROM policy)
), long AS (SELECT denominator, pair.factor AS factor, pair.value AS value, y, p FROM factors)
"""


@query("fair_factor_metrics", f"WITH {CUBE}, {PREPARED}, {_FACTOR_CASES} {point_sql('denominator, factor, value', 'long')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.factor_metrics(cube(spark, d)), ["denominator", "factor", "value", "n"])


@query("policy_rows", f"WITH {CUBE}, {PREPARED} SELECT denominator, count(*) AS n, round(avg(p), 6) AS mean_p FROM policy GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.policy_rows(metrics.prepared(cube(spark, d))).groupBy("denominator").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


_PRIMARY = " OR ".join(f"(model_canon = '{m}' AND abs(temperature - {t}) < 1e-6)" for m, t in K.PRIMARY_TEMPERATURE.items())


@query("primary_estimand", f"WITH {CUBE}, {PREPARED}, rows AS (SELECT * FROM policy WHERE denominator = 'all_attempts' AND shot_type = 'zero' AND report_sequence_name = 'all_docs_in_sequence' AND ({_PRIMARY})), both_ AS (SELECT 'pooled' AS scope, NULL::VARCHAR AS model_canon, NULL::DOUBLE AS temperature, y, p FROM rows UNION ALL SELECT 'by_model', model_canon, temperature, y, p FROM rows) {point_sql('scope, model_canon, temperature', 'both_')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.primary_estimand(cube(spark, d)), ["scope", "model_canon", "temperature", "n"])


@query("strict_sensitivity", f"WITH {CUBE}, s AS (SELECT * REPLACE ({_truth_sql(_SHOWN, True)}::INT AS truth) FROM cube), {PREPARED.replace('FROM cube', 'FROM s')}, {_FACTOR_CASES} {point_sql('denominator, factor, value', 'long')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = truth.document_truth(cube(spark, d), strict=True, sequences=list(K.DOCUMENT_SETS), into="strict")
    return _rounded(metrics.factor_metrics(rows, truth="strict"), ["denominator", "factor", "value", "n"])


_AUC = """auc AS (SELECT model_canon, (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0) AS auc
  FROM (SELECT model_canon, y, rank() OVER (PARTITION BY model_canon ORDER BY {s}) + (count(*) OVER (PARTITION BY model_canon, {s}) - 1) / 2.0 AS r FROM {t}) GROUP BY 1)"""


@query("binary_metrics", f"""WITH {CUBE}, {PREPARED}, rows AS (SELECT * EXCLUDE (prob), prob AS share, (bucket >= 5)::INT::DOUBLE AS p FROM prepared WHERE bucket IS NOT NULL), {_AUC.format(s="bucket", t="rows")},
c AS (SELECT model_canon, count(*) AS n, count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn, avg((share - y) * (share - y)) AS brier FROM rows GROUP BY 1)
SELECT model_canon, n, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tn / (tn + fp), 6) AS specificity,
 round(tn / (tn + fn), 6) AS npv, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(brier, 6) AS brier, round((tp + fn) / n, 6) AS prevalence, round(auc, 6) AS auc FROM c JOIN auc USING (model_canon)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.prepared(cube(spark, d)).where("bucket is not null").select("model_canon", "y", scores.prediction(F.col("bucket")).alias("pred"), F.col("bucket").alias("score"))
    return _rounded(metrics.binary_metrics(rows, ["model_canon"]), ["model_canon", "n"])


def _tier_sql(label: str, tier: str) -> str:
    sets = {s: (x,) for s, x in K.SINGLE_DOCUMENT.items()} if tier == "document" else {s: K.DOCUMENT_SETS[s] for s in K.MULTI_DOCUMENT}
    return f"t AS (SELECT * REPLACE ({_truth_sql(sets)}::INT AS truth) FROM cube WHERE report_sequence_name IN ({', '.join(repr(s) for s in sets)})), {PREPARED.replace('FROM cube', 'FROM t')}, {label} AS (SELECT * FROM policy WHERE denominator <> 'non_truncated_only')"


_TIER_KEYS = ["denominator", "model_canon", "shot_type", "temperature"]


@query("tier_document", f"WITH {CUBE}, {_tier_sql('x', 'document')} {point_sql(', '.join([*_TIER_KEYS, 'report_sequence_name']), 'x')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tiers.tables(tiers.document_rows(cube(spark, d)), per_sequence=True).drop("model_display"), [*_TIER_KEYS, "report_sequence_name", "n"])


@query("tier_cumulative", f"WITH {CUBE}, {_tier_sql('x', 'cumulative')} {point_sql(', '.join(_TIER_KEYS), 'x')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tiers.tables(tiers.cumulative_rows(cube(spark, d))).drop("model_display"), [*_TIER_KEYS, "n"])


def _subject_sql(label: str) -> str:
    votes = f"""{_SINGLE}, pol AS (SELECT *, unnest(list_filter(['all_attempts', CASE WHEN bucket IS NOT NULL THEN 'complete_case' END], lambda x: x IS NOT NULL)) AS denominator FROM single),
 votes AS (SELECT denominator, patient_id, model_canon, shot_type, temperature, coalesce(max(bucket)::DOUBLE / 10, 0) AS p FROM pol GROUP BY ALL), lab AS (SELECT patient_id, max({label})::INT AS y FROM cube GROUP BY 1),
 x AS (SELECT votes.*, y FROM votes JOIN lab USING (patient_id) WHERE y IS NOT NULL)"""
    return votes


@query("tier_final", f"WITH {CUBE}, {_subject_sql(_ANY)} {point_sql('denominator, model_canon', 'x')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = tiers.subject_rows(truth.subject_truth(cube(spark, d)), "patient_truth")
    return _rounded(tiers.tables(rows, per_model=True).drop("model_display"), ["denominator", "model_canon", "n"])


@query("tier_doc2patient", f"WITH {CUBE}, {_subject_sql('ground_truth')} {point_sql(', '.join(_TIER_KEYS), 'x')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(tiers.tables(tiers.subject_rows(cube(spark, d), "ground_truth")).drop("model_display"), [*_TIER_KEYS, "n"])


# ---- thresholds and calibration -----------------------------------------------------------------------------------

_LEVELS = "lev AS (SELECT unnest(range(0, 11))::INT AS threshold)"
_AT = "att AS (SELECT {keys}, threshold, count(*)::BIGINT AS n, count(*) FILTER (y = 1 AND bucket >= threshold)::DOUBLE AS tp, count(*) FILTER (y = 0 AND bucket >= threshold)::DOUBLE AS fp, count(*) FILTER (y = 0 AND bucket < threshold)::DOUBLE AS tn, count(*) FILTER (y = 1 AND bucket < threshold)::DOUBLE AS fn FROM {t}, lev GROUP BY ALL)"
_HAVE = "have AS (SELECT *, CASE WHEN model_canon LIKE 'gemma%' THEN 'Gemma (2026)' WHEN model_canon LIKE 'qwen%' OR model_canon LIKE 'deepseek%' THEN 'Thinking (2025)' ELSE 'Non-thinking (2024)' END AS model_pool FROM prepared WHERE bucket IS NOT NULL)"
_SWEEP = f"sweep AS (SELECT * EXCLUDE (sq_), {MACRO_F1} AS macro_f1, {POINT['precision']} AS precision, {POINT['recall']} AS recall, {MCC} AS mcc FROM (SELECT *, 0 AS sq_ FROM att))"


def _have(spark: SparkSession, d: str) -> DataFrame:
    return metrics.prepared(cube(spark, d)).where("bucket is not null").withColumn("model_pool", scores.model_pool(F.col("model_canon")))


@query("threshold_sweep", f"WITH {CUBE}, {PREPARED}, {_HAVE}, {_LEVELS}, {_AT.format(keys='model_canon, temperature', t='have')}, {_SWEEP} SELECT model_canon, temperature, threshold, round(macro_f1, 6) AS macro_f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mcc, 6) AS mcc, (tp + fp)::BIGINT AS positives_predicted, n AS n_eval FROM sweep")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.sweep(_have(spark, d), ["model_canon", "temperature"]), ["model_canon", "temperature", "threshold"])


@query("best_threshold", f"WITH {CUBE}, {PREPARED}, {_HAVE}, {_LEVELS}, {_AT.format(keys='model_pool', t='have')}, {_SWEEP}, b AS (SELECT *, row_number() OVER (PARTITION BY model_pool ORDER BY round(macro_f1, 12) DESC, round(mcc, 12) DESC, round(precision, 12) DESC, threshold) AS r FROM sweep) SELECT model_pool, threshold AS best_threshold, round(macro_f1, 6) AS best_macro_f1, round(mcc, 6) AS mcc_at_best, round(precision, 6) AS precision_at_best, round(recall, 6) AS recall_at_best, n AS n_eval FROM b WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.best(_have(spark, d), ["model_pool"]), ["model_pool", "best_threshold"])


_FIXED = f"WITH {CUBE}, {PREPARED}, {_HAVE}, lev AS (SELECT unnest([5, 6, 7])::INT AS threshold), {_AT.format(keys='model_canon', t='have')}, {_SWEEP}, {_AUC.format(s='bucket', t='have')}, fixed AS (SELECT *, CASE threshold WHEN 5 THEN 'Bronze (5+)' WHEN 6 THEN 'Silver (6+)' ELSE 'Gold (7+)' END AS threshold_label FROM sweep JOIN auc USING (model_canon))"


@query("fixed_tiers", f"{_FIXED} SELECT model_canon, threshold_label, threshold, round((tp + tn) / n, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round((tp + tn) / n, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1, round(mcc, 6) AS mcc, n AS n_eval, round(auc, 6) AS auroc FROM fixed")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.fixed_tiers(_have(spark, d), ["model_canon"]), ["model_canon", "threshold_label", "threshold"])


@query("tier_pivot", f"""{_FIXED} SELECT model_canon, round(avg(macro_f1) FILTER (threshold = 5), 6) AS "Bronze (5+)", round(avg(macro_f1) FILTER (threshold = 6), 6) AS "Silver (6+)", round(avg(macro_f1) FILTER (threshold = 7), 6) AS "Gold (7+)" FROM fixed GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(thresholds.tier_pivot(thresholds.fixed_tiers(_have(spark, d), ["model_canon"])), ["model_canon"])


@query("auc", f"WITH {CUBE}, {PREPARED}, {_HAVE}, {_AUC.format(s='likelihood_score', t='have')} SELECT model_canon, round(auc, 6) AS auc FROM auc")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(metrics.auc(_have(spark, d), ["model_canon"], "y", "likelihood_score"), ["model_canon"])


_BIN = "(" + " + ".join(f"(prob >= {i} * 0.1::DOUBLE)::INT" for i in range(1, 10)) + ")"


@query("calibration_bins", f"WITH {CUBE}, {PREPARED}, {_HAVE} SELECT model_canon, bin, round(bin * 0.1::DOUBLE, 6) AS bin_left, round((bin + 1) * 0.1::DOUBLE, 6) AS bin_right, round(avg(prob), 6) AS mean_pred, round(avg(y), 6) AS obs_rate, count(*) AS count FROM (SELECT *, {_BIN} AS bin FROM have) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(calibration.table(_have(spark, d), ["model_canon"]), ["model_canon", "bin"])


@query("calibration_summary", f"WITH {CUBE}, {PREPARED}, {_HAVE}, b AS (SELECT model_pool, bin, count(*)::DOUBLE AS c, avg(prob) AS mp, avg(y) AS mo, sum((prob - y) * (prob - y)) AS sq, sum(y) AS sy FROM (SELECT *, {_BIN} AS bin FROM have) GROUP BY 1, 2) SELECT model_pool, sum(c)::BIGINT AS n, round(sum(sq) / sum(c), 6) AS brier, round(sum(abs(mp - mo) * c) / sum(c), 6) AS ece, round(max(abs(mp - mo)), 6) AS mce, round(sum(sy) / sum(c), 6) AS positive_rate FROM b GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(calibration.summary(_have(spark, d), ["model_pool"]), ["model_pool", "n"])


# ---- inference ----------------------------------------------------------------------------------------------------

_TAIL = "list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2))))"


@query("mcnemar_pairs", f"""WITH {CUBE}, {PREPARED}, ok AS (SELECT patient_id, experiment_name, model_canon AS m, (coalesce((bucket >= 5)::INT, 0) = y)::INT AS ok, row_number() OVER (PARTITION BY patient_id, experiment_name, model_canon ORDER BY temperature NULLS LAST, ord) AS r FROM prepared),
one AS (SELECT * FROM ok WHERE r = 1), pairs AS (SELECT a.m AS model_a, b.m AS model_b, a.ok AS x, b.ok AS z FROM one a JOIN one b USING (patient_id, experiment_name) WHERE a.m < b.m),
c AS (SELECT model_a, model_b, count(*) AS n_pairs, count(*) FILTER (x = 1 AND z = 1) AS n11, count(*) FILTER (x = 1 AND z = 0) AS n10, count(*) FILTER (x = 0 AND z = 1) AS n01, count(*) FILTER (x = 0 AND z = 0) AS n00, avg(x) AS aa, avg(z) AS ab FROM pairs GROUP BY ALL)
SELECT model_a, model_b, n_pairs, n11, n10, n01, n00, round(aa, 6) AS accuracy_a, round(ab, 6) AS accuracy_b, round(CASE WHEN n10 + n01 = 0 THEN 1 ELSE least(1, 2 * {_TAIL}) END, 6) AS p_exact_mcnemar, round(aa - ab, 6) AS accuracy_diff FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(inference.mcnemar_pairs(cube(spark, d)), ["model_a", "model_b"])


_BOOT = """base AS ({base}), num AS (SELECT *, row_number() OVER (PARTITION BY model_canon ORDER BY {cluster}) - 1 AS j, count(*) OVER (PARTITION BY model_canon) AS m FROM base),
drawn AS (SELECT model_canon, b, ('0x' || substr(md5('42|' || b || '|' || j), 1, 12))::BIGINT % m AS j FROM num, (SELECT unnest(range(0, {n})) AS b)),
rep AS (SELECT drawn.model_canon, b, sum(n) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn, sum(sq) AS sq FROM drawn JOIN num USING (model_canon, j) GROUP BY 1, 2)"""


def _boot_sql(cluster: str, n: int, names: tuple[str, ...]) -> str:
    base = f"SELECT model_canon, {cluster}, count(*) AS n, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn, sum(((p - y) * (p - y))::DECIMAL(18, 8))::DOUBLE AS sq FROM policy WHERE denominator = 'all_attempts' GROUP BY 1, 2"
    cells = ", ".join(f"round(avg({m}) - quantile_cont({m}, 0.025), 6) AS {m}_lo, round(quantile_cont({m}, 0.975) - avg({m}), 6) AS {m}_hi, round(avg({m}), 6) AS {m}_mean, round(quantile_cont({m}, 0.025), 6) AS {m}_ci_low, round(quantile_cont({m}, 0.975), 6) AS {m}_ci_high" for m in names)
    point = ", ".join(f"{POINT[m]} AS {m}" for m in names)
    return f"WITH {CUBE}, {PREPARED}, {_BOOT.format(base=base, cluster=cluster, n=n)}, pt AS (SELECT model_canon, {point} FROM rep) SELECT model_canon, {cells} FROM pt GROUP BY 1"


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return metrics.policy_rows(metrics.prepared(cube(spark, d)), policies=("all_attempts",))


@query("bootstrap_cluster", _boot_sql("patient_id", 100, metrics.METRICS))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bootstrap.intervals(_attempts(spark, d), ["model_canon"], "patient_id", 100), ["model_canon"])


@query("bootstrap_row", _boot_sql("ord", 1000, metrics.METRICS))
def _(spark: SparkSession, d: str) -> DataFrame:
    found = bootstrap.intervals(_attempts(spark, d), ["model_canon"], "ord", 1000)
    # a quantile between two replicates can lie half way between two places: rounded by a factor, as the SQL does
    return found.select("model_canon", *[(F.round(F.col(c) * 1e6) / 1e6 + F.lit(0.0)).alias(c) for c in found.columns if c != "model_canon"])


def _poisson_sql(n: int) -> str:
    total, steps = 0.0, []
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"(u >= {total!r}::DOUBLE)::INT")
    base = _boot_sql("patient_id", n, ()).split("base AS (", 1)[1].split("), num AS", 1)[0]
    point = ", ".join(f"{POINT[m]} AS {m}" for m in metrics.METRICS)
    arms = ", ".join(f"round(any_value(t.{m}), 6) AS {m}, round(avg(pt.{m}) - quantile_cont(pt.{m}, 0.025), 6) AS {m}_lo, round(quantile_cont(pt.{m}, 0.975) - avg(pt.{m}), 6) AS {m}_hi" for m in metrics.METRICS)
    sums = "sum(n{w}) AS n, sum(tp{w}) AS tp, sum(fp{w}) AS fp, sum(tn{w}) AS tn, sum(fn{w}) AS fn, sum(sq{w}) AS sq"
    return (
        f"WITH {CUBE}, {PREPARED}, base AS ({base}), w AS (SELECT *, {' + '.join(steps)} AS w FROM (SELECT *, ('0x' || substr(md5('42|' || model_canon || '|' || coalesce(patient_id, '') || '|' || b), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM base, (SELECT unnest(range(0, {n})) AS b))), "
        f"rep AS (SELECT model_canon, b, {sums.format(w=' * w')} FROM w WHERE w > 0 GROUP BY 1, 2), pt AS (SELECT model_canon, {point} FROM rep), "
        f"whole AS (SELECT model_canon, {sums.format(w='')} FROM base GROUP BY 1), t AS (SELECT model_canon, n, {point} FROM whole) SELECT pt.model_canon, any_value(t.n)::BIGINT AS n, {arms} FROM pt JOIN t USING (model_canon) GROUP BY 1"
    )


@query("bootstrap_poisson", _poisson_sql(200))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(bootstrap.with_intervals(_attempts(spark, d), ["model_canon"], "patient_id", 200, method="poisson"), ["model_canon"])


def _cells_sql(n: int, then: str) -> str:
    """Replicates of (model, score, truth) counts by the draws of the Poisson bootstrap; replicate -1 is the table itself."""
    total, steps = 0.0, []
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        steps.append(f"(u >= {total!r}::DOUBLE)::INT")
    return (
        f"WITH {CUBE}, {PREPARED}, base AS (SELECT model_canon, patient_id, complexity_score AS v, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM policy WHERE denominator = 'all_attempts' AND complexity_score IS NOT NULL GROUP BY ALL), "
        f"u AS (SELECT model_canon, patient_id, b, ('0x' || substr(md5('42|' || model_canon || '|' || coalesce(patient_id, '') || '|' || b), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM (SELECT DISTINCT model_canon, patient_id FROM base), (SELECT unnest(range(-1, {n})) AS b)), "
        f"w AS (SELECT model_canon, patient_id, b, CASE WHEN b < 0 THEN 1 ELSE {' + '.join(steps)} END AS w FROM u), "
        f"h AS (SELECT model_canon, b, v, sum(pos * w) AS pos, sum(neg * w) AS neg FROM base JOIN w USING (model_canon, patient_id) GROUP BY ALL HAVING sum(w) > 0), "
        f"m AS ({then}) SELECT model_canon, round(max(x) FILTER (b < 0), 6) AS point, round(avg(x) FILTER (b >= 0), 6) AS mean, round(quantile_cont(x, 0.025) FILTER (b >= 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (b >= 0), 6) AS high FROM m WHERE x IS NOT NULL GROUP BY 1"
    )


_AUC_SQL = "SELECT model_canon, b, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0)::DOUBLE AS x FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_canon, b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h) GROUP BY 1, 2"
_MEDIAN_SQL = """SELECT model_canon, b, max(v) FILTER (upto - n <= floor((total - 1) / 2.0)) / 2.0 + max(v) FILTER (upto - n <= ceil((total - 1) / 2.0)) / 2.0 AS x
FROM (SELECT model_canon, b, v, pos + neg AS n, sum(pos + neg) OVER (PARTITION BY model_canon, b ORDER BY v) AS upto, sum(pos + neg) OVER (PARTITION BY model_canon, b) AS total FROM h WHERE pos + neg > 0) GROUP BY 1, 2"""
_ECE_SQL = "SELECT model_canon, b, sum(abs(pos - (pos + neg) * v / 10)) / nullif(sum(pos + neg), 0) AS x FROM h GROUP BY 1, 2"


def _histogram_query(spark: SparkSession, d: str, metric: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    found = bootstrap.histogram_interval(_attempts(spark, d), ["model_canon"], "patient_id", "complexity_score", metric, 200)
    return _rounded(found, ["model_canon"])


@query("bootstrap_auc", _cells_sql(200, _AUC_SQL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _histogram_query(spark, d, bootstrap.auc_of)


@query("bootstrap_median", _cells_sql(200, _MEDIAN_SQL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _histogram_query(spark, d, bootstrap.quantile_of(0.5))


@query("bootstrap_calibration", _cells_sql(200, _ECE_SQL))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _histogram_query(spark, d, bootstrap.calibration_of(lambda v: v / 10))


@query("clustered_logistic")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inference.clustered_logistic(cube(spark, d))


@query("mixed_logistic")
def _(spark: SparkSession, d: str) -> DataFrame:
    return inference.mixed_logistic(cube(spark, d))


# ---- summaries ----------------------------------------------------------------------------------------------------


@query("cohort_summary", f"WITH {CUBE}, w AS (SELECT count(*) AS rows, count(DISTINCT patient_id) AS patients, count(DISTINCT experiment_name) AS experiments, count(DISTINCT runner_name) AS runners, count(DISTINCT model_canon) AS models FROM cube) SELECT 'rows' AS metric, rows AS value FROM w UNION ALL SELECT 'patients', patients FROM w UNION ALL SELECT 'experiments', experiments FROM w UNION ALL SELECT 'runners', runners FROM w UNION ALL SELECT 'models', models FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    return descriptive.cohort(cube(spark, d), {"patients": "patient_id", "experiments": "experiment_name", "runners": "runner_name", "models": "model_canon"})


def parsed(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).withColumn("r", jsonrepair.parse_response("full_response"))
    return rows.withColumns({"json_repair_type": F.col("r.repair_type"), "json_schema_valid": F.col("r.schema_valid").cast("int"), "json_parse_success": F.col("r.payload").isNotNull().cast("int")}).drop("r")


def _pct(x: str) -> str:
    return f"printf('%d/%d (%.1f%%)', ({x})::BIGINT, n, 100.0 * ({x}) / n)"


_TAG = lambda t: f"count(*) FILTER (tag = '{t}')"


@query("parse_summary", f"""WITH {CUBE}, s AS (SELECT folder, count(*) AS n, count(DISTINCT patient_id) AS pats, {_TAG("raw_valid_json")} AS raw, {_TAG("extracted_embedded_json")} AS ext, {_TAG("repaired_json")} AS rep, {_TAG("schema_invalid")} AS inv, {_TAG("unparseable")} AS unp, {_TAG("empty")} AS emp, count(*) FILTER (trim(full_response) = '') AS none, count(*) FILTER (likelihood_score >= 5) AS high FROM cube GROUP BY 1)
SELECT folder, 'ok' AS status, {_pct("pats")} AS unique_patients, {_pct("raw")} AS raw_valid_json, {_pct("ext")} AS extracted_embedded_json, {_pct("rep")} AS repaired_json, {_pct("inv")} AS schema_invalid, {_pct("unp")} AS unparseable, {_pct("raw")} AS no_repair_needed, {_pct("rep")} AS "JSON_repaired", {_pct("none")} AS no_response,
{_pct("raw + ext + rep")} AS total_successful, {_pct("raw + ext + rep")} AS schema_valid_total, {_pct("high")} AS "IBD_predicted_ge_5", round(100.0 * (raw + ext + rep) / n, 6) AS total_success_percent, round(100.0 * raw / n, 6) AS no_repair_percent, round(100.0 * (raw + ext + rep) / n, 6) AS schema_valid_percent, round(100.0 * high / n, 6) AS percent_ge_5, n AS n_rows, emp AS n_empty_responses FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.parse_summary(parsed(spark, d)), ["folder"])


@query("merge_summary", f"WITH {CUBE}, s AS (SELECT folder, count(*) AS n, count(DISTINCT patient_id) AS p, count(*) FILTER (tag IN ('empty', 'unparseable')) AS bad, count(*) FILTER (user_id < 100) AS m FROM cube GROUP BY 1) SELECT folder, folder || '_merged.parquet' AS output, n AS input_rows, n - p AS duplicates_dropped, CASE WHEN m > 0 THEN m ELSE p END AS merged_rows, p AS post_dedup_rows, bad AS api_failures, 'ok' AS status, '' AS error FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = parsed(spark, d)
    return descriptive.merge_summary(rows, rows.where("user_id < 100"))


@query("parse_outcomes", f"WITH {CUBE} SELECT runner_name, tag NOT IN ('empty', 'unparseable') AS parsed, count(*) AS n FROM cube GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return descriptive.parse_outcomes(parsed(spark, d), "runner_name")


# t quantiles by group size, from the same rule as the operator's
def _t975(most: int) -> dict[int, float]:
    """n -> Student's t quantile for n - 1 degrees of freedom, from the density itself by quadrature and Newton's steps."""
    df = np.arange(1.0, most)
    at, weight = np.polynomial.legendre.leggauss(80)
    scale = np.exp([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) for v in df]) / np.sqrt(df * np.pi)
    density = lambda t: scale[:, None] * (1 + t * t / df[:, None]) ** (-(df[:, None] + 1) / 2)
    t = np.full(len(df), 2.0)
    for _ in range(25):
        area = (density(t[:, None] * (at + 1) / 2) * weight).sum(axis=1) * t / 2
        t = t + (0.475 - area) / density(t[:, None])[:, 0]
    return {int(v) + 1: float(q) for v, q in zip(df, t, strict=True)}


_T = _t975(1001)


@query("folder_breakdown", f"""WITH {CUBE}, f AS (SELECT folder, model_canon AS model, replace(printf('%.2f', temperature), '.', '_') AS temperature, shot_type AS shot, report_sequence_name AS data_type, 100.0 * count(*) FILTER (likelihood_score >= 5) / count(*) AS percent_ge_5, 100.0 * count(*) FILTER (tag = 'raw_valid_json') / count(*) AS no_repair_percent FROM cube GROUP BY ALL),
g AS (SELECT *, unnest(list_filter([CASE WHEN temp AND seq THEN {{'a': 'shot', 'v': shot}} END, CASE WHEN zero AND temp AND seq THEN {{'a': 'model', 'v': model}} END, CASE WHEN zero AND seq THEN {{'a': 'temperature', 'v': temperature}} END, CASE WHEN zero AND temp THEN {{'a': 'data_type', 'v': data_type}} END], lambda x: x IS NOT NULL)) AS pair
 FROM (SELECT *, shot = 'zero' AS zero, temperature IN ('0_50', '0_60', '0_75', '1_00') AS temp, data_type IN ('all_docs_in_sequence', 'endo', 'hist', 'clinic_preceding', 'clinic_following') AS seq FROM f)),
l AS (SELECT pair.a AS attribute_type, pair.v AS attribute_value, 'percent_ge_5' AS metric, percent_ge_5 AS x FROM g UNION ALL SELECT pair.a, pair.v, 'no_repair_percent', no_repair_percent FROM g),
tq(n, t) AS (VALUES {", ".join(f"({n}, {t!r}::DOUBLE)" for n, t in _T.items())}),
s AS (SELECT attribute_type, attribute_value, metric, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS std_dev, count(*) AS n, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, CASE WHEN count(*) > 2 AND stddev_samp(x) > 0 THEN skewness(x) ELSE 0 END AS skewness, CASE WHEN count(*) > 3 AND stddev_samp(x) > 0 THEN kurtosis(x) ELSE 0 END AS kurtosis FROM l GROUP BY ALL)
SELECT attribute_type, attribute_value, metric, round(mean, 6) AS mean, round(std_dev, 6) AS std_dev, n, round(mean - coalesce(t * std_dev / sqrt(n), 0), 6) AS ci_lower, round(mean + coalesce(t * std_dev / sqrt(n), 0), 6) AS ci_upper, round(median, 6) AS median, round(iqr, 6) AS iqr, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis FROM s LEFT JOIN tq USING (n)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    summary = descriptive.parse_summary(parsed(spark, d)).select("folder", "percent_ge_5", "no_repair_percent")
    return _rounded(descriptive.breakdown(summary, ["percent_ge_5", "no_repair_percent"]), ["attribute_type", "attribute_value", "metric"])


@query("missingness", f"WITH {CUBE} SELECT unnest(['likelihood_score', 'certainty_score', 'endoscopy_ibd_flag', 'patient_id']) AS \"column\", unnest([round_even(100 * avg((likelihood_score IS NULL)::INT), 2), round_even(100 * avg((certainty_score IS NULL)::INT), 2), round_even(100 * avg((endoscopy_ibd_flag IS NULL)::INT), 2), 0.0]) AS pct_missing FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    return descriptive.missingness(cube(spark, d).select("likelihood_score", "certainty_score", "endoscopy_ibd_flag", "patient_id"))


_DESCRIBE = "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM cube"


@query("numeric_describe", f"WITH {CUBE} " + " UNION ALL ".join(_DESCRIBE.format(c=c) for c in ("likelihood_score", "certainty_score", "value")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.numeric_describe(cube(spark, d), ["likelihood_score", "certainty_score", "value"]), ["column", "count"])


@query("score_means", f"WITH {CUBE} SELECT model_canon, report_sequence_name, shot_type, temperature, count(*) AS n_rows, round(avg(likelihood_score), 6) AS likelihood_mean, round(avg(certainty_score), 6) AS certainty_mean, round(avg(complexity_score), 6) AS complexity_mean FROM cube GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    keys = ["model_canon", "report_sequence_name", "shot_type", "temperature"]
    return _rounded(descriptive.score_means(cube(spark, d), keys), [*keys, "n_rows"])


_DROP_SETS = [["temperature"], ["shot_type"], ["report_sequence_name"], ["model_canon"], ["report_sequence_name", "temperature"], ["model_canon", "temperature"]]


@query("dropout_by_factor", f"WITH {CUBE}, f AS (SELECT *, (likelihood_score IS NULL OR certainty_score IS NULL OR complexity_score IS NULL)::INT AS gone FROM cube) " + " UNION ALL ".join(
    f"SELECT '{'+'.join(k for k in ('temperature', 'shot_type', 'report_sequence_name', 'model_canon') if k in s)}' AS level, " + ", ".join(k if k in s else f"NULL AS {k}" for k in ("temperature", "shot_type", "report_sequence_name", "model_canon")) + ", round(100 * avg(gone), 6) AS dropout_pct FROM f GROUP BY ALL" for s in _DROP_SETS))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.dropout(cube(spark, d), _DROP_SETS), ["level", "temperature", "shot_type", "report_sequence_name", "model_canon"])


@query("dropout_small_models", f"WITH {CUBE} SELECT 'temperature' AS level, temperature, round(100 * avg((likelihood_score IS NULL OR certainty_score IS NULL)::INT), 6) AS dropout_pct FROM cube WHERE model_canon NOT LIKE '%32b%' GROUP BY 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.dropout(cube(spark, d).where(scores.is_small_model(F.col("model_canon"))), [["temperature"]]), ["level", "temperature"])


@query("bucket_summary", f"WITH {CUBE}, {PREPARED}, {_HAVE} SELECT model_pool, bucket, round(avg(((bucket >= 5)::INT = y)::INT), 6) AS accuracy, round(avg(certainty_score), 6) AS mean_certainty, round(avg(complexity_score), 6) AS mean_complexity, round(avg(y), 6) AS observed_rate, count(*) AS n FROM have GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.bucket_summary(_have(spark, d), ["model_pool"]), ["model_pool", "bucket"])


@query("grey_zone", f"WITH {CUBE}, {PREPARED}, {_HAVE} SELECT bucket, round(avg(((bucket >= 5)::INT = y)::INT), 6) AS accuracy, round(avg(certainty_score), 6) AS mean_certainty, round(avg(complexity_score), 6) AS mean_complexity, round(avg(y), 6) AS observed_rate, count(*) AS n FROM have WHERE bucket BETWEEN 3 AND 6 GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.bucket_summary(_have(spark, d).where("bucket between 3 and 6"), []), ["bucket"])


@query("certainty_macro_f1", f"WITH {CUBE}, {PREPARED}, {_HAVE}, c AS (SELECT model_pool, greatest(1, least(10, round_even(certainty_score, 0)))::INT AS certainty_bucket, count(*) AS n, count(*) FILTER (y = 1 AND bucket >= 5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND bucket >= 5)::DOUBLE AS fp, count(*) FILTER (y = 0 AND bucket < 5)::DOUBLE AS tn, count(*) FILTER (y = 1 AND bucket < 5)::DOUBLE AS fn FROM have WHERE certainty_score IS NOT NULL GROUP BY 1, 2) SELECT model_pool, certainty_bucket, round({MACRO_F1}, 6) AS macro_f1, n FROM c")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(descriptive.certainty_f1(_have(spark, d), ["model_pool"]), ["model_pool", "certainty_bucket"])


# ---- linkage ------------------------------------------------------------------------------------------------------

_DAYS = "floor(date_diff('microsecond', {early}, {late}) / 86400000000.0)::BIGINT"
_SIDES = "a AS (SELECT user_id, event_id AS a_id, ts AS a_ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS b_id, ts AS b_ts FROM events WHERE event_type = 'signup')"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, d, "events")
    side = lambda t, n: e.where(F.col("event_type") == t).select("user_id", F.col("event_id").alias(f"{n}_id"), F.col("ts").alias(f"{n}_ts"))
    return side("purchase", "a"), side("signup", "b")


_GAP = _DAYS.format(early="b_ts", late="a_ts")


@query("band_join", f"WITH {_SIDES} SELECT user_id, a_id, b_id, abs({_GAP}) AS date_diff FROM a JOIN b USING (user_id) WHERE abs({_GAP}) <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.band_join(a, b, "user_id", "a_ts", "b_ts", 2).select("user_id", "a_id", "b_id", "date_diff")


@query("keep_best", f"WITH {_SIDES}, j AS (SELECT user_id, a_id, b_id, abs({_GAP}) AS date_diff, row_number() OVER (PARTITION BY a_id ORDER BY abs({_GAP}), b_ts, b_id) AS r FROM a JOIN b USING (user_id) WHERE abs({_GAP}) <= 2) SELECT user_id, a_id, b_id, date_diff FROM j WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.keep_best(linkage.band_join(a, b, "user_id", "a_ts", "b_ts", 2), ["a_id"], ["date_diff", "b_ts", "b_id"]).select("user_id", "a_id", "b_id", "date_diff")


_ASOF = "WITH {sides}, j AS (SELECT a.user_id, a_id, b_id, row_number() OVER (PARTITION BY a_id ORDER BY {order}) AS r FROM a LEFT JOIN b ON a.user_id = b.user_id AND {test}) SELECT user_id, a_id, b_id FROM j WHERE r = 1"
_REV = _DAYS.format(early="a_ts", late="b_ts")


@query("asof_backward", _ASOF.format(sides=_SIDES, order="b_ts DESC, b_id", test=f"{_REV} < 0"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.asof_join(a, b, "user_id", "a_ts", "b_ts", {"b_id": "b_id"}, "backward", order="b_id").select("user_id", "a_id", "b_id")


@query("asof_forward", _ASOF.format(sides=_SIDES, order="b_ts, b_id", test=f"{_REV} > 0 AND {_REV} <= 5"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.asof_join(a, b, "user_id", "a_ts", "b_ts", {"b_id": "b_id"}, "forward", 5, "b_id").select("user_id", "a_id", "b_id")


@query("asof_ordered", f"WITH {_SIDES} SELECT a.user_id, a_id, b_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a_ts > b_ts")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.asof_join(a, b, "user_id", "a_ts", "b_ts", {"b_id": "b_id"}).select("user_id", "a_id", "b_id")


_CHRON = f"""prim AS (SELECT 'P' || user_id AS pid, ts AS received, event_type || event_id AS report FROM events WHERE event_type = 'view'), sec AS (SELECT 'P' || user_id AS pid, ts AS proc, 'scope ' || event_id AS scope FROM events WHERE event_type = 'purchase'),
notes AS (SELECT 'P' || user_id AS pid, ts AS written, 'note ' || event_id AS note FROM events WHERE event_type = 'signup'),
lk AS (SELECT sec.pid, proc, received, report, scope, abs({_DAYS.format(early="received", late="proc")}) AS date_diff FROM sec JOIN prim USING (pid) WHERE abs({_DAYS.format(early="received", late="proc")}) <= 2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid, proc ORDER BY date_diff, received, report) AS r FROM lk) WHERE r = 1),
pre AS (SELECT one.pid, proc, note, written, row_number() OVER (PARTITION BY one.pid, proc ORDER BY written DESC) AS r FROM one JOIN notes ON one.pid = notes.pid AND {_DAYS.format(early="proc", late="written")} BETWEEN -10 AND -1),
fol AS (SELECT one.pid, proc, note, written, row_number() OVER (PARTITION BY one.pid, proc ORDER BY written) AS r FROM one JOIN notes ON one.pid = notes.pid AND {_DAYS.format(early="proc", late="written")} BETWEEN 1 AND 10)"""


@query("chronology", f"WITH {_CHRON} SELECT one.pid AS patient_id, one.pid || '::' || strftime(one.proc, '%Y-%m-%d') AS episode_id, report AS result_report, scope AS \"Combined_Content\", coalesce(pre.note, 'NOT_AVAILABLE') AS preceding_clinic_letter, coalesce(fol.note, 'NOT_AVAILABLE') AS following_clinic_letter, {_DAYS.format(early='pre.written', late='one.proc')} AS preceding_clinic_time_diff, {_DAYS.format(early='one.proc', late='fol.written')} AS following_clinic_time_diff, date_diff FROM one LEFT JOIN pre ON pre.pid = one.pid AND pre.proc = one.proc AND pre.r = 1 LEFT JOIN fol ON fol.pid = one.pid AND fol.proc = one.proc AND fol.r = 1")
def _chronology(spark: SparkSession, d: str, max_cases: int | None = None) -> DataFrame:
    e = _table(spark, d, "events").withColumn("patient_id", F.concat(F.lit("P"), F.col("user_id").cast("string")))
    i = F.col("event_id").cast("string")
    primary = e.where("event_type = 'view'").select("patient_id", F.col("ts").alias("sample_received_date"), F.concat("event_type", i).alias("result_report"))
    secondary = e.where("event_type = 'purchase'").select("patient_id", F.col("ts").alias("procedure_date"), F.concat(F.lit("scope "), i).alias("Combined_Content"))
    notes = e.where("event_type = 'signup'").select("patient_id", F.col("ts").alias("date_creation"), F.concat(F.lit("note "), i).alias("clean_content"))
    out = linkage.chronology(primary, secondary, notes, 2, 10, max_cases)
    return out.select("patient_id", "episode_id", "result_report", "Combined_Content", "preceding_clinic_letter", "following_clinic_letter", "preceding_clinic_time_diff", "following_clinic_time_diff", "date_diff")


@query("first_cases", f"{ORACLES['chronology']} ORDER BY patient_id, episode_id LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The feature of a run on the first cases alone."""
    return _chronology(spark, d, 40)


@query("unanswered", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark: SparkSession, d: str) -> DataFrame:
    done = _table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    return sinks.undone(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query("union_by_name", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::BIGINT AS suppkey FROM customer UNION ALL SELECT NULL, s_name, NULL, s_suppkey FROM supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return batches.union([a, _table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.col("s_name").alias("name"))])


@query("written_tables", "SELECT o_orderkey, o_totalprice, o_orderpriority, 'orders' AS read_as FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A stage's table written, found again and read."""
    root = f"{scratch.shared_folder(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    sinks.write_tables({"orders": _table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("p"))}, root, aliases={"p": "o_orderpriority"})
    return sinks.read_table(spark, root, "merged_outputs", "orders").withColumn("read_as", F.lit("orders"))


@query("slugs", "SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' #' || p_type || ' ', '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select("p_partkey", scores.slug(F.concat("p_name", F.lit(" #"), "p_type", F.lit(" "))).alias("slug"))


@query("messages", f"SELECT conv_id, turn, md5(chr(10) || 'Read it.' || chr(10) || chr(10) || '**INPUT:**' || chr(10) || chr(10) || text || chr(10) || chr(10) || '{prompts.REMINDER}' || chr(10)) AS digest FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(prompts.message(F.lit("Read it."), F.col("text"))).alias("digest"))


@query("reference_left_join", "SELECT c_custkey AS patient_id, c_mktsegment AS site, o_orderkey, o_orderstatus AS site_llm FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[0]


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    reference = _table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("site"))
    outputs = _table(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderkey", F.col("o_orderstatus").alias("site"))
    return linkage.merge_reference(outputs, reference)


@query("reference_join_counts", "WITH m AS (SELECT o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey) SELECT 'reference_rows' AS metric, (SELECT count(*) FROM customer) AS value UNION ALL SELECT 'parsed_rows', (SELECT count(*) FROM orders) UNION ALL SELECT 'merged_rows', (SELECT count(*) FROM m) UNION ALL SELECT 'matched_rows', (SELECT count(o_orderkey) FROM m)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)[1]


@query("batch_slices", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 50)::BIGINT AS batch, o_orderstatus FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = sinks.with_batches(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 50, ["o_orderkey"], ["o_orderstatus"])
    return found.select("o_orderkey", F.col("batch").cast("long"), "o_orderstatus")


@query("batch_ranges", "SELECT o_orderkey, o_totalprice, ((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) // 37)::BIGINT AS batch FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = sinks.with_batches(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 37, ["o_totalprice", "o_orderkey"])
    return found.withColumn("batch", F.col("batch").cast("long"))


@query("asof_ordered_forward", _ASOF.format(sides=_SIDES, order="b_ts, b_id", test=f"{_REV} > 0").replace("SELECT user_id, a_id, b_id FROM j WHERE r = 1", f"SELECT j.user_id, j.a_id, CASE WHEN {_REV} <= 5 THEN j.b_id END AS b_id FROM j JOIN a USING (a_id) LEFT JOIN b ON b.b_id = j.b_id WHERE r = 1"))
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return linkage.asof_join(a, b, "user_id", "a_ts", "b_ts", {"b_id": "b_id"}, "forward", 5, "b_id").select("user_id", "a_id", "b_id")


# ---- prompts ------------------------------------------------------------------------------------------------------

_TEMPLATES = {"zero": "Read and judge.", "single": "One example first.", "dual": "Two examples first."}
_ASKED = {"all_docs": ["PRECEDING CLINIC LETTER", "ENDOSCOPY REPORT", "HISTOPATHOLOGY REPORT"], "clinic_following": ["CLINIC LETTER"], "both": ["BOTH CLINIC LETTERS", "PRIMARY REPORT"], "preceding_following": ["CONTEXT NOTE"]}


@query("experiments_cross", "WITH t(prompt_name) AS (VALUES ('zero'), ('single'), ('dual')), s(report_sequence_name, n, context_note_timing) AS (VALUES ('all_docs', 3, 'preceding'), ('clinic_following', 1, 'following'), ('both', 2, 'preceding'), ('preceding_following', 1, 'both')) SELECT conv_id, prompt_name || '_shot_' || report_sequence_name AS experiment_name, prompt_name, report_sequence_name, n AS n_documents, context_note_timing FROM (SELECT DISTINCT conv_id FROM conversations), t, s")
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.experiments(spark, _TEMPLATES, _ASKED).select("experiment_name", "prompt_name", "report_sequence_name", F.size("report_sequence").alias("n_documents"), "context_note_timing")
    return _table(spark, d, "conversations").select("conv_id").distinct().crossJoin(F.broadcast(asked))  # a configuration's size


def _cases(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("result_report"), F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("scope "), F.col("conv_id").cast("string"))).alias("Combined_Content"), F.col("role").alias("preceding_clinic_letter"), F.lit(None).cast("string").alias("following_clinic_letter"))


_SECTION = "'**' || '{0}' || '**:' || chr(10) || chr(10) || {1} || chr(10)"


_SCOPE = "CASE WHEN conv_id % 3 = 0 THEN 'NOT_AVAILABLE' ELSE 'scope ' || conv_id END"
_PARTS = {
    "all_docs": [("PRECEDING CLINIC LETTER", "role"), ("ENDOSCOPY REPORT", _SCOPE), ("HISTOPATHOLOGY REPORT", "text")], "clinic_following": [("CLINIC LETTER", "'NOT_AVAILABLE'")],
    "both": [("PRECEDING CLINIC LETTER", "role"), ("FOLLOWING CLINIC LETTER", "'NOT_AVAILABLE'"), ("HISTOPATHOLOGY REPORT", "text")], "preceding_following": [("PRECEDING CLINIC LETTER", "role"), ("FOLLOWING CLINIC LETTER", "'NOT_AVAILABLE'")],
}


def _sections_sql() -> str:
    made = [f"SELECT conv_id, turn, '{s}' AS report_sequence_name, {len(ps)} AS n_sections, md5(trim({' || chr(10) || '.join(_SECTION.format(a, b) for a, b in ps)}, chr(10) || ' ')) AS digest FROM conversations" for s, ps in _PARTS.items()]
    return " UNION ALL ".join(made)


@query("prompt_sections", _sections_sql())
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.experiments(spark, {"zero": "x"}, _ASKED)
    rows = _cases(spark, d).crossJoin(F.broadcast(asked))  # a configuration of four rows
    parts = prompts.sections(F.col("report_sequence"), F.col("context_note_timing"))
    said = F.regexp_replace(prompts.rendered(parts), r"^[\n ]+|[\n ]+$", "")
    return rows.select("conv_id", "turn", "report_sequence_name", F.size(parts).alias("n_sections"), F.md5(said).alias("digest"))


@query("truncate_words", "WITH w AS (SELECT conv_id, turn, text, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') AS ws FROM conversations) SELECT conv_id, turn, md5(CASE WHEN len(ws) > 20 THEN array_to_string(ws[1:20], ' ') ELSE text END) AS digest, len(ws) > 20 AS cut FROM w")
def _(spark: SparkSession, d: str) -> DataFrame:
    kept, cut = prompts.truncate_words(F.col("text"), 20)
    return _table(spark, d, "conversations").select("conv_id", "turn", F.md5(kept).alias("digest"), cut.alias("cut"))


def _budget_sql(limit: int) -> str:
    """The shares one section after the other; the frame leaves room in every case."""
    words, made = lambda t: len(t.split()), []
    for prompt, template in _TEMPLATES.items():
        for sequence, parts in _PARTS.items():
            room = limit - words(template) - words("**INPUT:**") - words(prompts.REMINDER)
            sizes = ", ".join(f"len(regexp_extract_all({text}, '\\S+')) AS b{i}" for i, (_, text) in enumerate(parts))
            q = f"SELECT conv_id, turn, {room} AS r0, {sizes} FROM conversations"
            for i, (label, _) in enumerate(parts):
                head, left = words(label), len(parts) - i
                q = f"SELECT *, greatest(0, r{i}) // {left} - {head} AS s{i} FROM ({q})"
                q = f"SELECT *, r{i} - {head} - CASE WHEN b{i} > greatest(0, s{i}) THEN greatest(s{i}, 1) ELSE b{i} END AS r{i + 1} FROM ({q})"
            cut = [f"CASE WHEN b{i} > greatest(0, s{i}) THEN '{label}' END" for i, (label, _) in enumerate(parts)]
            names, last = f"concat_ws(',', {', '.join(cut)})", f"r{len(parts)}"
            made.append(f"SELECT conv_id, turn, '{prompt}_shot_{sequence}' AS experiment_name, least({limit}, {limit} - {last})::INT AS tokens, {names} <> '' OR {last} < 0 AS truncated, {names} AS truncated_sections FROM ({q})")
    return " UNION ALL ".join(made)


@query("token_budget", _budget_sql(60))
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = prompts.experiments(spark, _TEMPLATES, _ASKED)
    rows = _cases(spark, d).crossJoin(F.broadcast(asked))  # a configuration of twelve rows
    fit = prompts.budgeted(prompts.Words, 60)
    made = rows.select("conv_id", "turn", "experiment_name", fit(F.col("prompt_content"), prompts.sections(F.col("report_sequence"), F.col("context_note_timing"))).alias("m"))
    return made.select("conv_id", "turn", "experiment_name", text.token_count(F.col("m.message")).alias("tokens"), "m.truncated", F.array_join("m.truncated_sections", ",").alias("truncated_sections"))


# ---- narrative ----------------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def _ngram_sql(n: int, top: int = 30) -> str:
    return f"WITH w AS (SELECT {_WORDS} AS ws FROM documents), g AS (SELECT unnest(list_transform(range(1, greatest(len(ws) - {n} + 2, 1)), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) AS term FROM w) SELECT term, count(*) AS count FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {top}"


for _n in (1, 3, 5):

    @query(f"ngram_top_{_n}", _ngram_sql(_n))
    def _(spark: SparkSession, d: str, n: int = _n) -> DataFrame:
        return narrative.ngram_top(_table(spark, d, "documents"), "text", n)


def _density_sql(keywords: list[str]) -> str:
    hits = " + ".join(f"len(regexp_extract_all(low, '{text.keyword_pattern(k)}'))" for k in keywords)
    return f"100.0::DOUBLE * ({hits}) / words"


def _dense_sql(lexicon: dict[str, list[str]], source: str = "flagged") -> str:
    return f"dense AS (SELECT *, {', '.join(f'{_density_sql(ks)} AS d{i}' for i, ks in enumerate(lexicon.values()))} FROM (SELECT *, lower(Combined_Content) AS low, greatest(len(regexp_extract_all(lower(Combined_Content), '\\b[a-z]{{2,}}\\b')), 1) AS words FROM {source}))"


_FLAGGED = """flagged AS (SELECT *, pred = 1 AND y = 0 AS is_fp, pred = 0 AND y = 1 AS is_fn, pred = 1 AND y = 1 AS is_tp, pred = 0 AND y = 0 AS is_tn, pred <> y AS is_error, coalesce(certainty_score >= 7, false) AS high, coalesce(certainty_score < 7, false) AS low_c,
 pred <> y AND coalesce(certainty_score >= 7, false) AND (likelihood_score <= 2 OR likelihood_score >= 8) AS cat, pred <> y AND NOT (coalesce(certainty_score >= 7, false) AND (likelihood_score <= 2 OR likelihood_score >= 8)) AS other FROM (SELECT *, (bucket >= 5)::INT AS pred FROM prepared WHERE bucket IS NOT NULL))"""


def _long_sql(lexicon: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT *, '{f}' AS family, d{i} AS v FROM dense" for i, f in enumerate(lexicon))


@query("cue_density", f"WITH {CUBE}, {_dense_sql(K.CUES, 'cube')}, long AS ({_long_sql(K.CUES)}) SELECT ord, family, round(v, 6) AS value FROM long")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).select("ord", F.explode(text.densities(F.col("Combined_Content"), K.CUES)).alias("x"))
    return rows.select("ord", "x.family", F.round("x.value", 6).alias("value"))


@query("theme_density", f"WITH {CUBE}, {_dense_sql(K.THEMES, 'cube')}, long AS ({_long_sql(K.THEMES)}) SELECT ord, family, round(v, 6) AS value FROM long")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).select("ord", F.explode(text.densities(F.col("Combined_Content"), K.THEMES)).alias("x"))
    return rows.select("ord", "x.family", F.round("x.value", 6).alias("value"))


def _delta_sql(key: str, lexicon: dict[str, list[str]], where: str = "true") -> str:
    sides = {"fp": ("is_fp", "is_tn"), "fn": ("is_fn", "is_tp"), "catastrophic": ("cat", "other")}
    rows = " UNION ALL ".join(f"SELECT {key}, '{c}' AS \"case\", family, avg(v) FILTER ({a}) AS case_mean, avg(v) FILTER ({b}) AS reference_mean FROM long WHERE {where} GROUP BY ALL" for c, (a, b) in sides.items())
    return f"WITH {CUBE}, {PREPARED}, {_FLAGGED}, {_dense_sql(lexicon)}, long AS ({_long_sql(lexicon)}), deltas AS (SELECT *, case_mean - reference_mean AS delta FROM ({rows}) WHERE case_mean IS NOT NULL AND reference_mean IS NOT NULL)"


@query("cue_deltas", f"{_delta_sql('model_canon', K.CUES)} SELECT model_canon, \"case\", family, round(case_mean, 6) AS case_mean, round(reference_mean, 6) AS reference_mean, round(delta, 6) AS delta FROM deltas")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.deltas(narrative.flagged(cube(spark, d)), ["model_canon"], "Combined_Content", K.CUES), ["model_canon", "case", "family"])


@query("theme_deltas_by_shot", f"{_delta_sql('shot_type', K.THEMES, 'temperature IN (0.5, 0.6, 0.75, 1.0) AND report_sequence_name IN (' + ', '.join(repr(s) for s in K.FAIR_SEQUENCES) + ')')} SELECT shot_type, \"case\", family, round(case_mean, 6) AS case_mean, round(reference_mean, 6) AS reference_mean, round(delta, 6) AS delta FROM deltas")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.factor_deltas(cube(spark, d), "shot_type", "Combined_Content", K.THEMES), ["shot_type", "case", "family"])


@query("mechanism_summary", f"""{_delta_sql('model_canon', K.CUES)}, r AS (SELECT *, row_number() OVER (PARTITION BY model_canon, "case" ORDER BY delta DESC, family) AS up, row_number() OVER (PARTITION BY model_canon, "case" ORDER BY delta, family) AS down FROM deltas)
SELECT model_canon, "case", 'Overweights: ' || coalesce(string_agg(family, '; ' ORDER BY up) FILTER (delta > 0 AND up <= 2), 'none') || ' | Underweights: ' || coalesce(string_agg(family, '; ' ORDER BY down) FILTER (delta < 0 AND down <= 2), 'none') AS mechanism FROM r GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return narrative.mechanisms(narrative.deltas(narrative.flagged(cube(spark, d)), ["model_canon"], "Combined_Content", K.CUES), "model_canon")


_GROUPS = {"False positive": "is_fp", "False negative": "is_fn", "True positive": "is_tp", "True negative": "is_tn", "Catastrophic": "cat"}
_THEMED = f"WITH {CUBE}, {PREPARED}, {_FLAGGED}, {_dense_sql(K.THEMES)}, long AS ({_long_sql(K.THEMES)})"


@query("theme_prevalence", f"{_THEMED} " + " UNION ALL ".join(f"SELECT '{g}' AS outcome_group, family AS theme, round(avg(v), 6) AS mean_density_per_100_tokens, count(*) AS n_documents FROM long WHERE {f} GROUP BY 2" for g, f in _GROUPS.items()))
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.theme_prevalence(narrative.flagged(cube(spark, d)), "Combined_Content", K.THEMES), ["outcome_group", "theme"])


@query("theme_matrix", f"{_THEMED}, o AS (" + " UNION ALL ".join(f"SELECT '{g}' AS g, family AS theme, avg(v) AS m FROM long WHERE {f} GROUP BY 2" for g, f in _GROUPS.items()) + "), t(theme, place) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(K.THEMES)) + ") SELECT theme, place, " + ", ".join(f"""round(coalesce(max(m) FILTER (g = '{g}'), 0), 6) AS "{g}" """ for g in _GROUPS) + "FROM t LEFT JOIN o USING (theme) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = narrative.theme_prevalence(narrative.flagged(cube(spark, d)), "Combined_Content", K.THEMES)
    return _rounded(narrative.theme_matrix(found, K.THEMES), ["theme", "place"])


@query("theme_skew", f"{_THEMED}, s AS (SELECT family AS theme, avg(v) FILTER (is_fp) AS a, avg(v) FILTER (is_fn) AS b FROM long GROUP BY 1) SELECT theme, round(a, 6) AS fp_weight, round(b, 6) AS fn_weight, round(CASE WHEN a + b > 0 THEN (a - b) / (a + b) ELSE 0 END, 6) AS skew_score FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.theme_skew(narrative.flagged(cube(spark, d)), "Combined_Content", K.THEMES), ["theme"])


@query("certainty_error_rates", f"WITH {CUBE}, {PREPARED}, {_FLAGGED}, s AS (SELECT model_canon AS model, count(*) AS n, count(*) FILTER (high) AS n_high_certainty, count(*) FILTER (low_c) AS n_low_certainty, avg(is_error::INT) FILTER (high) AS h, avg(is_error::INT) FILTER (low_c) AS l FROM flagged GROUP BY 1) SELECT model, n, n_high_certainty, n_low_certainty, round(h, 6) AS high_certainty_error_rate, round(l, 6) AS low_certainty_error_rate, round(h - l, 6) AS high_minus_low_error_rate FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.certainty_error_rates(narrative.flagged(cube(spark, d))), ["model"])


@query("catastrophic_rates", f"WITH {CUBE}, {PREPARED}, {_FLAGGED} SELECT model_canon AS model, count(*) AS n, count(*) FILTER (cat) AS n_catastrophic, round(avg(cat::INT), 6) AS catastrophic_failure_rate FROM flagged GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(narrative.catastrophic_rates(narrative.flagged(cube(spark, d))), ["model"])


@query("top_examples", f"WITH {CUBE}, {PREPARED}, {_FLAGGED}, c AS (SELECT *, 'fp' AS \"case\" FROM flagged WHERE is_fp UNION ALL SELECT *, 'fn' FROM flagged WHERE is_fn UNION ALL SELECT *, 'catastrophic' FROM flagged WHERE cat), r AS (SELECT model_canon, \"case\", row_number() OVER (PARTITION BY model_canon, \"case\" ORDER BY ord) AS rank, ord, likelihood_score FROM c) SELECT * FROM r WHERE rank <= 8")
def _(spark: SparkSession, d: str) -> DataFrame:
    return narrative.top_examples(narrative.flagged(cube(spark, d)), ["ord", "likelihood_score"])


def _side_sql(flag: str) -> str:
    return f"(SELECT term, count(*) AS c FROM (SELECT unnest({_WORDS.replace('text', 'Combined_Content')}) AS term FROM flagged WHERE {flag}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)"


@query("ngram_diverging", f"WITH {CUBE}, {PREPARED}, {_FLAGGED}, a AS {_side_sql('is_fp')}, b AS {_side_sql('is_fn')} SELECT coalesce(a.term, b.term) AS term, coalesce(a.c, 0) AS fp_count, coalesce(b.c, 0) AS fn_count FROM a FULL JOIN b USING (term)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return narrative.diverging(narrative.flagged(cube(spark, d)), "Combined_Content", 1)


@query("comparison_levels", f"WITH {CUBE} SELECT DISTINCT shot_type AS level, list_position(['zero', 'single', 'dual'], shot_type)::INT AS preferred FROM cube")
def _(spark: SparkSession, d: str) -> DataFrame:
    return narrative.levels(cube(spark, d), "shot_type", K.SHOT_ORDER)


@query("lda_topics")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.lda(topics.stored_sample(narrative.flagged(cube(spark, d)), "ord", ["Combined_Content", "shot_type"]), "Combined_Content", 4)


@query("nmf_topics")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.nmf(topics.stored_sample(narrative.flagged(cube(spark, d)), "ord", ["Combined_Content", "shot_type"]), "Combined_Content", 4)


@query("shot_topic_skew")
def _(spark: SparkSession, d: str) -> DataFrame:
    return topics.shot_skew(topics.stored_sample(narrative.flagged(cube(spark, d)), "ord", ["Combined_Content", "shot_type"]), "Combined_Content", topics=4)


@query("display_labels_sequences", f"WITH {CUBE}, t(s, l) AS (VALUES " + ", ".join(f"('{s}', '{K.SEQUENCE_NAMES[s]}')" for s in K.SEQUENCE_NAMES) + ") SELECT report_sequence_name, coalesce(l, array_to_string(list_transform(string_split(report_sequence_name, '_'), lambda p: CASE p WHEN 'hist' THEN 'Histology' WHEN 'endo' THEN 'Endoscopy' WHEN 'clinic' THEN 'Clinic letter' END), ' / ') || ' narrative order') AS sequence_label, count(*) AS n FROM cube LEFT JOIN t ON s = report_sequence_name GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = cube(spark, d).groupBy("report_sequence_name").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("report_sequence_name", scores.sequence_label(F.col("report_sequence_name")).alias("sequence_label"), "n")


@query("statistics_by_segment", f"WITH tq(n, t) AS (VALUES {', '.join(f'({n}, {t!r}::DOUBLE)' for n, t in _T.items())}), s AS (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd, count(*) AS n, round(median(c_acctbal), 6) AS median, round(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 6) AS iqr, round(skewness(c_acctbal), 6) AS skewness, round(kurtosis(c_acctbal), 6) AS kurtosis FROM customer GROUP BY 1) SELECT c_mktsegment, round(m, 6) AS mean, round(sd, 6) AS std_dev, n, median, iqr, skewness, kurtosis, round(m - t * sd / sqrt(n), 6) AS ci_lower, round(m + t * sd / sqrt(n), 6) AS ci_upper FROM s LEFT JOIN tq USING (n)")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = descriptive.statistics(_table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")
    return _rounded(found, ["c_mktsegment", "n"])


# ---- order within keys, calls and spreadsheets ----------------------------------------------------------------------


@query("order_statistics", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, round(quantile_cont(l_extendedprice, 0.975), 6) AS q975 FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("x"))
    return _rounded(ranges.quantiles(rows, ["l_returnflag"], "x", {"q25": 0.25, "q50": 0.5, "q975": 0.975}), ["l_returnflag"])


@query("keyed_numbers", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS n FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranges.numbered(rows, ["o_orderpriority"], ["o_totalprice", "o_orderkey"], "n").select("o_orderkey", "o_orderpriority", "n")


def _counting(messages: Sequence[str]) -> list[str]:
    """A responder by the length of the message: it fails for every 7th, is silent for every 11th and wraps its JSON for every 3rd."""
    n = len(messages[0])
    if n % 7 == 0:
        raise RuntimeError(f"no answer to {n}")
    return ["" if n % 11 == 0 else f'Here: {{"n": {n}}} Done.' if n % 3 == 0 else f'{{"n": {n}}}']


_FAILS = "length(text) % 7 = 0 OR length(text) % 11 = 0"


@query("call_outcomes", f"""SELECT conv_id, turn, CASE WHEN {_FAILS} THEN 2 ELSE 1 END AS attempts,
    CASE WHEN length(text) % 7 = 0 THEN 'RuntimeError: no answer to ' || length(text) WHEN length(text) % 11 = 0 THEN 'ValueError: empty response' END AS error,
    CASE WHEN {_FAILS} THEN 'API call failed' ELSE '{{"n": ' || length(text) || '}}' END AS json_response FROM conversations""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as a message of its own: bad ones fail alone."""
    asked = _table(spark, d, "conversations").select("conv_id", "turn", "text")
    found = incremental.respond_to(asked, _counting, "text", incremental.CallPolicy(retries=2, wait=0.0))
    return found.select("conv_id", "turn", "attempts", "error", "json_response")


@query("resumed_batches", "SELECT conv_id, turn, ((row_number() OVER (ORDER BY conv_id, turn) - 1) // 40)::INT AS batch, length(text) AS n_chars FROM conversations")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Turns in batches of 40, written in two commits, of which the second overwrites what the first has left half done."""
    root = f"{scratch.shared_folder(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    rows = sinks.with_batches(_table(spark, d, "conversations").select("conv_id", "turn", F.char_length("text").alias("n_chars")), 40, ["conv_id", "turn"])
    group = F.floor(F.col("batch") / 10).cast("int")
    rows = scratch.stored(rows.withColumn("part", group), "batches")
    sinks.write_partitions(rows.where("part % 2 = 0 or turn > 2").select("conv_id", "turn", "n_chars", "part", "batch"), root, ["part", "batch"])
    sinks.write_partitions(rows.where("part % 2 = 1").select("conv_id", "turn", "n_chars", "part", "batch"), root, ["part", "batch"])
    return spark.read.parquet(root).select("conv_id", "turn", "batch", "n_chars")


@query("spreadsheet_round_trip", "SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal, c_acctbal > 0 AS in_credit, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, 'nation_' || c_nationkey || '.xlsx' AS file FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a workbook for each nation, read again with types."""
    root = f"{scratch.shared_folder(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    rows = _table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), (F.col("c_acctbal") > 0).alias("in_credit"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("to"))
    spreadsheets.write(rows, root, "to", ["c_custkey"], promote_bytes=1 << 40)
    found = spreadsheets.read(spark, root, schema="c_custkey bigint, c_name string, c_acctbal double, in_credit boolean, segment string, path string", file_column="path")
    return found.select("c_custkey", "c_name", "c_acctbal", "in_credit", "segment", F.element_at(F.split("path", "/"), -1).alias("file"))
