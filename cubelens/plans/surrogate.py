"""The evaluation cube over the driver's ``events``, in Spark and as DuckDB SQL with the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

MODELS = {"view": "mixtral7b", "click": "m42_8b", "error": "deepseek32b", "purchase": "qwen32b", "signup": "gemma4_31b"}
SHOTS = ("zero", "single", "dual")
TEMPERATURES = (0.5, 0.6, 0.75, 1.0, 0.9)
SEQUENCES = tuple(K.DOCUMENT_SETS)
PHRASES = (
    "History of known crohn disease.", "Active flare with raised crp and abdominal pain.", "Normal mucosa with no evidence of disease.", "Colonoscopy and biopsy of the terminal ileum.",
    "Started steroids and infliximab with good response.", "Likely infection, possibly ischaemic colitis.", "Unclear and equivocal, may be ibs.", "Stable and well, follow up in clinic.",
    "Prior surgery with adhesions; post operative review.", "Chronic ulcerative colitis, histology may suggest healing.",
)
MORE = ("Repeat endoscopy is planned.", "Treatment with mesalazine.", "Nothing else of note.", "Bleeding and diarrhoea.", "In remission.", "Consider biologic therapy.", "Functional symptoms are possible.")


def _pick(values: tuple, index: Column) -> Column:
    return F.array(*map(F.lit, values))[index.cast("int")]


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: subject, configuration, scores with gaps, labels, markers and a narrative."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    if e.rdd.getNumPartitions() < cores:  # a file of few row groups would be worked on by as few cores
        e = e.repartition(cores, "event_id")
    # k comes from a generator: filters on what follows from it would be pushed to the scan and parse the text for each mention
    e = e.withColumn("k", F.explode(F.array(F.get_json_object("props", "$.k").cast("bigint"))))
    i, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    model = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(m)) for t, m in MODELS.items()])
    out = e.select(
        i.alias("ord"), F.concat(F.lit("P"), u.cast("string")).alias("patient_id"), u.alias("user_id"), k.alias("k"), model.alias("model_canon"), "ts", "value",
        _pick(SHOTS, k % 3).alias("shot_type"), _pick(TEMPERATURES, i % 5).alias("temperature"), _pick(SEQUENCES, i % 14).alias("report_sequence_name"),
        F.when(k % 17 != 0, (k % 13).cast("double")).alias("likelihood_score"), F.when(k % 19 != 0, (k % 11).cast("double")).alias("certainty_score"), ((k + i) % 11).cast("double").alias("complexity_score"),
        (F.col("value") >= 35).cast("int").alias("truth"), (i % 17 == 0).alias("truncated"), (u % 3 == 1).cast("int").alias("ground_truth"),
        F.when(u % 5 != 0, (u % 2).cast("int")).alias("preceding_clinic_ibd_flag"), F.when(u % 7 != 0, (F.floor(u / 2) % 2).cast("int")).alias("following_clinic_ibd_flag"),
        F.when(u % 11 != 0, (u % 3 == 0).cast("int")).alias("endoscopy_ibd_flag"), F.when(u % 13 != 0, (u % 4 == 1).cast("int")).alias("histology_ibd_flag"),
        F.concat_ws(" ", _pick(PHRASES, k % 10), _pick(MORE, i % 7), _pick(PHRASES, u % 10)).alias("Combined_Content"),
    )
    name = F.concat("shot_type", F.lit("_shot_"), "report_sequence_name")
    temp = F.replace(F.format_string("%.2f", "temperature"), F.lit("."), F.lit("_"))
    runner = F.concat("model_canon", F.lit("_t"), temp)
    out = out.withColumns({"experiment_name": name, "runner_name": runner})
    return out.withColumns({"folder": F.concat("runner_name", F.lit("_"), "experiment_name"), "full_response": response(F.col("ord"), F.col("k"))})


def response(i: Column, k: Column) -> Column:
    """A model response in one of eight states, by the row: clean, wrapped, mended, blank, fenced, none or out of range."""
    text = F.concat(
        F.lit('{"Title": "T'), i.cast("string"), F.lit('", "Likelihood of IBD": '), F.when(i % 8 == 7, F.lit("99")).otherwise((k % 11).cast("string")),
        F.lit(', "Certainty Level": '), (k % 10).cast("string"), F.lit(', "Complexity of Case": '), (k % 9).cast("string"), F.lit(', "Features": ["a, b", "c"]}'),
    )
    states = {1: F.concat(F.lit("Here it is: "), text, F.lit(" Done.")), 2: F.replace(text, F.lit('"c"]}'), F.lit('"c"],}')), 3: F.substr(text, F.lit(1), F.length(text) - 1), 4: F.lit("   "), 5: F.concat(F.lit("```json\n"), text, F.lit("\n```")), 6: F.lit("no json at all")}
    return F.coalesce(*[F.when(i % 8 == n, s) for n, s in states.items()], text)


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in values) + "]"


CUBE = f"""
cube_a AS (
  SELECT event_id AS ord, 'P' || user_id AS patient_id, user_id, (props->>'k')::BIGINT AS k, value, ts,
    CASE event_type {" ".join(f"WHEN '{t}' THEN '{m}'" for t, m in MODELS.items())} END AS model_canon, event_id AS i FROM events
), cube_b AS (
  SELECT *, {_list(SHOTS)}[k % 3 + 1] AS shot_type, {_list(TEMPERATURES)}[i % 5 + 1] AS temperature, {_list(SEQUENCES)}[i % 14 + 1] AS report_sequence_name,
    CASE WHEN k % 17 <> 0 THEN (k % 13)::DOUBLE END AS likelihood_score, CASE WHEN k % 19 <> 0 THEN (k % 11)::DOUBLE END AS certainty_score, ((k + i) % 11)::DOUBLE AS complexity_score,
    (value >= 35)::INT AS truth, i % 17 = 0 AS truncated, (user_id % 3 = 1)::INT AS ground_truth,
    CASE WHEN user_id % 5 <> 0 THEN (user_id % 2)::INT END AS preceding_clinic_ibd_flag, CASE WHEN user_id % 7 <> 0 THEN ((user_id // 2) % 2)::INT END AS following_clinic_ibd_flag,
    CASE WHEN user_id % 11 <> 0 THEN (user_id % 3 = 0)::INT END AS endoscopy_ibd_flag, CASE WHEN user_id % 13 <> 0 THEN (user_id % 4 = 1)::INT END AS histology_ibd_flag,
    {_list(PHRASES)}[k % 10 + 1] || ' ' || {_list(MORE)}[i % 7 + 1] || ' ' || {_list(PHRASES)}[user_id % 10 + 1] AS Combined_Content
  FROM cube_a
), cube_c AS (
  SELECT *, shot_type || '_shot_' || report_sequence_name AS experiment_name, model_canon || '_t' || replace(printf('%.2f', temperature), '.', '_') AS runner_name FROM cube_b
), cube_d AS (
  SELECT *, '{{"Title": "T' || i || '", "Likelihood of IBD": ' || CASE WHEN i % 8 = 7 THEN '99' ELSE (k % 11)::VARCHAR END || ', "Certainty Level": ' || (k % 10) || ', "Complexity of Case": ' || (k % 9) || ', "Features": ["a, b", "c"]}}' AS text FROM cube_c
), cube AS (
  SELECT * EXCLUDE (text), runner_name || '_' || experiment_name AS folder,
    CASE i % 8 WHEN 1 THEN 'Here it is: ' || text || ' Done.' WHEN 2 THEN replace(text, '"c"]}}', '"c"],}}') WHEN 3 THEN left(text, length(text) - 1) WHEN 4 THEN '   '
      WHEN 5 THEN '```json' || chr(10) || text || chr(10) || '```' WHEN 6 THEN 'no json at all' ELSE text END AS full_response,
    CASE i % 8 WHEN 1 THEN 'extracted_embedded_json' WHEN 2 THEN 'repaired_json' WHEN 3 THEN 'repaired_json' WHEN 4 THEN 'empty' WHEN 6 THEN 'unparseable' WHEN 7 THEN 'schema_invalid' ELSE 'raw_valid_json' END AS tag
  FROM cube_d
)
"""  # fmt: skip


def bucket_sql(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 0 AND 1 THEN ({x} >= 0.5)::INT WHEN {x} > 1 AND {x} < 10 THEN floor({x} + 0.5)::INT WHEN {x} = 10 THEN 10 END)"


PREPARED = f"""
prep AS (
  SELECT *, truth AS y, {bucket_sql("likelihood_score")} AS bucket FROM cube
), prepared AS (
  SELECT *, bucket::DOUBLE / 10 AS prob FROM prep WHERE y IS NOT NULL
), policy AS (
  SELECT *, unnest(list_filter(['all_attempts', CASE WHEN bucket IS NOT NULL THEN 'complete_case' END, CASE WHEN bucket IS NOT NULL AND NOT truncated THEN 'non_truncated_only' END], lambda x: x IS NOT NULL)) AS denominator,
    coalesce(prob, 0) AS p FROM prepared
)
"""

COUNTS = """count(*)::BIGINT AS n, count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp,
  count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn, sum(((p - y) * (p - y))::DECIMAL(18, 8))::DOUBLE AS sq"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


MACRO_F1 = f"""(CASE WHEN tp + fp + fn > 0 THEN {_div("2 * tp", "2 * tp + fp + fn")} ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN {_div("2 * tn", "2 * tn + fp + fn")} ELSE 0 END)
  / nullif((tp + fp + fn > 0)::INT + (tn + fp + fn > 0)::INT, 0)"""
MCC = _div("tp * tn - fp * fn", "sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))")
POINT = {
    "brier": _div("sq", "n"), "macro_f1": MACRO_F1, "recall": _div("tp", "tp + fn"), "mcc": MCC, "precision": _div("tp", "tp + fp"),
    "accuracy": _div("tp + tn", "n"), "specificity": _div("tn", "tn + fp"), "npv": _div("tn", "tn + fn"),
}


def point_sql(keys: str, source: str) -> str:
    """The metric table of a source with y and p, measures rounded to 6 places."""
    measures = ", ".join(f"round({x}, 6) AS {m}" for m, x in POINT.items())
    return f"SELECT {keys}, n, {measures} FROM (SELECT {keys}, {COUNTS} FROM {source} GROUP BY ALL)"
