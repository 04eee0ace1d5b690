"""Batch exports: discovery, multi-format scan with provenance, and wide responses as long rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spreadsheets

PATTERNS = ("batch_*.parquet", "batch_*.csv", "batch_*.json", "batch_*.xlsx")
ROLES = {"json": "_Json_Response_", "full": "_Full_Response_", "payload": "_Payload_"}


def _paths(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Files below the root whose name fits, in order, through Hadoop so that any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return []
    import fnmatch

    found, files = [], fs.listFiles(top, True)
    while files.hasNext():
        path = files.next().getPath()
        if fnmatch.fnmatch(path.getName(), pattern):
            found.append(path.toString())
    return sorted(found)


def find_batches(spark: SparkSession, root: str, patterns: Sequence[str] = PATTERNS) -> list[str]:
    return sorted({p for pattern in patterns for p in _paths(spark, root, pattern)})


def provenance(df: DataFrame) -> DataFrame:
    """``source_file, source_parent, experiment_name, runner_name`` from ``<runner>/<experiment>/<file>``, and a row order."""
    if "_path" not in df.columns:  # spreadsheets bring it
        df = df.select("*", F.col("_metadata.file_path").alias("_path"))
    part = lambda i: F.regexp_extract("_path", r"([^/]+)/([^/]+)/([^/]+)$", i)
    return df.withColumns({"source_file": part(3), "source_parent": part(2), "experiment_name": part(2), "runner_name": part(1)})


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under all columns by name; a column that a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """``path, sha256`` of whole files, for the record of a run's inputs."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("sha256"))


def read_batches(spark: SparkSession, root: str, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """All batch files in one frame, columns by name; columns that only some have are null elsewhere."""
    readers = {
        "parquet": lambda p: spark.read.option("mergeSchema", True).parquet(*p),
        "csv": lambda p: union([provenance(spark.read.csv(x, header=True, multiLine=True, escape='"')) for x in p]),
        "json": lambda p: spark.read.json(p),
        "xlsx": lambda p: spreadsheets.read(spark, *p, file_column="_path"),
    }
    frames = []
    for kind, read in readers.items():
        paths = [p for p in find_batches(spark, root, patterns) if p.endswith(f".{kind}")]
        if paths:
            df = read(paths)
            frames.append(df if kind == "csv" else provenance(df))
    if not frames:
        raise FileNotFoundError(f"no batch files below {root}")
    return union(frames)


# Percent codes of date formats and Spark's letters for them.
CODES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM"}


def spark_format(pattern: str) -> str:
    """A date format in Spark's letters; one that has no percent code is in them already."""
    parts = re.split(r"(%.)", pattern)
    if len(parts) == 1:
        return pattern
    unknown = [p for p in parts[1::2] if p not in CODES]
    if unknown:
        raise ValueError(f"no such date code: {', '.join(unknown)}")
    return "".join(CODES.get(p, re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p)) for p in parts)


def read_file(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """A table by its suffix: CSV, spreadsheet or else Parquet. With ``infer`` the columns of a CSV get types."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=infer)
    return spreadsheets.read(spark, path) if path.endswith(".xlsx") else spark.read.parquet(path)


def read_source(spark: SparkSession, path: str, id_column: str, date_column: str, text_column: str, date_format: str | None, names: tuple[str, str, str]) -> DataFrame:
    """A dated text source: id upper and trimmed, date parsed or null, text never null; rows without a date go.

    A missing id becomes ``NAN`` and stays, as a text of its own. Without a format dates are read as ISO dates or times;
    formats may be written with percent codes.
    """
    df = read_file(spark, path)
    key = F.upper(F.trim(F.coalesce(F.col(id_column).cast("string"), F.lit("nan"))))
    day = F.try_to_timestamp(F.col(date_column).cast("string"), *([F.lit(spark_format(date_format))] if date_format else [])).cast("timestamp_ntz")
    out = df.select(key.alias(names[0]), day.alias(names[1]), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias(names[2]))
    return out.where(F.col(names[1]).isNotNull())


def response_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Response columns by part; any other that begins with ``Truncated_`` is a truncation flag."""
    out: dict[str, list[str]] = {r: [] for r in (*ROLES, "truncated")}
    for c in columns:
        role = next((r for r, mark in ROLES.items() if mark in c), "truncated" if c.startswith("Truncated_") else None)
        if role:
            out[role].append(c)
    return out


def first_value(columns: Sequence[str], default: object) -> Column:
    """The first of the columns that isn't null, else the default; a boolean default makes the result boolean."""
    kind = "boolean" if isinstance(default, bool) else "string"
    return F.coalesce(*[F.col(f"`{c}`").cast(kind) for c in columns], F.lit(default).cast(kind))


def result_columns(runner: str, experiment: str) -> dict[str, str]:
    """Names under which a runner's results of an experiment are exported."""
    return {
        "full": f"{runner}_Full_Response_{experiment}", "json": f"{runner}_Json_Response_{experiment}", "payload": f"{runner}_Payload_{experiment}",
        "truncated": f"Truncated_{experiment}", "sections": f"Truncated_Sections_{experiment}",
    }


def with_result_columns(df: DataFrame, runner: str, experiment: str) -> DataFrame:
    names = result_columns(runner, experiment)
    kinds = {"truncated": "boolean"}
    return df.withColumns({n: F.lit(None).cast(kinds.get(r, "string")) for r, n in names.items() if n not in df.columns})


def normalise(df: DataFrame, metadata: dict[str, dict] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Wide batch rows as the long fact table: factors from names, responses coalesced and parsed, scores as numbers.

    ``metadata`` maps runners to ``temperature`` and ``display_name``; both fall back to what the name says.
    """
    from ..functions import jsonrepair, scores, text

    routed = response_columns(df.columns)
    metadata = metadata or {}
    names = {k: m["display_name"] for k, m in metadata.items() if m.get("display_name")}
    temps = {k: float(m["temperature"]) for k, m in metadata.items() if m.get("temperature") is not None}
    runner = F.col("runner_name")
    shot, sequence = scores.experiment_parts(F.col("experiment_name"))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in temps.items() for x in kv]), runner) if temps else F.lit(None).cast("double")
    temperature = F.coalesce(known, scores.temperature_from_name(runner))
    out = df.withColumns({
        "shot_type": shot, "report_sequence_name": sequence, "model": runner, "temperature": temperature, "model_canon": scores.canonical_model(runner, mapping),
        "full_response": first_value(routed["full"], ""), "json_response": first_value(routed["json"], ""), "payload": first_value(routed["payload"], ""),
        "truncated": first_value([c for c in routed["truncated"] if dict(df.dtypes)[c] in ("boolean", "string") and not c.startswith("Truncated_Sections_")], False),
    })
    out = out.withColumns({
        "icl_shots": scores.icl_shots(F.col("shot_type")),
        "display_model": scores.display_model(runner, runner, F.col("model_canon"), F.col("temperature"), names or None),
        "is_primary_configuration": scores.is_primary(F.col("model_canon"), F.col("temperature"), F.col("shot_type"), F.col("report_sequence_name")),
        "response_tokens": text.token_count(F.col("full_response")),
    })
    clues, why = text.prompt_sections(F.col("full_response"))
    out = out.withColumns({"clues_text": clues, "reasoning_text": why, "_a": jsonrepair.parse_response("json_response"), "_b": jsonrepair.parse_response("full_response")})
    out = out.withColumn("_r", F.when(F.col("_a.payload").isNotNull(), F.col("_a")).otherwise(F.col("_b")))
    value = lambda n: jsonrepair.payload_number(F.col("_r.payload"), n)
    out = out.withColumns({
        "json_parse_success": F.col("_r.payload").isNotNull().cast("int"), "json_repair_type": F.col("_r.repair_type"), "json_schema_valid": F.col("_r.schema_valid").cast("int"),
        "likelihood_score": value("Likelihood of IBD"), "certainty_score": value("Certainty Level"), "complexity_score": value("Complexity of Case"),
        "Title": F.get_json_object("_r.payload", "$.Title"), "Features": F.from_json(F.get_json_object("_r.payload", "$.Features"), "array<string>"),
        "folder": scores.folder_label(F.col("display_model"), F.col("shot_type"), F.col("report_sequence_name")),
        "ord": F.xxhash64("_path", F.monotonically_increasing_id()) if "_path" in df.columns else F.monotonically_increasing_id(),
    })
    wide = [c for cs in routed.values() for c in cs]
    return out.drop("_a", "_b", "_r", "_path", *wide)
