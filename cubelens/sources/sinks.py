"""Writing tables, batches and run manifests."""

from __future__ import annotations

import json
import os
import socket
import time
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges
from . import spreadsheets


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite a table; nested columns are written as JSON text where the format can't hold them."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind in ("parquet", "json"):
        getattr(df.write.mode("overwrite"), kind)(path)
    elif kind == "xlsx":
        store, old = _files(df.sparkSession, path)
        store.delete(old, True)
        spreadsheets.write(df, path)
    else:
        raise ValueError(f"unknown format: {kind}")


INDEX = "table string, path string, n_columns int, stage string"


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """(the file system of a path, the path), whatever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    store, found = _files(spark, path)
    return store.exists(found)


def read_table(spark: SparkSession, root: str, *names: str, kind: str = "parquet") -> DataFrame | None:
    """The first of the named tables that an earlier run has written; None if there is none."""
    name = next((n for n in names if exists(spark, f"{root}/{n}")), None)
    return None if name is None else spark.read.format(kind).load(f"{root}/{name}")


def write_tables(tables: Mapping[str, DataFrame], root: str, kind: str = "parquet", aliases: Mapping[str, str] | None = None, stage: str = "all") -> DataFrame:
    """Each table in a folder of its own, columns renamed by ``aliases``; gives an index of what stands there.

    What an earlier run of the same stage (or of "all") has written and this one doesn't is deleted once the new tables
    stand, so that no table outlives its input; other stages' tables stay in the index.
    """
    spark = next(iter(tables.values())).sparkSession
    at = f"{root}/output_index"
    before = [tuple(r) for r in spark.read.schema(INDEX).format(kind).load(at).collect()] if exists(spark, at) else []  # a row for each table
    rows = []
    for name, df in tables.items():
        write_table(df.withColumnsRenamed(dict(aliases or {})), f"{root}/{name}", kind)
        rows.append((name, f"{root}/{name}", len(df.columns), stage))
    for name, path, n, of in before:
        if name in tables:
            continue
        if stage in ("all", of):
            store, old = _files(spark, path)
            store.delete(old, True)
        else:
            rows.append((name, path, n, of))
    index = spark.createDataFrame(rows, INDEX)
    write_table(index.coalesce(1), at, kind)
    return index


def mirror_tables(spark: SparkSession, root: str, folder: str, layout: Mapping[str, str], aliases: Mapping[str, str], kind: str = "parquet") -> DataFrame:
    """Written tables once more below ``folder``, where ``layout`` puts them, under readable column names; gives the folder's index.

    The folder holds copies alone and is made anew.
    """
    store, old = _files(spark, f"{root}/{folder}")
    store.delete(old, True)
    rows = []
    for name, place in layout.items():
        if (df := read_table(spark, root, name, kind=kind)) is not None:
            path = f"{root}/{folder}/{place}/{name}"
            write_table(df.withColumnsRenamed(dict(aliases)), path, kind)
            rows.append((name, path, len(df.columns), "mirror"))
    index = spark.createDataFrame(rows, INDEX)
    write_table(index.coalesce(1), f"{root}/{folder}/output_index", kind)
    return index


def write_json(data: object, path: str) -> None:
    """A small JSON document, in the store that the path names; without a session in a local file."""
    text = json.dumps(data, indent=2)
    spark = SparkSession.getActiveSession()
    if spark is None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text)
        return
    store, found = _files(spark, path)
    out = store.create(found, True)
    out.write(bytearray(text.encode()))
    out.close()


def with_batches(df: DataFrame, size: int, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows with the number ``batch`` of their ``size`` rows in order, within each key; without keys over all rows.

    Numbers are found in ranges of the sorted rows, so that batches are the same however many ranges there are, and no
    task sees all rows, or all rows of a key.
    """
    return ranges.numbered(df, keys or [], order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("int")).drop("_n")


def write_batches(df: DataFrame, root: str, runner: str, experiment: str, order: list[str], promote_bytes: int = spreadsheets.PROMOTE_BYTES) -> None:
    """Rows with ``batch`` as spreadsheets ``<runner>/<experiment>/batch_<n>.xlsx``, all or none; large ones as Parquet."""
    rows = df.withColumn("_file", F.concat(F.lit(f"{runner}/{experiment}/batch_"), F.col("batch").cast("string"))).drop("batch")
    spreadsheets.write(rows, root, "_file", order, promote_bytes)


def export_answers(answers: DataFrame, cases: DataFrame, root: str, kind: str = "xlsx", promote_bytes: int = spreadsheets.PROMOTE_BYTES) -> None:
    """A run's answers beside their cases, as batches under the names that the scan of batches reads.

    Spreadsheets are files ``<runner>/<experiment>/batch_<n>.xlsx``, CSV folders of them ``<runner>/<experiment>/batch=<n>``.
    """
    from . import batches

    for runner, experiment in sorted(tuple(r) for r in answers.select("runner_name", "experiment_name").distinct().collect()):  # a configuration's size
        names = batches.result_columns(runner, experiment)
        own = answers.where((F.col("runner_name") == runner) & (F.col("experiment_name") == experiment)).select(
            "episode_id", "batch", F.col("full_response").alias(names["full"]), F.col("json_response").alias(names["json"]), F.col("message").alias(names["payload"]),
            F.col("truncated").alias(names["truncated"]), F.col("truncated_sections").alias(names["sections"]),
        )
        rows = cases.join(own, "episode_id")
        if kind == "xlsx":
            write_batches(rows, root, runner, experiment, ["patient_id", "procedure_date"], promote_bytes)
        else:
            rows.write.mode("overwrite").partitionBy("batch").option("header", True).option("escape", '"').csv(f"{root}/{runner}/{experiment}")


def next_batch(spark: SparkSession, root: str) -> int:
    """One more than the highest batch number below the root; 0 where there is none."""
    from .batches import find_batches

    import re

    found = [int(m[1]) for p in find_batches(spark, root, ("*",)) if (m := re.search(r"batch[_=](\d+)", p))]
    return max(found, default=-1) + 1


def undone(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't among what is done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


COMMIT = "runner_name string, experiment_name string, first_batch int, last_batch int, answered bigint"


def answered(spark: SparkSession, log: str) -> dict[tuple[str, str], int]:
    """Cases that each runner and experiment has answered, by a run's commit log: a number for each pair of the configuration."""
    if not exists(spark, log):
        return {}
    lines = spark.read.schema(COMMIT).json(log).groupBy("runner_name", "experiment_name").agg(F.max("answered"))
    return {(r[0], r[1]): r[2] for r in lines.collect()}


def write_partitions(df: DataFrame, root: str, by: list[str]) -> None:
    """Rows below ``root/key=value``; partitions that are there already and have new rows are replaced whole, others stay.

    Spark moves files to their place when the job commits: a job that fails leaves none.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(root)


def append_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def call_lines(calls: DataFrame, token_limit: int) -> DataFrame:
    """A line of JSON for each call: what was asked of whom, hashes of template and message, what was cut, and the outcome."""
    size = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    cells = F.struct(
        F.col("experiment_name").alias("experiment"), F.col("prompt_name").alias("prompt_template"), "report_sequence_name", "report_sequence", "context_note_timing", "runner_name", F.col("url").alias("endpoint"), "row_index",
        "patient_id", "episode_id", F.col("batch").alias("batch_number"), F.lit(token_limit).alias("token_limit"), "prompt_template_sha256", F.sha2("message", 256).alias("message_sha256"), F.col("truncated").alias("section_truncated"),
        "truncated_sections", "attempts", "error", size("full_response").alias("full_response_chars"), size("json_response").alias("json_response_chars"), F.current_timestamp().alias("timestamp"),
    )
    return calls.select(F.to_json(cells).alias("value"))


def append_manifest(spark: SparkSession, path: str, entry: Mapping[str, object]) -> None:
    """One line of run history, with time, host and process."""
    line = json.dumps({"timestamp": time.time(), "host": socket.gethostname(), "pid": os.getpid(), **entry}, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
