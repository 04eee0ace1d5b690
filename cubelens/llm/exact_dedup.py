"""Exact deduplication as a stateful stream.

A Structured Streaming aggregation keyed by the digest of the normalised text keeps, without expiry and in
RocksDB, how often the digest was seen and the best row so far: its length, stable identifier and content
locator (file and row). With a folder for the state, later files meet what earlier runs have seen. Hits, rows whose
digest stands in the state more than once, are then compared byte by byte; rows whose texts differ in spite of one
digest are grouped by their text instead, so that a collision can't join different texts.

Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Locators of hits, 8 bytes each, up to which they are sent to the scan; beyond that the texts are shuffled to them.
MOST_SENT = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SPACES, F.coalesce(text.cast("string"), F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rows(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = normalised(F.col(text_col))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long").alias("n"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
        F.struct(df.metadataColumn("_metadata")["file_path"].alias("file"), df.metadataColumn("_metadata")["row_index"].alias("row")).alias("locator"),
    )


def _session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session with the settings of this one and others beside; other queries don't see them."""
    own = spark.newSession()
    for key, value in spark.sql("SET").collect():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    return own


def stream_state(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None, state_dir: str | None = None,
) -> DataFrame:
    """One row for each digest: ``digest, best(n, low_id, locator), group_size``; the state after all input.

    ``state_dir``, a shared folder, keeps the state: another call reads only files that are new at ``path``, and its
    rows meet the state of all earlier ones. Without it the state goes when the stream has ended.
    """
    rocksdb = "spark.sql.streaming.stateStore.rocksdb"
    own = _session(spark, {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        # many small stores: one bounded cache for all of an executor, small write buffers, no space set aside on disk
        f"{rocksdb}.boundedMemoryUsage": "true",
        f"{rocksdb}.maxMemoryUsageMB": "128",
        f"{rocksdb}.writeBufferSizeMB": "4",
        f"{rocksdb}.maxWriteBufferNumber": "2",
        f"{rocksdb}.allowFAllocate": "false",
        f"{rocksdb}.trackTotalNumberOfRows": "false",
    })
    reader = own.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if common.is_directory(spark, path):
        source = reader.parquet(path)
    else:  # a file source watches a folder
        parent, _, name = path.rpartition("/")
        source = reader.option("pathGlobFilter", name).parquet(parent)
    best = F.struct("n", (-F.col("doc_id")).alias("low_id"), "locator")
    grouped = _rows(source, id_col, text_col, digest).groupBy("digest").agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out, marks = (f"{state_dir}/batches", f"{state_dir}/checkpoint") if state_dir else (common.scratch(spark, "dedup-state"), common.scratch(spark, "dedup-marks"))
    query = (
        grouped.writeStream.outputMode("update").option("checkpointLocation", marks).trigger(availableNow=True)
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    )
    query.awaitTermination()
    if not state_dir:
        common.drop_scratch(spark, marks)
    fields = "digest string, best struct<n: bigint, low_id: bigint, locator: struct<file: string, row: bigint>>, group_size bigint, batch int"
    if not common.is_there(spark, out):  # no input files
        return spark.createDataFrame([], fields).drop("batch")
    state = spark.read.schema(fields).parquet(out)
    if not files_per_trigger and not state_dir:
        return state.drop("batch")
    latest = state.groupBy("digest").agg(F.max(F.struct("batch", "best", "group_size")).alias("x"))
    return latest.select("digest", "x.best", "x.group_size")


def dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_trigger: int | None = None, state_dir: str | None = None,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, digest`` for each row of the Parquet table at ``path``.

    Texts are equal when they are after deleting ``[\\x20\\x09-\\x0D]``, however long. Of equal texts the row with the
    most code points stays, then the smallest id; a null id comes after all others; of rows with the same id and length
    the one with the last file and row stays, so that one row of a group is kept, whatever repeats. Null texts are empty
    ones, and empty texts are one group. An empty table gives no rows; other columns are not read, whatever their names.
    ``state_dir`` is that of :func:`stream_state`.
    """
    state = stream_state(spark, path, id_col, text_col, digest, files_per_trigger, state_dir)
    rows = _rows(spark.read.parquet(path), id_col, text_col, digest)
    other = [] if digest is sha256 else [sha256(F.col("norm")).alias("text_sha256")]
    slim = rows.select("doc_id", "digest", "locator", *other).join(state, "digest")
    kept = (F.col("locator") == F.col("best.locator")).alias("kept")
    found = slim.select("doc_id", (-F.col("best.low_id")).alias("keep_id"), "group_size", kept, *(c for c in ("text_sha256",) if other), "digest", _place(F.col("locator")).alias("place"))
    found = common.stored(found, "dedup-found")
    found = found if other else found.withColumn("text_sha256", F.col("digest"))
    shape = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "digest"]
    # full bytes on hits: within a digest the least and the greatest text must be one
    hits = found.where("group_size > 1").select("place")
    if hits.count() <= MOST_SENT:  # 8 MB
        hits = F.broadcast(hits)
    table = spark.read.parquet(path)
    metadata = table.metadataColumn("_metadata")
    place = _place(F.struct(metadata["file_path"], metadata["row_index"])).alias("place")
    located = table.select(F.col(text_col).alias("text"), place).join(hits, "place", "left_semi")
    texts = located.select(normalised(F.col("text")).alias("norm")).select(digest(F.col("norm")).alias("digest"), "norm")
    differing = texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b").select("digest")
    differing = common.stored(differing, "dedup-collisions")
    if differing.isEmpty():
        return found.select(*shape)
    apart = rows.join(differing, "digest", "left_semi")
    by_text = apart.groupBy("digest", "norm").agg(F.max(F.struct("n", (-F.col("doc_id")).alias("low_id"), "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    again = apart.join(by_text, ["digest", "norm"]).withColumn("text_sha256", sha256(F.col("norm")))
    again = again.select("doc_id", (-F.col("best.low_id")).alias("keep_id"), "group_size", kept, "text_sha256", "digest")
    return found.join(differing, "digest", "left_anti").select(*shape).unionByName(again)


def _place(locator: Column) -> Column:
    """Eight bytes of a locator; two that share them only bring a row more to compare."""
    return F.xxhash64(locator)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet").drop("digest")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
