"""What the operators share: scratch tables, shipping the package to executors, reading Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship  # noqa: F401

_SCRATCH: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", found)
        return found
    raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")


def _remove_scratch(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = f"{shared_root(spark).rstrip('/')}/cubelens-{uuid.uuid4().hex}"
        atexit.register(_remove_scratch, spark, _SCRATCH[app])
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:10]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no result reads any more."""
    _remove_scratch(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, and where they are written, for :func:`drop_scratch`."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bounded_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows that come first by a hash of the key, ties by the key.

    Rows beyond about twice n are left out by the hash before any are sorted, so that what tasks hand on is bounded by
    n and not by the number of tasks.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    share = min(1.0, 2 * n / max(1, df.count()))
    return df.where(place < int(share * (1 << 40))).orderBy(place, *key).limit(n)


def release() -> None:
    """Hand memory that earlier tasks of this Python worker have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def released(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of a ``mapInArrow``, handing freed memory back after its task: a worker lives on between stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory()


def is_there(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of a table; a missing one counts as null."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]) if columns else df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets of the texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text and ``rows`` rows, one row at least: bounds what numpy holds at once."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), n, start + rows)
        yield start, stop
        start = stop
