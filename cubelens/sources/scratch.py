"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may go without and gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read again: their input is not run a second time and lost executors cost one stage.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = f"{shared_folder(spark).rstrip('/')}/cubelens-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _MADE[app])
    path = f"{_MADE[app]}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
