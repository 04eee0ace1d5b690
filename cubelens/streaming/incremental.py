"""Incremental runs: resumable model calls over arriving cases, and running summaries with late data.

The engine's batch operators run on finished tables; these are their Structured Streaming forms.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import jsonrepair
from ..functions.text import client_json

FAILED, UNREADABLE = "API call failed", "No processable JSON response"

Respond = Callable[[Sequence[str]], Sequence[str]]


def stub(messages: Sequence[str]) -> list[str]:
    """A deterministic responder for tests."""
    import json
    import zlib

    return [json.dumps({"Likelihood of IBD": zlib.crc32(m.encode()) % 11, "Certainty Level": len(m) % 11, "Complexity of Case": 3}) for m in messages]


@dataclass(frozen=True)
class CallPolicy:
    """How one message is called: tries, the first pause between them (it doubles), seconds for a try, calls at once in a
    task, and calls a second to one endpoint over all tasks (None: no limit)."""

    retries: int = 3
    wait: float = 0.5
    timeout: float | None = None
    at_once: int = 8
    per_second: float | None = None


def _within(respond: Respond, message: str, timeout: float | None) -> str:
    """The response to one message, or a TimeoutError after so many seconds.

    A call that hangs goes on in a daemon thread, which ends with the worker and holds up neither it nor the task.
    """
    if timeout is None:
        return respond([message])[0]
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((respond([message])[0], None))
        except BaseException as e:  # handed to the caller
            box.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        found, error = box.get(timeout=timeout)
    except queue.Empty:
        raise TimeoutError(f"no response within {timeout:g} s") from None
    if error is not None:
        raise error
    return found


def call_one(respond: Respond, message: str, policy: CallPolicy, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, str | None]:
    """(response, tries, error) of one message: tried again with doubling pauses after an error, the timeout or an empty response."""
    error = None
    for attempt in range(1, policy.retries + 1):
        try:
            found = _within(respond, message, policy.timeout)
            if isinstance(found, str) and found.strip():
                return found, attempt, None
            raise ValueError("empty response")
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
            if attempt < policy.retries:
                sleep(policy.wait * 2 ** (attempt - 1))
    return FAILED, policy.retries, error


class Pace:
    """Starts of calls to each endpoint, held ``gap`` seconds apart."""

    def __init__(self, gap: float):
        self.gap, self.next, self.lock = gap, {}, threading.Lock()

    def wait(self, endpoint: object) -> None:
        if not self.gap:
            return
        with self.lock:
            now = time.monotonic()
            at = max(now, self.next.get(endpoint, now))
            self.next[endpoint] = at + self.gap
        time.sleep(at - now)


def call_each(respond: Respond | Mapping[object, Respond], messages: Sequence[str], policy: CallPolicy, endpoints: Sequence[object] | None = None, pace: Pace | None = None) -> list[tuple[str, int, str | None]]:
    """The outcome of every message by itself, in order; ``at_once`` messages are under way at a time."""
    out: list = [None] * len(messages)
    left = iter(range(len(messages)))
    lock = threading.Lock()

    def work() -> None:
        while True:
            with lock:
                i = next(left, None)
            if i is None:
                return
            if pace is not None:
                pace.wait(endpoints[i] if endpoints is not None else None)
            out[i] = call_one(respond[endpoints[i]] if isinstance(respond, Mapping) else respond, messages[i], policy)

    threads = [threading.Thread(target=work, daemon=True) for _ in range(min(policy.at_once, len(messages)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def respond_to(df: DataFrame, respond: Respond | Mapping[object, Respond], message: str = "message", policy: CallPolicy = CallPolicy(), endpoint: str | None = None) -> DataFrame:
    """Rows with ``full_response, json_response, attempts, error``: each message has its own tries, timeout and outcome.

    A message that never succeeds says so in both responses and its last error in ``error``, which is null else; other
    messages don't wait for it beyond its place among ``at_once``. The rate is shared by the tasks that run at once.
    ``respond`` is one function, or one for each value of the column ``endpoint``.
    """
    columns = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields]
    tasks = df.sparkSession.sparkContext.defaultParallelism
    gap = tasks / policy.per_second if policy.per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(gap)
        for rows in batches:
            found = call_each(respond, rows[message].tolist(), policy, rows[endpoint].tolist() if endpoint else None, pace)
            full, tries, errors = zip(*found, strict=True) if found else ((), (), ())
            yield rows.assign(full_response=list(full), attempts=list(tries), error=pd.Series(errors, index=rows.index, dtype=object))

    out = df.mapInPandas(run, ", ".join([*columns, "full_response string", "attempts int", "error string"]))
    json_text = F.when(F.col("error").isNull(), F.coalesce(client_json(F.col("full_response")), F.lit(UNREADABLE))).otherwise(FAILED)
    return out.withColumn("json_response", json_text)


def run_available(cases: DataFrame, respond: Respond, out: str, checkpoint: str) -> None:
    """Answer the cases that arrived since the last run, and stop; the checkpoint is the resume cursor."""
    query = (
        respond_to(cases, respond).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_cases(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _timed(df: DataFrame, time: str) -> DataFrame:
    """Event time as a timestamp with time zone, which watermarks need."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def parse_counts(responses: DataFrame, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Parse outcomes by window and folder; rows later than the watermark are left out."""
    tagged = responses.withColumn("tag", jsonrepair.parse_response("full_response")["repair_type"])
    return _timed(tagged, time).withWatermark(time, late).groupBy(F.window(time, window), "folder", "tag").agg(F.count(F.lit(1)).alias("n"))


def dropout_counts(rows: DataFrame, keys: list[str], time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and rows without a score by window and key."""
    gone = F.col("likelihood_score").isNull() | F.col("certainty_score").isNull()
    return _timed(rows, time).withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("dropped"))


def start_summary(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
