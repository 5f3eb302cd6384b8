"""Task states over a stream of task events, kept between micro-batches, with timers for retries.

The rules are those of ``operators.lifecycle.fold_tasks``. A task that waits for a retry has a timer; when the stream's time
has passed it, the task is said to be due. State is in the checkpoint, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators.lifecycle import TRANSIENT
from ..sources.tables import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATE = "10 seconds"
_STATE = StructType([StructField("status", StringType()), StructField("retry_count", IntegerType()), StructField("seq", LongType()), StructField("due_ms", LongType())])


def wait_seconds(retry_count: int) -> int:
    """1 s after the first attempt, 5 s after later ones."""
    return 1 if retry_count <= 1 else 5


def after(status: str, retry_count: int, kind: str, code: str | None, limit: int) -> tuple[str, int]:
    """The state of a task after one event."""
    if kind == "claim" and status in ("queued", "retrying"):
        return "running", retry_count + 1
    if status != "running":
        return status, retry_count
    if kind == "success":
        return "succeeded", retry_count
    if kind == "failure":
        return ("retrying" if code in TRANSIENT and retry_count < limit else "failed"), retry_count
    if kind == "interrupt":
        return ("retrying" if retry_count + 1 < limit else "failed"), retry_count + 1
    return status, retry_count


class TaskStates(StatefulProcessor):
    """One row for each task and micro-batch that changes it, and one when its retry is due."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, retries, seen, due = self.state.get() if self.state.exists() else ("queued", 0, -1, 0)
        # One task's events of one micro-batch; those that were overtaken by later ones are passed over.
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        was_due = due
        for e in events.itertuples(index=False):
            if e.seq <= seen:
                continue
            status, retries = after(status, retries, e.kind, e.code, self.limit)
            seen = e.seq
            due = int(e.ts.timestamp() * 1000) + 1000 * wait_seconds(retries) if status == "retrying" else 0
        if was_due and was_due != due:
            self.handle.deleteTimer(was_due)
        if due and due != was_due:
            self.handle.registerTimer(due)
        self.state.update((status, retries, int(seen), due))
        yield self._row(key, status, retries, seen, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, retries, seen, _ = self.state.get()
        self.state.update((status, retries, seen, 0))
        yield self._row(key, status, retries, seen, True)

    @staticmethod
    def _row(key, status: str, retries: int, seen: int, due: bool) -> pd.DataFrame:
        wait = wait_seconds(retries) if status == "retrying" else 0
        return pd.DataFrame({"task_id": [key[0]], "status": [status], "retry_count": [retries], "wait_s": [wait], "seq": [int(seen)], "due": [due]})


def task_states(events: DataFrame, limit: int = 3) -> DataFrame:
    """The stream of (task_id, status, retry_count, wait_s, seq, due) of a stream of events (task_id, seq, ts, kind, code).

    ``seq`` is the number of the last event of the task; a task's latest state is the row of its largest ``seq``. An event that comes in
    a later micro-batch than one of a larger ``seq`` of its task changes nothing.
    """
    schema = "task_id long, status string, retry_count int, wait_s int, seq long, due boolean"
    stream = events.withWatermark("ts", LATE).select("task_id", "seq", "ts", "kind", "code")
    return stream.groupBy("task_id").transformWithStateInPandas(TaskStates(limit), schema, outputMode="append", timeMode="eventTime")


def run_states(events: DataFrame, path: str | None = None, limit: int = 3) -> DataFrame:
    """Runs the stream over what is there and returns all rows so far; with the ``path`` of an earlier run it goes on from there."""
    spark = events.sparkSession
    path = path or shared_folder(spark, "tasks")
    states, before = task_states(events, limit), spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        run = states.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(states.schema).parquet(f"{path}/rows")


def latest_states(rows: DataFrame) -> DataFrame:
    """(task_id, status, retry_count, wait_s): each task's last state."""
    last = F.max_by(F.struct("status", "retry_count", "wait_s"), F.struct("seq", "due"))
    return rows.groupBy("task_id").agg(last.alias("s")).select("task_id", "s.*")
