"""Streamed task states against the batch fold: in one run, over several files, and after a restart in the middle."""

import random

import pytest
from pyspark.sql import functions as F

from knowlattice.operators import lifecycle as L
from knowlattice.streaming import tasks as T

SCHEMA = "task_id long, seq long, ts timestamp, kind string, code string"


def some_events(spark, n=400):
    draw = random.Random(6)
    rows = [(draw.randrange(25), k, k, draw.choice(["claim", "claim", "success", "failure", "interrupt"]), draw.choice(["TRANSIENT_ERROR", "FATAL", None])) for k in range(n)]
    return spark.createDataFrame(rows, "task_id long, seq long, s int, kind string, code string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).select("task_id", "seq", "ts", "kind", "code")


def states(df):
    return sorted((r.task_id, r.status, r.retry_count, r.wait_s) for r in df.collect())


def test_restart_in_the_middle(spark, tmp_path):
    events = some_events(spark).cache()
    files = f"{tmp_path}/events"
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
    for first in (0, 150):
        events.where((F.col("seq") >= first) & (F.col("seq") < first + 150)).coalesce(1).write.mode("append").parquet(files)
    rows = T.run_states(stream(), str(tmp_path))
    assert states(T.latest_states(rows)) == states(L.fold_tasks(events.where("seq < 300")))
    events.where("seq >= 300").coalesce(1).write.mode("append").parquet(files)
    rows = T.run_states(stream(), str(tmp_path))
    assert states(T.latest_states(rows)) == states(L.fold_tasks(events))
    due = rows.where("due")
    assert due.count() > 0 and due.where("status != 'retrying' or wait_s not in (1, 5)").count() == 0
    # A timer is met only where the stream's time has passed it, and once for each wait.
    assert due.groupBy("task_id", "seq").count().where("count > 1").count() == 0


def test_late_events_change_nothing(spark, tmp_path):
    rows = [(1, 5, 50, "claim", None), (1, 6, 60, "success", None)]
    late = [(1, 2, 20, "failure", "FATAL"), (2, 1, 70, "claim", None)]
    files = f"{tmp_path}/events"
    frame = lambda r: spark.createDataFrame(r, "task_id long, seq long, s int, kind string, code string").withColumn("ts", F.timestamp_seconds("s")).select("task_id", "seq", "ts", "kind", "code")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(files)
    frame(rows).coalesce(1).write.parquet(files)
    T.run_states(stream(), str(tmp_path))
    frame(late).coalesce(1).write.mode("append").parquet(files)
    assert states(T.latest_states(T.run_states(stream(), str(tmp_path)))) == [(1, "succeeded", 1, 0), (2, "running", 1, 0)]


@pytest.mark.parametrize("event, wanted", [(("queued", 0, "claim", None), ("running", 1)), (("running", 1, "failure", "TRANSIENT_ERROR"), ("retrying", 1)), (("running", 3, "failure", "TRANSIENT_ERROR"), ("failed", 3)), (("running", 1, "failure", None), ("failed", 1)), (("running", 1, "interrupt", None), ("retrying", 2)), (("running", 2, "interrupt", None), ("failed", 3)), (("succeeded", 1, "claim", None), ("succeeded", 1))])
def test_rules(event, wanted):
    assert T.after(*event, 3) == wanted and T.wait_seconds(1) == 1 and T.wait_seconds(2) == 5
