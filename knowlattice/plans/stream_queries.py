"""Streaming queries, each held against the batch form of what the watermark lets out."""

from __future__ import annotations

from ..streaming import events as S
from ..streaming import tasks as T
from .lifecycle_queries import TASK_STATE_SQL, task_events
from .registry import query

_OUT = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _windows(width: str, slide: str, steps: int) -> str:
    start = f"time_bucket(INTERVAL {slide}, ts) - i * INTERVAL {slide}"
    return f"""SELECT start, start + INTERVAL {width} AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT {start} AS start, event_type, value FROM events, range({steps}) r(i)) WHERE start + INTERVAL {width} <= {_OUT} GROUP BY start, event_type"""


@query(_windows("1 HOUR", "1 HOUR", 1))
def stream_tumbling(spark, sf):
    return S.drained(S.tumbling(S.events(spark, sf)), "tumbling")


@query(_windows("1 HOUR", "15 MINUTE", 4))
def stream_sliding(spark, sf):
    return S.drained(S.sliding(S.events(spark, sf)), "sliding")


@query(f"""WITH b AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= {_OUT}""")
def stream_session(spark, sf):
    return S.drained(S.sessions(S.events(spark, sf)), "sessions")


@query("SELECT DISTINCT event_id, ts FROM events")
def stream_dedup(spark, sf):
    return S.drained(S.once(S.events(spark, sf)), "once")


@query(TASK_STATE_SQL)
def stream_task_states(spark, sf):
    """The task states of the batch fold, from a stream whose state is kept between micro-batches."""
    return T.latest_states(T.run_states(task_events(S.unmarked(spark, sf))))
