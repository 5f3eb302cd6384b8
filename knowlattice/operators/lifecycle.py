"""Versions, runs, tasks: latest rows, progress, retention, state folds, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str], first: Column | None = None) -> DataFrame:
    """The row of each key that comes last by ``order``; rows where ``first`` holds go before all others.

    Taken by ``max_by`` with map-side partial results, so that a key with many versions is no hot window.
    """
    rank = F.struct(*([F.coalesce(first, F.lit(False)).alias("_first")] if first is not None else []), *order)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), rank).alias("_row")).select("_row.*")


def status_counts(rows: DataFrame, keys: Sequence[str], status: str, values: Sequence[str]) -> DataFrame:
    """Per key the number of rows, and of those in each status."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def progress_percent(ready: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(ready * 100 / total)).otherwise(0).cast("int")


def run_status(run: Column, enabled: Column, total: Column, ready: Column, pending: Column, failed: Column, cancelled: Column, missing: Column) -> Column:
    """One status for a run from its own and its items' counts, the first that applies."""
    part = F.when(ready > 0, "degraded")
    return (
        F.when(run.isin("superseded", "failed"), run)
        .when(~enabled, "disabled")
        .when(run.isin("pending", "processing"), run)
        .when(pending > 0, "running")
        .when((total > 0) & (ready == total), "completed")
        .when(failed + missing > 0, part.otherwise("failed"))
        .when(cancelled > 0, part.otherwise("cancelled"))
        .otherwise("integrity_warning")
    )


def item_status(task: Column, embedding: Column, error: Column, right_size: Column) -> Column:
    """An active task's status, else ready, else how the task or the embedding failed (by the task's error code), else missing."""
    bad = F.coalesce(task == "failed", F.lit(False)) | F.coalesce(embedding == "failed", F.lit(False))
    return (
        F.when(task.isin("queued", "running", "retrying"), task)
        .when((embedding == "ready") & right_size, "ready")
        .when(bad & (error == "TASK_CANCELLED"), "cancelled")
        .when(bad, "failed")
        .otherwise("missing")
    )


def asymmetric_upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, status, value, error): an incoming row replaces the current one if it is ready; a failure only leaves its error."""
    both = current.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in ("status", "value", "error")]).join(incoming, [*keys], "full_outer")
    wins = (F.col("status") == "ready") | F.col("_old_status").isNull()
    pick = lambda c: F.when(F.coalesce(wins, F.lit(False)), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c)
    return both.select(*keys, pick("status"), pick("value"), F.when(F.col("status").isNotNull(), F.col("error")).otherwise(F.col("_old_error")).alias("error"))


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The current rows and, of the incoming ones, the first of each key that is not there yet."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    fresh = incoming.join(current.select(*keys), [*keys], "left_anti").withColumn("_place", place).where("_place = 1").drop("_place")
    return current.unionByName(fresh)


def retention_candidates(runs: DataFrame, cutoff: str, active_tasks: DataFrame) -> DataFrame:
    """Runs (run_id, status, is_current, archived, updated) that may go: old, and superseded, not current or archived, without an active task."""
    old = F.col("updated") < F.lit(cutoff).cast("timestamp")
    rule = (F.col("status") == "superseded") | (~F.col("is_current") & F.col("status").isin("indexed", "superseded")) | (F.col("archived") & F.col("status").isin("indexed", "superseded"))
    return runs.where(old & rule).join(active_tasks.select("run_id"), "run_id", "left_anti")


def with_active_parent(rows: DataFrame, key: str, parent: str, active: Column, keep: Sequence[str]) -> DataFrame:
    """Each row with its parent's ``keep`` columns (parent_...), null where it has none that is ``active``."""
    parents = rows.where(active).select(F.col(key).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in keep])
    return rows.join(parents, parent, "left")


# Page types that are made by the system.
SYSTEM_PAGES = ["index", "log"]


def active_pages(pages: DataFrame, base: object = None, space: object = None) -> DataFrame:
    """Pages (status, page_type, base, space, version, current_version) that are active, not the system's, in their current version, and in the base and space if these are given."""
    found = pages.where((F.col("status") == "active") & ~F.col("page_type").isin(*SYSTEM_PAGES) & (F.col("version") == F.col("current_version")))
    found = found if base is None else found.where(F.col("base") == F.lit(base))
    return found if space is None else found.where(F.col("space") == F.lit(space))


def in_base(pages: DataFrame, chunks: DataFrame, base: object, space: object = None) -> DataFrame:
    """(channel, id): active pages of the base, and of the space if one is given, and all chunks of the base: a space never narrows these."""
    wiki = active_pages(pages, base, space).select(F.lit("wiki").alias("channel"), F.col("page_id").alias("id"))
    return wiki.unionByName(chunks.where(F.col("base") == F.lit(base)).select(F.lit("raw").alias("channel"), F.col("chunk_id").alias("id")))


def valid_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges (source, source_version, target) whose source is still in that version, and whose ends are active pages of one base."""
    ends = pages.where((F.col("status") == "active") & ~F.col("page_type").isin(*SYSTEM_PAGES))
    of = lambda name: ends.select(F.col("page_id").alias(name), F.col("current_version").alias(f"_{name}_version"), F.col("base").alias(f"_{name}_base"))
    met = edges.join(of("source"), "source").join(of("target"), "target")
    return met.where((F.col("source_version") == F.col("_source_version")) & (F.col("_source_base") == F.col("_target_base"))).select(*edges.columns)


def swap_generation(runs: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs (keys, run_id, status) after ``new`` (keys, run_id) became active: what was active before is superseded."""
    marked = runs.join(new.select(*keys, F.col("run_id").alias("_new")), [*keys], "left")
    status = F.when(F.col("run_id") == F.col("_new"), "active").when(F.col("_new").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_new")


def common_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """The source's rows in the target's columns: those it has are copied, the others null."""
    return source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in source.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema])


# Error codes after which a task is tried again.
TRANSIENT = ["TRANSIENT_ERROR", "SQLITE_BUSY", "WORKER_INTERRUPTED", "PROCESSING_TIMEOUT"]


def fold_tasks(events: DataFrame, limit: int = 3) -> DataFrame:
    """(task_id, status, retry_count, wait_s) after folding the events (task_id, seq, kind, code) in order of seq.

    claim: one more attempt; success and failure end it; a transient failure below the limit waits for a retry, 1 s
    after the first attempt and 5 s after later ones. Only a task's own events are gathered, as a sorted array.
    """
    ordered = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "code"))).alias("e"))
    start = F.struct(F.lit("queued").alias("status"), F.lit(0).alias("retry_count"), F.lit(0).alias("wait_s"))

    def step(s: Column, e: Column) -> Column:
        live = s["status"].isin("queued", "retrying")
        running = s["status"] == "running"
        again = e["code"].isin(*TRANSIENT) & (s["retry_count"] < limit)
        status = (
            F.when((e["kind"] == "claim") & live, "running")
            .when((e["kind"] == "success") & running, "succeeded")
            .when((e["kind"] == "failure") & running, F.when(again, "retrying").otherwise("failed"))
            .when((e["kind"] == "interrupt") & running, F.when(s["retry_count"] + 1 < limit, "retrying").otherwise("failed"))
            .otherwise(s["status"])
        )
        bump = ((e["kind"] == "claim") & live) | ((e["kind"] == "interrupt") & running)
        count = s["retry_count"] + bump.cast("int")
        wait = F.when(status == "retrying", F.when(count <= 1, 1).otherwise(5)).otherwise(0)
        return F.struct(status.alias("status"), count.alias("retry_count"), wait.alias("wait_s"))

    return ordered.select("task_id", F.aggregate("e", start, step).alias("s")).select("task_id", "s.*")


def recovered(states: DataFrame, limit: int = 3) -> DataFrame:
    """Task states (task_id, status, retry_count, wait_s) at a start: what was running counts one more attempt and is retried below the limit, else it has failed."""
    running, count = F.col("status") == "running", F.col("retry_count") + 1
    again = running & (count < limit)
    wait = F.when(again, F.when(count <= 1, 1).otherwise(5)).when(running, 0).otherwise(F.col("wait_s"))
    return states.withColumns({"status": F.when(again, "retrying").when(running, "failed").otherwise(F.col("status")), "retry_count": F.when(running, count).otherwise(F.col("retry_count")), "wait_s": wait})


def public(rows: DataFrame, *private: str) -> DataFrame:
    """Without columns that begin with an underscore, and those named."""
    return rows.select(*[c for c in rows.columns if not c.startswith("_") and c not in private])


def first_success(rows: DataFrame, candidates: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Each row with the result of the first candidate (name, text, error) that gives one: ``reader``, ``text``, and all ``attempts`` made until then.

    A candidate fails with an error, or without text; candidates behind the first success are not attempts. If none succeeds, reader and text are null.
    """
    ok = [F.coalesce((F.coalesce(text, F.lit("")) != "") & error.isNull(), F.lit(False)) for _, text, error in candidates]
    tried, attempts = F.lit(True), []
    for (name, _, error), good in zip(candidates, ok):
        attempts.append(F.when(tried, F.struct(F.lit(name).alias("reader"), good.alias("succeeded"), F.when(~good, F.coalesce(error, F.lit("EMPTY_RESULT"))).alias("error"))))
        tried = tried & ~good
    pick = lambda values: F.coalesce(*[F.when(good, v) for good, v in zip(ok, values)])
    return rows.withColumns({"reader": pick([F.lit(n) for n, _, _ in candidates]), "text": pick([t for _, t, _ in candidates]), "attempts": F.array_compact(F.array(*attempts))})


def written_once(writes: DataFrame, keys: Sequence[str], order: Sequence[str], ignore: Sequence[str]) -> DataFrame:
    """(keys, writes, conflicts): how many writes a snapshot had, and how many differ from the first in anything but ``ignore``."""
    content = F.struct(*[c for c in writes.columns if c not in (*keys, *order, *ignore)])
    first = writes.groupBy(*keys).agg(F.min_by(content, F.struct(*order)).alias("_first"))
    told = writes.withColumn("_content", content).join(first, [*keys])
    return told.groupBy(*keys).agg(F.count("*").alias("writes"), F.count_if(~F.col("_content").eqNullSafe(F.col("_first"))).alias("conflicts"))
