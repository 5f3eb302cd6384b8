"""Queries over versions, tasks, audit feeds, conversations and constraints."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..sources.tables import table
from .registry import query

_LAST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k"


@query(f"SELECT o_custkey AS resource, o_orderkey AS version, o_orderstatus AS status FROM (SELECT *, {_LAST} FROM orders) WHERE k = 1")
def latest_version(spark, sf):
    found = L.latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return found.select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_custkey AS resource, o_orderkey AS version FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def active_first_latest(spark, sf):
    found = L.latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F")
    return found.select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("version"))


@query(f"SELECT l_orderkey AS version, l_linenumber AS chunk FROM lineitem JOIN (SELECT o_orderkey, o_custkey FROM (SELECT *, {_LAST} FROM orders) WHERE k = 1 AND o_orderstatus != 'P') v ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 AND l_linestatus = 'O' AND c_mktsegment = 'BUILDING'")
def active_chunks(spark, sf):
    """Chunks of the current version, where version, resource and chunk are active and the resource is in the base."""
    current = L.latest(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).where("o_orderstatus != 'P'").select("o_custkey", "o_orderkey")
    resources = table(spark, sf, "customer").where("c_acctbal > 0 and c_mktsegment = 'BUILDING'").select("c_custkey")
    chunks = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber")
    found = chunks.join(current, F.col("l_orderkey") == F.col("o_orderkey")).join(resources, F.col("o_custkey") == F.col("c_custkey"))
    return found.select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("chunk"))


_KINDS = ["click", "view", "signup", "purchase", "error"]
_COUNTS = "SELECT user_id AS run, count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY user_id"


@query(_COUNTS)
def progress_counts(spark, sf):
    return L.status_counts(table(spark, sf, "events").withColumnRenamed("user_id", "run"), ["run"], "event_type", _KINDS)


@query(f"""WITH c AS ({_COUNTS}) SELECT run, CAST(floor(purchase * 100 / total) AS INTEGER) AS percent, CASE WHEN run % 11 = 0 THEN 'superseded' WHEN run % 11 = 1 THEN 'failed' WHEN run % 13 = 0 THEN 'disabled'
  WHEN run % 11 = 2 THEN 'pending' WHEN run % 11 = 3 THEN 'processing' WHEN signup > 40 THEN 'running' WHEN total > 0 AND purchase = total THEN 'completed'
  WHEN greatest(error - 20, 0) + greatest(view - 20, 0) > 0 THEN CASE WHEN purchase > 0 THEN 'degraded' ELSE 'failed' END WHEN click > 0 THEN CASE WHEN purchase > 0 THEN 'degraded' ELSE 'cancelled' END ELSE 'integrity_warning' END AS status FROM c""")
def progress_status(spark, sf):
    c = L.status_counts(table(spark, sf, "events").withColumnRenamed("user_id", "run"), ["run"], "event_type", _KINDS)
    over = lambda name, least: F.greatest(F.col(name) - least, F.lit(0))
    run = F.get(F.array(*map(F.lit, ["superseded", "failed", "pending", "processing"])), (F.col("run") % 11).cast("int"))
    status = L.run_status(F.coalesce(run, F.lit("indexed")), F.col("run") % 13 != 0, F.col("total"), F.col("purchase"), over("signup", 40), over("error", 20), F.col("click"), over("view", 20))
    return c.select("run", L.progress_percent(F.col("purchase"), F.col("total")).alias("percent"), status.alias("status"))


@query("SELECT 'E' || CAST(event_id % 9 AS VARCHAR) AS code, event_type AS provider, 'm' || CAST(user_id % 4 AS VARCHAR) AS model, count(*) AS n FROM events WHERE event_type != 'view' GROUP BY ALL")
def error_groups(spark, sf):
    code = F.concat(F.lit("E"), (F.col("event_id") % 9).cast("string"))
    return table(spark, sf, "events").where("event_type != 'view'").groupBy(code.alias("code"), F.col("event_type").alias("provider"), F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("model")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "code", "provider", "model")


_TASK = ["queued", "running", "retrying", "succeeded", "failed"]


@query("""WITH t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'retrying' WHEN 3 THEN 'succeeded' WHEN 4 THEN 'failed' END AS task, CASE event_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'failed' END AS embedding, event_id % 2 = 1 AS stopped, event_id % 5 != 0 AS fits FROM events)
SELECT event_id, CASE WHEN task IN ('queued', 'running', 'retrying') THEN task WHEN embedding = 'ready' AND fits THEN 'ready' WHEN task = 'failed' OR embedding = 'failed' THEN CASE WHEN stopped THEN 'cancelled' ELSE 'failed' END ELSE 'missing' END AS status FROM t""")
def item_status(spark, sf):
    e = F.col("event_id")
    task = F.get(F.array(*map(F.lit, _TASK)), (e % 7).cast("int"))
    embedding = F.when(e % 3 == 0, "ready").when(e % 3 == 1, "failed")
    error = F.when(e % 2 == 1, "TASK_CANCELLED").otherwise("OTHER")
    return table(spark, sf, "events").select("event_id", L.item_status(task, embedding, error, e % 5 != 0).alias("status"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT event_id FROM events WHERE event_type = 'signup')")
def pending_work(spark, sf):
    """Documents without a stored vector and without an active task."""
    docs = table(spark, sf, "documents").select("doc_id")
    ready = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    active = table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("doc_id"))
    return docs.join(ready, "doc_id", "left_anti").join(active, "doc_id", "left_anti")


_RUNS = "SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'indexed' ELSE 'failed' END AS status, k = 1 AS is_current, c_acctbal < 0 AS archived, o_orderdate AS updated FROM (SELECT *, " + _LAST + " FROM orders) JOIN customer ON o_custkey = c_custkey"
_CUTOFF = "1997-06-01"
_GONE = f"runs AS ({_RUNS}), gone AS (SELECT run_id, status, archived FROM runs WHERE updated < TIMESTAMP '{_CUTOFF}' AND (status = 'superseded' OR (NOT is_current AND status IN ('indexed', 'superseded')) OR (archived AND status IN ('indexed', 'superseded'))) AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))"


def _gone(spark, sf, keep_active: bool = True):
    orders = table(spark, sf, "orders")
    current = L.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.lit(True).alias("cur"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") < 0).alias("archived"))
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "indexed").otherwise("failed")
    runs = orders.join(current, "o_orderkey", "left").join(customers, "o_custkey").select(F.col("o_orderkey").alias("run_id"), status.alias("status"), F.coalesce("cur", F.lit(False)).alias("is_current"), "archived", F.col("o_orderdate").alias("updated"))
    active = table(spark, sf, "lineitem").where("l_returnflag = 'R'").where(F.lit(keep_active)).select(F.col("l_orderkey").alias("run_id"))
    return L.retention_candidates(runs, _CUTOFF, active)


@query(f"WITH {_GONE} SELECT run_id FROM gone")
def retention_candidates(spark, sf):
    return _gone(spark, sf).select("run_id")


@query(f"WITH {_GONE} SELECT count(*) AS runs, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (archived) AS archived FROM gone")
def retention_counts(spark, sf):
    c = F.col("status")
    return _gone(spark, sf).agg(F.count("*").alias("runs"), F.count_if(c == "superseded").alias("superseded"), F.count_if(c == "indexed").alias("indexed"), F.count_if("archived").alias("archived"))


@query(f"WITH {_GONE} SELECT count(*) AS kept FROM runs WHERE run_id NOT IN (SELECT run_id FROM gone)")
def retention_execute(spark, sf):
    """How many runs a snapshot without the candidates keeps."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id")).join(_gone(spark, sf), "run_id", "left_anti").agg(F.count("*").alias("kept"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'auto' END, CASE n_regionkey WHEN 0 THEN 'off' ELSE 'suggest' END) AS mode FROM customer JOIN nation ON c_nationkey = n_nationkey")
def effective_mode(spark, sf):
    """The resource's own mode, else its base's."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 0, "off").otherwise("suggest").alias("base"))
    own = F.when(F.col("c_custkey") % 3 == 0, "auto")
    return table(spark, sf, "customer").join(nations, "c_nationkey").select("c_custkey", F.coalesce(own, "base").alias("mode"))


_LATEST2 = f"SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, {_LAST} FROM orders) WHERE k = 1"
_CURRENT2 = "SELECT o_custkey, max(o_orderkey) AS cur FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey"


@query(f"SELECT c_custkey, CASE WHEN cur IS NOT NULL AND o_orderstatus = 'P' THEN 'degraded' WHEN cur IS NOT NULL THEN 'indexed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'pending' END AS status FROM customer LEFT JOIN ({_LATEST2}) l ON l.o_custkey = c_custkey LEFT JOIN ({_CURRENT2}) c ON c.o_custkey = c_custkey")
def resource_status(spark, sf):
    """indexed with a current version, degraded if the latest failed on top of it, else failed or pending."""
    orders = table(spark, sf, "orders")
    last = L.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    current = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("cur"))
    failed = F.coalesce(F.col("o_orderstatus") == "P", F.lit(False))
    status = F.when(F.col("cur").isNotNull() & failed, "degraded").when(F.col("cur").isNotNull(), "indexed").when(failed, "failed").otherwise("pending")
    return table(spark, sf, "customer").select("c_custkey").join(last, "c_custkey", "left").join(current, "c_custkey", "left").select("c_custkey", status.alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'indexed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'pending' END AS status FROM orders")
def conditional_status(spark, sf):
    orders = table(spark, sf, "orders")
    active = orders.where("o_orderstatus = 'F'").select("o_custkey", F.lit(True).alias("active")).distinct()
    status = F.when(F.col("active"), "indexed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return orders.join(active, "o_custkey", "left").select("o_orderkey", status.alias("status"))


@query(f"SELECT l.o_custkey AS resource, l.o_orderkey AS latest, cur AS current, l.o_orderkey = cur AS is_current FROM ({_LATEST2}) l JOIN ({_CURRENT2}) c USING (o_custkey)")
def latest_vs_current(spark, sf):
    orders = table(spark, sf, "orders")
    last = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    current = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("current"))
    return last.join(current, "o_custkey").select(F.col("o_custkey").alias("resource"), "latest", "current", (F.col("latest") == F.col("current")).alias("is_current"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def first_per_resource(spark, sf):
    return L.latest(table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def orphan_rows(spark, sf):
    keep = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey").join(keep, "l_orderkey", "left_anti").agg(F.count("*").alias("orphans"))


@query("SELECT user_id, event_type, count(*) AS requests, count(DISTINCT sha256(props)) > 1 AS conflict FROM events GROUP BY ALL")
def idempotency_conflicts(spark, sf):
    """Requests per key; different fingerprints under one key are a conflict."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("requests"), (F.countDistinct(F.sha2("props", 256)) > 1).alias("conflict"))


@query("""WITH c AS (SELECT vec_id AS k, CASE WHEN vec_id % 4 = 0 THEN 'failed' ELSE 'ready' END AS status, label AS value, 'old' AS error FROM embeddings WHERE vec_id % 3 > 0),
i AS (SELECT vec_id AS k, CASE WHEN vec_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, label + 100 AS value, 'new' AS error FROM embeddings WHERE vec_id % 2 = 0)
SELECT k, CASE WHEN i.status = 'ready' OR c.status IS NULL THEN i.status ELSE c.status END AS status, CAST(CASE WHEN i.status = 'ready' OR c.status IS NULL THEN i.value ELSE c.value END AS INTEGER) AS value, CASE WHEN i.status IS NOT NULL THEN i.error ELSE c.error END AS error FROM c FULL JOIN i USING (k)""")
def asymmetric_upsert(spark, sf):
    v = table(spark, sf, "embeddings")
    side = lambda keep, every, plus, error: v.where(keep).select(F.col("vec_id").alias("k"), F.when(F.col("vec_id") % every == 0, "failed").otherwise("ready").alias("status"), (F.col("label") + plus).cast("int").alias("value"), F.lit(error).alias("error"))
    return L.asymmetric_upsert(side("vec_id % 3 > 0", 4, 0, "old"), side("vec_id % 2 = 0", 5, 100, "new"), ["k"])


@query("SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey UNION ALL SELECT c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_acctbal > 0")
def insert_ignore(spark, sf):
    current = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("v"))
    incoming = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("long").alias("v"))
    return L.insert_ignore(current, incoming, ["k"], ["v"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (7 - l_linenumber) // 3, CASE WHEN l_linenumber % 3 = 1 THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS sequence FROM lineitem""")
def sequence_numbers(spark, sf):
    """Numbers without a gap over the chunks of each run: by parent, and a parent before its children."""
    line = F.col("l_linenumber")
    parent, child = F.floor((F.lit(7) - line) / 3), F.when(line % 3 == 1, 0).otherwise(1)
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy(parent, child, "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", place.alias("sequence"))


@query("SELECT p_partkey, p_name FROM part ORDER BY CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#22' THEN 1 ELSE 2 END, p_name, p_partkey LIMIT 25 OFFSET 50")
def case_sort_page(spark, sf):
    """One page of a listing: index first, log second, then by title."""
    rank = F.when(F.col("p_brand") == "Brand#11", 0).when(F.col("p_brand") == "Brand#22", 1).otherwise(2)
    return table(spark, sf, "part").orderBy(rank, "p_name", "p_partkey").offset(50).limit(25).select("p_partkey", "p_name")


@query("""SELECT page, count(*) FILTER (source = 'resource') AS citations, count(*) FILTER (source = 'page') AS page_citations, count(*) AS total, count(*) FILTER (bal < 500) AS pending
FROM (SELECT s_nationkey AS page, 'resource' AS source, s_acctbal AS bal FROM supplier UNION ALL SELECT c_nationkey, 'page', c_acctbal FROM customer) GROUP BY page""")
def citation_counts(spark, sf):
    """Citations of each page from both tables: by source, in all, and those that are broken or wait for a review."""
    state = lambda c: F.when(F.col(c) < 0, "broken").when(F.col(c) < 500, "needs_review").otherwise("active").alias("status")
    both = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("page"), F.lit("resource").alias("source"), state("s_acctbal")).unionByName(table(spark, sf, "customer").select(F.col("c_nationkey").alias("page"), F.lit("page").alias("source"), state("c_acctbal")))
    pending = F.col("status").isin("needs_review", "broken")
    return both.groupBy("page").agg(F.count_if(F.col("source") == "resource").alias("citations"), F.count_if(F.col("source") == "page").alias("page_citations"), F.count("*").alias("total"), F.count_if(pending).alias("pending"))


@query("SELECT 'resource' AS source, s_suppkey AS id, s_nationkey AS target FROM supplier UNION ALL SELECT 'page', c_custkey, c_nationkey FROM customer")
def tagged_citation_union(spark, sf):
    one = table(spark, sf, "supplier").select(F.lit("resource").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("target"))
    return one.unionByName(table(spark, sf, "customer").select(F.lit("page").alias("source"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("target")))


@query("SELECT o_custkey AS plan, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_and(o_orderstatus = 'F') THEN 'applied' WHEN bool_or(o_orderstatus = 'F') THEN 'partially_applied' ELSE 'ready' END AS status FROM orders GROUP BY o_custkey")
def plan_status(spark, sf):
    s = F.col("o_orderstatus")
    status = F.when(F.bool_or(s == "P"), "failed").when(F.bool_and(s == "F"), "applied").when(F.bool_or(s == "F"), "partially_applied").otherwise("ready")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(status.alias("status"))


@query(f"SELECT o.o_orderkey AS change FROM orders o JOIN ({_LATEST2}) l USING (o_custkey) WHERE o.o_orderkey != l.o_orderkey AND o.o_orderpriority = '1-URGENT'")
def stale_base_versions(spark, sf):
    """Proposed changes whose base is no longer the current version."""
    orders = table(spark, sf, "orders")
    current = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("cur"))
    return orders.where("o_orderpriority = '1-URGENT'").join(current, "o_custkey").where("o_orderkey != cur").select(F.col("o_orderkey").alias("change"))


@query("SELECT user_id, count(DISTINCT event_type || CAST(value > 50 AS VARCHAR)) AS variants, count(*) AS writes FROM events GROUP BY user_id")
def finalized_snapshot(spark, sf):
    """Snapshots written once: how many differ when their time is left out."""
    content = F.struct("event_type", F.col("value") > 50)
    return table(spark, sf, "events").groupBy("user_id").agg(F.countDistinct(content).alias("variants"), F.count("*").alias("writes"))


_EVENTS = """e AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'interrupt' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'TRANSIENT_ERROR' ELSE 'FATAL' END AS code FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS k FROM e)"""


def task_events(events):
    """Task events (task_id, seq, ts, kind, code) made of the event feed."""
    t = F.col("event_type")
    kind = F.when(t.isin("click", "view"), "claim").when(t == "purchase", "success").when(t == "error", "failure").otherwise("interrupt")
    code = F.when(F.col("event_id") % 2 == 0, "TRANSIENT_ERROR").otherwise("FATAL")
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "ts", kind.alias("kind"), code.alias("code"))


TASK_STATE_SQL = f"""WITH RECURSIVE {_EVENTS}, f AS (SELECT task_id, CAST(0 AS BIGINT) AS k, 'queued' AS status, 0 AS retry_count FROM (SELECT DISTINCT task_id FROM e)
UNION ALL SELECT f.task_id, o.k, CASE WHEN kind = 'claim' AND status IN ('queued', 'retrying') THEN 'running' WHEN kind = 'success' AND status = 'running' THEN 'succeeded'
 WHEN kind = 'failure' AND status = 'running' THEN CASE WHEN code = 'TRANSIENT_ERROR' AND retry_count < 3 THEN 'retrying' ELSE 'failed' END
 WHEN kind = 'interrupt' AND status = 'running' THEN CASE WHEN retry_count + 1 < 3 THEN 'retrying' ELSE 'failed' END ELSE status END,
 retry_count + CASE WHEN (kind = 'claim' AND status IN ('queued', 'retrying')) OR (kind = 'interrupt' AND status = 'running') THEN 1 ELSE 0 END
 FROM f JOIN o ON o.task_id = f.task_id AND o.k = f.k + 1)
SELECT task_id, status, retry_count, CASE WHEN status = 'retrying' THEN CASE WHEN retry_count <= 1 THEN 1 ELSE 5 END ELSE 0 END AS wait_s FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY k DESC) AS last FROM f) WHERE last = 1"""


@query(TASK_STATE_SQL)
def task_state_fold(spark, sf):
    return L.fold_tasks(task_events(table(spark, sf, "events")))


_EARLY = TASK_STATE_SQL.replace("FROM events)", "FROM events WHERE event_id % 13 < 4)")


@query(f"SELECT task_id, CASE WHEN status = 'running' THEN CASE WHEN retry_count + 1 < 3 THEN 'retrying' ELSE 'failed' END ELSE status END AS status, retry_count + CASE WHEN status = 'running' THEN 1 ELSE 0 END AS retry_count FROM ({_EARLY})")
def interrupted_recovery(spark, sf):
    """Tasks that are found running at a start were interrupted: one more attempt counts, and they are retried or have failed."""
    states = L.fold_tasks(task_events(table(spark, sf, "events").where("event_id % 13 < 4")))
    return L.recovered(states).select("task_id", "status", "retry_count")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND value > 20 AND user_id < 500")
def dynamic_filters(spark, sf):
    """Only the given criteria take part."""
    given = {"event_type": ("=", "click"), "value": (">", 20), "user_id": ("<", 500), "props": None}
    rows = table(spark, sf, "events")
    for name, wanted in given.items():
        if wanted:
            op, v = wanted
            c = F.col(name)
            rows = rows.where(c == v if op == "=" else c > v if op == ">" else c < v)
    return rows.select("event_id")


@query("""WITH scope AS (SELECT 'user' AS kind, user_id AS id FROM events WHERE event_type = 'signup' UNION SELECT 'doc', doc_id FROM documents WHERE lang = 'de')
SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'doc' END AS kind, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id % 1000 END AS id, event_type FROM events) a SEMI JOIN scope s ON a.kind = s.kind AND a.id = s.id WHERE event_type != 'error'""")
def audit_scope_feed(spark, sf):
    """Events of entities in scope: one set of (kind, id) from all branches, one semi join."""
    events = table(spark, sf, "events")
    scope = events.where("event_type = 'signup'").select(F.lit("user").alias("kind"), F.col("user_id").alias("id")).unionByName(table(spark, sf, "documents").where("lang = 'de'").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"))).distinct()
    even = F.col("event_id") % 2 == 0
    feed = events.where("event_type != 'error'").select("event_id", F.when(even, "user").otherwise("doc").alias("kind"), F.when(even, F.col("user_id")).otherwise(F.col("event_id") % 1000).alias("id"))
    return feed.join(scope, ["kind", "id"], "left_semi").select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.' || (json_keys(props))[1]) AS first FROM events WHERE len(json_keys(props)) > 0")
def audit_json_filter(spark, sf):
    keys = F.json_object_keys("props")
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").where(F.size(keys) > 0).select("event_id", F.element_at(parsed, F.get(keys, 0)).alias("first"))


@query("SELECT event_id, (SELECT count(*) FROM events) AS total, CAST(ceil((SELECT count(*) FROM events) / 50.0) AS BIGINT) AS pages FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def paged_feed(spark, sf):
    events = table(spark, sf, "events")
    n = events.count()
    page = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(100).limit(50)
    return page.select("event_id", F.lit(n).cast("long").alias("total"), F.lit(-(-n // 50)).cast("long").alias("pages"))


@query("SELECT event_id, event_type FROM events ORDER BY value DESC, event_id LIMIT 50")
def top_events(spark, sf):
    return table(spark, sf, "events").orderBy(F.col("value").desc(), "event_id").limit(50).select("event_id", "event_type")


@query("SELECT c.conv_id, CAST(coalesce(max(turn), -1) + 1 AS BIGINT) AS next FROM conversations c GROUP BY c.conv_id")
def next_sequence(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(-1)) + 1).cast("long").alias("next"))


def _history(newest: bool):
    def builder(spark, sf):
        order = F.col("turn").desc() if newest else F.col("turn")
        c = table(spark, sf, "conversations").withColumn("k", F.row_number().over(W.partitionBy("conv_id").orderBy(order)))
        return c.where("k <= 10").select("conv_id", "turn", "role").orderBy("conv_id", "turn")

    return builder


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 10")
def history_window(spark, sf):
    """The newest messages of each conversation, in order."""
    return _history(True)(spark, sf)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 10")
def oldest_history(spark, sf):
    return _history(False)(spark, sf)


@query("SELECT user_id, round(sum(coalesce(value, 0)), 4) AS cost, CAST(sum(event_id) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY user_id")
def usage_totals(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("cost"), F.sum("event_id").alias("tokens"), F.count("*").alias("calls"))


@query("SELECT event_type AS pool, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def fifo_claim(spark, sf):
    """The next runnable task of each pool."""
    found = table(spark, sf, "events").groupBy(F.col("event_type").alias("pool")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return found


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS events FROM conversations GROUP BY conv_id")
def ordered_run_events(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda e: e["role"]), ">").alias("events"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def v_unique(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de', 'fr')")
def v_enum(spark, sf):
    return table(spark, sf, "documents").where(~F.col("lang").isin("en", "de", "fr")).select("doc_id", "lang")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) < 100 OR length(text) > 5000 OR length(text) != n_chars")
def v_length(spark, sf):
    n = F.length("text")
    return table(spark, sf, "documents").where((n < 100) | (n > 5000) | (n != F.col("n_chars"))).select("doc_id", n.cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING')")
def v_fk(spark, sf):
    known = table(spark, sf, "customer").where("c_mktsegment != 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(known, "o_custkey", "left_anti").select("o_orderkey")


@query("SELECT o_custkey, count(*) AS active FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1")
def v_partial_unique(spark, sf):
    """At most one active row per owner."""
    return table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("active")).where("active > 1")


@query("""SELECT doc_id, rule FROM (SELECT doc_id, unnest([CASE WHEN trim(text) = '' THEN 'empty_content' END, CASE WHEN length(text) > 20000 THEN 'content_too_long' END, CASE WHEN doc_id IN (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) THEN 'duplicate_id' END, CASE WHEN n > 1 THEN 'duplicate_content' END]) AS rule
 FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents)) WHERE rule IS NOT NULL""")
def v_corpus(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), (F.trim("text") == "").alias("blank"), (F.length("text") > 20000).alias("long"))
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("ids"))
    same = docs.groupBy("h").agg(F.count("*").alias("copies"))
    rules = F.array_compact(F.array(F.when(F.col("blank"), "empty_content"), F.when(F.col("long"), "content_too_long"), F.when(F.col("ids") > 1, "duplicate_id"), F.when(F.col("copies") > 1, "duplicate_content")))
    return docs.join(ids, "doc_id").join(same, "h").select("doc_id", F.explode(rules).alias("rule"))


_BLOCK = 4096


@query(f"""WITH b AS (SELECT source, doc_id // {_BLOCK} AS block, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(h, '' ORDER BY block)) AS fingerprint FROM b GROUP BY source""")
def corpus_fingerprint(spark, sf):
    """Order-independent hash of a group's content, in two levels: of the hashes of each range of ids, and of the ranges' hashes."""
    in_order = lambda place, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, h))), lambda x: x["h"]), ""), 256)
    rows = table(spark, sf, "documents").select("source", F.floor(F.col("doc_id") / _BLOCK).alias("block"), "doc_id", F.sha2("text", 256).alias("h"))
    blocks = rows.groupBy("source", "block").agg(in_order("doc_id", "h").alias("h"))
    return blocks.groupBy("source").agg(in_order("block", "h").alias("fingerprint"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS parts FROM conversations GROUP BY conv_id")
def output_digest(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["text"]), "\n"), 256).alias("digest"), F.count("*").alias("parts"))
