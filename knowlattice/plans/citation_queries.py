"""Queries over citations, plans and the retention of what was derived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import citations as C
from ..sources.tables import table
from .lifecycle_queries import _CUTOFF, _GONE, _gone
from .registry import query

_REASON = """CASE WHEN k % 17 = 0 THEN 'version_missing' WHEN k % 13 = 0 THEN 'storage_missing' WHEN k % 11 = 0 THEN 'integrity_failed' WHEN l = 1 AND k > 1000 THEN 'locator:beyond_source' WHEN l = 2 AND k % 4 = 1 THEN 'locator:beyond_pages'
WHEN l IN (1, 4) AND k % 2 = 0 AND k % 3 != 0 THEN 'canonical_missing' WHEN l = 2 AND k % 4 = 0 THEN 'page_count_unavailable' WHEN l = 3 AND k % 5 = 0 THEN 'chunk_missing' WHEN l >= 5 AND l_orderkey % 2 = 1 THEN 'block_missing' END"""


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber AS l, l_partkey AS k FROM lineitem), r AS (SELECT *, {_REASON} AS reason FROM c)
SELECT l_orderkey, l AS l_linenumber, CASE WHEN reason IS NOT NULL THEN 'broken' WHEN k % 7 = 0 THEN 'needs_review' ELSE 'active' END AS status, coalesce(reason, CASE WHEN k % 7 = 0 THEN 'newer_version' END) AS reason FROM r""")
def citation_states(spark, sf):
    """Each citation's state, with a planted fault of every kind: versions, files, locators, pages, chunks, blocks, newer versions."""
    k, l = F.col("l_partkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    locator = (
        F.when(l == 1, F.concat(F.lit('{"startOffset": 0, "endOffset": '), text(k), F.lit("}"))).when(l == 2, F.lit('{"page": 2}')).when(l == 3, F.concat(F.lit('{"chunkId": "c'), text(k), F.lit('"}')))
        .when(l == 4, F.lit('{"startOffset": 0, "endOffset": 5}')).otherwise(F.lit('{"blockId": "b"}'))
    )
    cited = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", k.alias("version_id"), locator.alias("locator"), F.col("l_orderkey").alias("page_version_id"), F.when(l >= 5, "x").alias("block_key"))
    p = F.col("p_partkey")
    parts = table(spark, sf, "part").select("p_partkey")
    versions = parts.where(p % 17 != 0).select(
        p.alias("version_id"), p.alias("resource_id"), F.concat(F.lit("blobs/"), text(p)).alias("name"), F.lit(100).alias("size"), F.sha2(text(p), 256).alias("sha256"), F.when(p % 2 == 0, C.PDF).otherwise("text/plain").alias("mime"),
        F.lit(1000).alias("length"), F.nullif(p % 4, F.lit(0)).alias("page_count"), (p % 3 == 0).alias("canonical"),
    )
    files = parts.where(p % 13 != 0).select(F.concat(F.lit("blobs/"), text(p)).alias("name"), F.when(p % 22 == 0, 99).otherwise(100).alias("size"), F.sha2(F.when(p % 22 == 11, "other").otherwise(text(p)), 256).alias("sha256"))
    chunks = parts.where(p % 5 != 0).select(F.concat(F.lit("c"), text(p)).alias("chunk_id"), p.alias("version_id"))
    blocks = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("page_version_id"), F.lit("x").alias("block_key"))
    current = parts.select(p.alias("resource_id"), F.when(p % 7 == 0, p + 1).otherwise(p).alias("current_version_id"))
    return C.citation_states(cited, versions, files, chunks, blocks, current).select("l_orderkey", "l_linenumber", "status", "reason")


_ITEMS = """i AS (SELECT o_custkey AS plan_id, o_orderkey, ['warn', 'required', 'none'][CAST(o_custkey % 3 AS INTEGER) + 1] AS policy, CASE WHEN o_orderkey % 7 = 0 THEN 'tag_add' WHEN o_orderkey % 7 < 3 THEN 'page_create' ELSE 'page_update' END AS item_type,
CAST(o_orderkey % 3 AS INTEGER) AS valid, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS INTEGER) AS invalid FROM orders),
e AS (SELECT *, CASE WHEN policy != 'warn' AND invalid > 0 THEN 'error' WHEN item_type = 'tag_add' THEN 'not_applicable' WHEN policy = 'warn' AND (invalid > 0 OR valid = 0) THEN 'unverified' WHEN valid > 0 THEN 'used' ELSE 'needs_evidence' END AS evidence,
CASE WHEN policy = 'warn' THEN invalid + CASE WHEN item_type != 'tag_add' AND valid = 0 THEN 1 ELSE 0 END ELSE 0 END AS warnings FROM i)"""


def _items(spark, sf):
    o = F.col("o_orderkey")
    items = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("plan_id"), "o_orderkey", F.get(F.array(F.lit("warn"), F.lit("required"), F.lit("none")), (F.col("o_custkey") % 3).cast("int")).alias("policy"),
        F.when(o % 7 == 0, "tag_add").when(o % 7 < 3, "page_create").otherwise("page_update").alias("item_type"), (o % 3).cast("int").alias("valid"), F.when(o % 11 == 0, 2).otherwise(0).alias("invalid"),
    )
    given = [F.col(c) for c in ("policy", "item_type", "valid", "invalid")]
    return items.select("plan_id", "o_orderkey", C.evidence(*given).alias("evidence"), C.warnings(*given).alias("warnings"), C.risk(F.col("item_type")).alias("risk"))


@query(f"WITH {_ITEMS} SELECT o_orderkey, evidence, CAST(warnings AS INTEGER) AS warnings, CASE item_type WHEN 'tag_add' THEN 'low' WHEN 'page_create' THEN 'medium' ELSE 'high' END AS risk FROM e")
def plan_evidence(spark, sf):
    """Evidence, warnings and risk of each item of a plan."""
    return _items(spark, sf).drop("plan_id")


@query(f"WITH {_ITEMS} SELECT plan_id, count(*) AS items, CAST(sum(warnings) AS BIGINT) AS warnings, CASE WHEN bool_or(evidence = 'error') THEN 'error' WHEN bool_or(evidence = 'needs_evidence') THEN 'draft' WHEN sum(warnings) > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM e GROUP BY plan_id")
def plan_states(spark, sf):
    return C.plan_states(_items(spark, sf))


@query("""SELECT item_id, CASE WHEN item_id % 5 = 0 OR item_id % 5 = 1 THEN 'disabled' WHEN item_id % 5 = 2 THEN 'blocked' WHEN item_id % 5 = 3 THEN 'degraded' WHEN item_id % 2 = 0 THEN 'no_embeddings' ELSE 'used' END AS status FROM benchmark""")
def vector_status(spark, sf):
    """What searches say of their vectors."""
    k = F.col("item_id") % 5
    error = F.when(k == 1, "EMBEDDING_DISABLED").when(k == 2, "EMBEDDING_EGRESS_BLOCKED").when(k == 3, "EMBEDDING_FAILED")
    return table(spark, sf, "benchmark").select("item_id", C.vector_status(k != 0, error, F.when(F.col("item_id") % 2 == 1, 5)).alias("status"))


_DONE = f"""{_GONE}, old AS (SELECT run_id FROM runs WHERE updated < TIMESTAMP '{_CUTOFF}' AND (status = 'superseded' OR (NOT is_current AND status IN ('indexed', 'superseded')) OR (archived AND status IN ('indexed', 'superseded')))),
lines AS (SELECT l_linenumber, l_linestatus FROM lineitem WHERE l_orderkey IN (SELECT run_id FROM gone))"""


@query(f"""WITH {_DONE} SELECT 'runs' AS counter, count(*) AS n FROM gone UNION ALL SELECT 'superseded_runs', count(*) FILTER (status = 'superseded') FROM gone UNION ALL SELECT 'archived_runs', count(*) FILTER (archived) FROM gone
UNION ALL SELECT 'skipped_active_runs', (SELECT count(*) FROM old) - (SELECT count(*) FROM gone) UNION ALL SELECT 'artifacts', count(*) FILTER (run_id % 3 = 0) FROM gone
UNION ALL SELECT 'chunks', count(*) FROM lines UNION ALL SELECT 'parent_chunks', count(*) FILTER (l_linenumber = 1) FROM lines UNION ALL SELECT 'index_rows', count(*) FILTER (l_linenumber > 1) FROM lines UNION ALL SELECT 'vectors', count(*) FILTER (l_linenumber > 1 AND l_linestatus = 'F') FROM lines
UNION ALL SELECT 'failed_vectors', count(*) FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-03' UNION ALL SELECT 'search_runs', count(*) FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-03'""")
def retention_plan(spark, sf):
    """What a clean-up would remove, one row for each of eleven counters."""
    gone = _gone(spark, sf)
    all_old = _gone(spark, sf, keep_active=False)
    lines = table(spark, sf, "lineitem").join(gone.select(F.col("run_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    before = table(spark, sf, "events").where("ts < timestamp'2024-01-03'")
    child = F.col("l_linenumber") > 1
    one = lambda df, **counts: df.agg(*[c.alias(n) for n, c in counts.items()])
    runs = one(gone, runs=F.count("*"), superseded_runs=F.count_if(F.col("status") == "superseded"), archived_runs=F.count_if("archived"), artifacts=F.count_if(F.col("run_id") % 3 == 0))
    chunks = one(lines, chunks=F.count("*"), parent_chunks=F.count_if(~child), index_rows=F.count_if(child), vectors=F.count_if(child & (F.col("l_linestatus") == "F")))
    other = one(before, failed_vectors=F.count_if(F.col("event_type") == "error"), search_runs=F.count_if(F.col("event_type") == "view"))
    skipped = one(all_old.join(gone.select("run_id"), "run_id", "left_anti"), skipped_active_runs=F.count("*"))
    out = None
    for counted in (runs, chunks, other, skipped):
        rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in counted.columns])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {_GONE} SELECT l_orderkey, count(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (SELECT run_id FROM gone) GROUP BY l_orderkey""")
def retention_snapshot(spark, sf):
    """What a snapshot keeps of the chunks once the runs that may go are gone."""
    gone = _gone(spark, sf).select(F.col("run_id").alias("l_orderkey"))
    return table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("chunks"))
