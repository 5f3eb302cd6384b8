"""Queries over readers, artifacts, traces, caches and audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lifecycle as L
from ..operators import pages as P
from ..sources import records
from ..sources.tables import shared_folder, table
from .document_queries import _PAGES, _conversation_pages
from .registry import query
from .source_queries import BUNDLE, _NAME, _parts, _written

_K = "doc_id % 9"


@query(f"""WITH d AS (SELECT doc_id, text, doc_id // {BUNDLE} AS part FROM documents WHERE text IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS line FROM d),
good AS (SELECT *, coalesce(sum(2) OVER (PARTITION BY part ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n WHERE {_K} NOT IN (1, 2, 3))
SELECT {_NAME} AS name, line, CASE {_K} WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'no_layouts' ELSE 'empty_page' END AS problem, NULL::INTEGER AS page, NULL AS h FROM n WHERE {_K} IN (1, 2, 3)
UNION ALL SELECT {_NAME}, line, NULL, CAST(before + 1 AS INTEGER), md5('first ' || doc_id) FROM good UNION ALL SELECT {_NAME}, line, NULL, CAST(before + 2 AS INTEGER), md5(text) FROM good""")
def layout_pages(spark, sf):
    """Pages of layout results numbered through each file; lines with planted faults are named."""
    docs = _parts(spark, sf)
    k = F.col("doc_id") % 9
    first = F.to_json(F.struct(F.struct(F.concat(F.lit("first "), F.col("doc_id").cast("string")).alias("text")).alias("markdown")))
    second = F.to_json(F.struct(F.when(k == 3, " ").otherwise(F.col("text")).alias("markdown")))
    whole = F.concat(F.lit('{"result": {"layoutParsingResults": ['), first, F.lit(","), second, F.lit("]}}"))
    line = F.when(k == 1, F.substring(whole, 1, 30)).when(k == 2, F.lit('{"result": {"layoutParsingResults": {}}}')).otherwise(whole)
    pages, problems = records.layout_pages(spark, _written(docs.select("part", F.col("doc_id").alias("at"), line.alias("line")), "layouts"))
    name = F.regexp_extract("file", "(part=[0-9]+)", 1).alias("name")
    found = pages.select(name, "line", F.lit(None).cast("string").alias("problem"), "page", F.md5("text").alias("h"))
    return found.unionByName(problems.select(name, "line", "problem", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("h")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND length(text) >= 400 THEN 'native' WHEN doc_id % 5 != 0 THEN 'layout' WHEN lang = 'en' THEN 'literal' END AS reader,
CASE WHEN doc_id % 3 = 0 AND length(text) >= 400 THEN '' ELSE CASE WHEN doc_id % 3 = 0 THEN 'EMPTY_RESULT' ELSE 'NATIVE_FAILED' END || CASE WHEN doc_id % 5 != 0 THEN '' WHEN lang = 'en' THEN ',TIMEOUT' ELSE ',TIMEOUT,EMPTY_RESULT' END END AS failed FROM documents""")
def reader_chain(spark, sf):
    """Which of three readers gives each document's text, and how those before it failed."""
    docs = table(spark, sf, "documents")
    i, text = F.col("doc_id"), F.col("text")
    candidates = [
        ("native", F.when(F.length(text) >= 400, text), F.when(i % 3 != 0, "NATIVE_FAILED")), ("layout", text, F.when(i % 5 == 0, "TIMEOUT")), ("literal", F.when(F.col("lang") == "en", text), F.lit(None).cast("string")),
    ]
    failed = F.array_join(F.transform(F.filter("attempts", lambda a: ~a["succeeded"]), lambda a: a["error"]), ",")
    return L.first_success(docs.select("doc_id", "lang", "text"), candidates).select("doc_id", "reader", failed.alias("failed"))


@query(f"""WITH {_PAGES} SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, md5(text) AS h, true AS intact FROM whole""")
def artifact_sink(spark, sf):
    """Canonical artifacts (text, pages, blocks) written as JSON with their hashes, read back and held against these."""
    made = P.canonical_pages(_conversation_pages(spark, sf))
    body = F.to_json(F.struct("text", "pages", "blocks"))
    path = shared_folder(spark, "artifacts")
    made.select("doc_id", body.alias("artifact"), F.sha2(body, 256).alias("sha256"), F.octet_length(body).alias("bytes"), F.pmod("doc_id", F.lit(8)).alias("part")).write.partitionBy("part").json(path)
    back = spark.read.schema("doc_id long, artifact string, sha256 string, bytes int").json(path)
    intact = (F.sha2("artifact", 256) == F.col("sha256")) & (F.octet_length("artifact") == F.col("bytes"))
    text = F.get_json_object("artifact", "$.text")
    return back.select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("h"), intact.alias("intact"))


@query("""SELECT event_id, 'q' || event_id AS query, CASE WHEN event_id % 3 = 0 THEN 'column' ELSE 'trace' END AS came, CAST(event_id % 4 AS INTEGER) AS results, event_id % 4 > 0 AS ranked, false AS bodies FROM events""")
def trace_replay(spark, sf):
    """Traces stored without the bodies of their results, and what a replay reads of them: the trace, or the columns where it can't be read."""
    e = F.col("event_id")
    result = lambda k: F.struct(k.alias("rank"), F.lit("long text").alias("content"), F.lit("parent").alias("parentContext"), F.lit("h").alias("contextHeader"), F.lit("s").alias("snippet"))
    results = F.slice(F.array(*[result(F.lit(k)) for k in (1, 2, 3)]), F.lit(1), (e % 4).cast("int"))
    query_text = F.concat(F.lit("q"), e.cast("string"))
    kept = F.transform(results, lambda r: r.dropFields("content", "parentContext", "contextHeader", "snippet"))
    trace = F.to_json(F.struct(query_text.alias("query"), F.struct(kept.alias("results")).alias("raw")))
    stored = table(spark, sf, "events").select("event_id", query_text.alias("query"), F.to_json(kept).alias("raw_seeds"), F.when(e % 3 == 0, F.substring(trace, 1, 9)).otherwise(trace).alias("trace_json"))
    v = F.try_parse_json("trace_json")
    rows = F.when(v.isNotNull(), F.try_variant_get(v, "$.raw.results", "array<variant>")).otherwise(F.try_variant_get(F.try_parse_json("raw_seeds"), "$", "array<variant>"))
    return stored.select(
        "event_id", F.coalesce(F.try_variant_get(v, "$.query", "string"), "query").alias("query"), F.when(v.isNull(), "column").otherwise("trace").alias("came"), F.size(rows).alias("results"),
        F.exists(rows, lambda r: F.try_variant_get(r, "$.rank", "int") == 1).alias("ranked"), F.exists(rows, lambda r: F.try_variant_get(r, "$.content", "string").isNotNull()).alias("bodies"),
    )


_SECRET_JSON = """'{"apiKey":"[REDACTED]","list":[{"token":"[REDACTED]","n":' || event_id || '},"see [REDACTED] and [REDACTED]"],"user":{"name":"u' || user_id || '","privateKey":"[REDACTED]"},"content":"[OMITTED]"}'"""


@query(f"SELECT event_id, {_SECRET_JSON} AS redacted FROM events")
def redact_json(spark, sf):
    """Secrets at any depth of a JSON value."""
    e, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    raw = F.concat(F.lit('{"apiKey": "k1", "list": [{"token": {"deep": 1}, "n": '), e, F.lit('}, "see sk-abcdefgh12 and Bearer abcdefgh.1"], "user": {"name": "u'), u, F.lit('", "privateKey": null}, "content": "whole text"}'))
    return table(spark, sf, "events").select("event_id", X.redacted_json(raw, audit=True).alias("redacted"))


@query("""WITH first AS (SELECT user_id, arg_min(event_type, event_id) AS t, arg_min(value > 50, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, count(*) AS writes, count(*) FILTER (event_type != t OR (value > 50) != v) AS conflicts FROM events JOIN first USING (user_id) GROUP BY user_id""")
def snapshot_conflicts(spark, sf):
    """Snapshots are written once: which later writes differ from the first in more than their time."""
    writes = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", (F.col("value") > 50).alias("large"))
    return L.written_once(writes, ["user_id"], ["event_id"], ["ts"])


@query("""WITH t AS (SELECT * FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1),
e AS (SELECT * FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT c_custkey, CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN event_type IN ('click', 'view') THEN 'ready' WHEN o_orderstatus = 'F' OR event_type = 'error' THEN CASE WHEN c_custkey % 4 = 0 THEN 'cancelled' ELSE 'failed' END ELSE 'missing' END AS status
FROM customer LEFT JOIN t ON t.o_custkey = c_custkey LEFT JOIN e ON e.user_id = c_custkey""")
def item_latest_status(spark, sf):
    """Each item with its latest task and its latest vector, and the status that these give it."""
    tasks = L.latest(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    tasks = tasks.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded").alias("task"))
    vectors = L.latest(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    vectors = vectors.select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type").isin("click", "view"), "ready").when(F.col("event_type") == "error", "failed").otherwise("queued").alias("vector"))
    both = table(spark, sf, "customer").select("c_custkey").join(tasks, "c_custkey", "left").join(vectors, "c_custkey", "left")
    error = F.when(F.col("c_custkey") % 4 == 0, "TASK_CANCELLED").otherwise("OTHER")
    return both.select("c_custkey", L.item_status(F.col("task"), F.col("vector"), error, F.lit(True)).alias("status"))


_CACHE = """c AS (SELECT doc_id, sha256(text) AS sha, ['mock', 'local'][CAST(doc_id % 2 AS INTEGER) + 1] AS provider, CASE WHEN doc_id % 3 = 0 THEN 32 ELSE 64 END AS dimensions, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS status FROM documents)"""


@query(f"""WITH {_CACHE}, best AS (SELECT sha, max(doc_id) AS hit FROM c WHERE provider = 'local' AND dimensions = 64 AND status = 'ready' GROUP BY sha) SELECT doc_id, hit FROM c LEFT JOIN best USING (sha)""")
def embedding_cache(spark, sf):
    """The newest ready vector of the same input, provider, model and size, where there is one."""
    k = F.col("doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    cache = docs.select("sha", k.alias("hit"), F.when(k % 2 == 0, "mock").otherwise("local").alias("provider"), F.when(k % 3 == 0, 32).otherwise(64).alias("dimensions"), F.when(k % 5 == 0, "failed").otherwise("ready").alias("status"))
    fits = cache.where("provider = 'local' and dimensions = 64 and status = 'ready'")
    return docs.join(L.latest(fits.select("sha", "hit"), ["sha"], ["hit"]), "sha", "left").select("doc_id", "hit")


@query("""SELECT event_id FROM events WHERE (user_id = 7 OR CAST(json_extract_string(props, '$.k') AS INTEGER) = 7) AND event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error' AND value > 5)""")
def audit_entity_feed(spark, sf):
    """Rows about an entity, by their id or by what their JSON says, without the noise that another set names."""
    events = table(spark, sf, "events")
    noise = events.where("event_type = 'error' and value > 5").select("event_id")
    about = (F.col("user_id") == 7) | (F.try_variant_get(F.try_parse_json("props"), "$.k", "int") == 7)
    return events.where(about).join(noise, "event_id", "left_anti").select("event_id")


@query("""SELECT pool, event_id FROM (SELECT event_type AS pool, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE event_id % 7 != 0 AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND (event_id % 5 = 0 OR ts <= TIMESTAMP '2024-01-02')))) WHERE k = 1""")
def due_claim(spark, sf):
    """The next task of each pool: the earliest that is queued, or waits for a retry that is due, and is not cancelled."""
    e = F.col("event_id")
    tasks = table(spark, sf, "events").select("event_id", F.col("event_type").alias("pool"), "ts", F.when(e % 3 == 0, "queued").when(e % 3 == 1, "retrying").otherwise("running").alias("status"), F.when(e % 5 != 0, F.col("ts")).alias("next_attempt_at"), (e % 7 == 0).alias("cancel_requested"))
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= F.lit("2024-01-02").cast("timestamp"))
    ready = tasks.where(~F.col("cancel_requested") & ((F.col("status") == "queued") | ((F.col("status") == "retrying") & due)))
    return ready.groupBy("pool").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def public_projection(spark, sf):
    """Rows as they are shown: without columns that begin with an underscore, and without their text."""
    return L.public(table(spark, sf, "documents").withColumn("_source", F.lit("kept inside")), "text", "source")


@query("""SELECT conv_id, CAST(least(sum(length(role) + 2 + length(text)) + count(*) - 1, 48000) AS INTEGER) AS chars, md5(right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 48000)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 10 GROUP BY conv_id""")
def prompt_history(spark, sf):
    """The oldest ten messages of each conversation as one text, of which the last 48,000 characters are kept."""
    oldest = table(spark, sf, "conversations").groupBy("conv_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), 1, 10).alias("m"))
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    return oldest.select("conv_id", whole.alias("t")).select("conv_id", F.least(F.length("t"), F.lit(48000)).alias("chars"), F.md5(F.expr("right(t, 48000)")).alias("h"))
