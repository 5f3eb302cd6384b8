"""Queries over the context of answers: ranked items in a budget, sources of pages, scopes, pages and links that are still valid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import context as C
from ..operators import lifecycle as L
from ..sources.tables import table
from .registry import query
from .search_queries import _BM25, _FUSED, _ranked, fused
from .text_queries import est_tokens_sql

_TITLE = "substring(split_part({0}, chr(10), 1), 1, 40)"


def _items(spark, sf) -> DataFrame:
    """The ten best documents of each query as items of a context: even ids are wiki pages, odd ones chunks with a header."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    found = _ranked(spark, sf, 10).select("item_id", "doc_id", F.col("rank")).join(docs, "doc_id")
    raw = F.col("doc_id") % 2 == 1
    return found.select(
        "item_id", (F.lit(1500) + F.col("item_id") * 137).cast("long").alias("budget"), F.when(raw, "raw").otherwise("wiki").alias("channel"), "rank", F.col("doc_id").alias("id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 40).alias("title"), F.when(raw, F.col("source")).alias("header"), F.lit(None).cast("string").alias("parent"), F.col("text").alias("content"), F.array().cast("array<string>").alias("terms"),
    )


_ROOM = rf"""{_BM25}, it AS (SELECT item_id, doc_id, keyword_rank AS rank, doc_id % 2 = 1 AS raw, 1500 + item_id * 137 AS budget,
  CASE WHEN doc_id % 2 = 1 THEN '### Raw · ' || {_TITLE.format('text')} || chr(10) || 'Context header:' || chr(10) || source || chr(10) || chr(10) || 'Child chunk:' || chr(10) || text ELSE '### Wiki · ' || {_TITLE.format('text')} || chr(10) || text END AS shown
  FROM ranked JOIN documents USING (doc_id) WHERE keyword_rank <= 10),
cost AS (SELECT *, {est_tokens_sql("regexp_replace(shown, '^\\s+|\\s+$', '', 'g')")} AS tokens, CASE WHEN raw THEN budget - floor(budget * 0.6) ELSE floor(budget * 0.6) END AS room, bool_or(NOT raw) OVER (PARTITION BY item_id) AS wiki FROM it),
run AS (SELECT *, sum(tokens + 1) OVER (PARTITION BY item_id, raw ORDER BY rank) - CASE WHEN raw AND wiki THEN 0 ELSE 1 END AS used FROM cost)"""


@query(f"""WITH {_ROOM} SELECT item_id, CASE WHEN raw THEN 'raw' ELSE 'wiki' END AS channel, count(*) AS items, count(*) FILTER (used <= room) AS whole, CAST(coalesce(sum(tokens) FILTER (used <= room), 0) AS BIGINT) AS tokens, true AS within FROM run GROUP BY item_id, raw""")
def context_assembled(spark, sf):
    """Contexts within their budgets: of each channel how many items came whole before the first cut, with how many tokens."""
    made = C.assemble(_items(spark, sf))
    cut = made.where("outcome != 'whole'").groupBy("item_id", "channel").agg(F.min("rank").alias("cut"))
    budget = F.lit(1500) + F.col("item_id") * 137
    room = F.when(F.col("channel") == "wiki", F.floor(budget * 0.6)).otherwise(budget - F.floor(budget * 0.6))
    lead = (F.col("outcome") == "whole") & (F.col("cut").isNull() | (F.col("rank") < F.col("cut")))
    found = made.join(cut, ["item_id", "channel"], "left").groupBy("item_id", "channel").agg(
        F.count("*").alias("items"), F.count_if(lead).alias("whole"), F.coalesce(F.sum(F.when(lead, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"), F.sum("tokens").alias("_all")
    )
    return found.select("item_id", "channel", "items", "whole", "tokens", (F.col("_all") <= room).alias("within"))


@query(f"""WITH {_FUSED}, a AS (SELECT item_id, doc_id AS page_id, keyword_rank AS rank, 'seed' AS came FROM ranked WHERE keyword_rank <= 5), b AS (SELECT item_id, doc_id AS page_id, rank, 'fused' AS came FROM placed)
SELECT item_id, page_id, CAST(rank AS INTEGER) AS rank, came FROM a UNION ALL SELECT item_id, page_id, CAST(rank AS INTEGER), came FROM b ANTI JOIN a USING (item_id, page_id)""")
def seeds_then_results(spark, sf):
    """Seeds and further results one after the other, each page once."""
    seeds = _ranked(spark, sf, 5).select("item_id", F.col("doc_id").alias("page_id"), "rank", F.lit("seed").alias("came"))
    more = fused(spark, sf).select("item_id", F.col("doc_id").alias("page_id"), F.col("rank").cast("int").alias("rank"), F.lit("fused").alias("came"))
    return C.first_of_sources([seeds, more], ["item_id"])


@query("""SELECT l_orderkey AS page_id, l_linenumber, l_partkey AS version_id, l_suppkey AS resource_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND l_quantity >= 10
AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 5) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def cited_sources(spark, sf):
    """The sources of pages, through their citations, versions and resources, in one batch."""
    seeds = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("page_id"), F.lit(1).alias("page_version"))
    citations = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_quantity") >= 10, 1).otherwise(0).alias("page_version"), "l_linenumber", F.col("l_partkey").alias("version_id"), F.col("l_suppkey").alias("resource_id"))
    versions = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("version_id"))
    resources = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("resource_id"))
    return C.cited_sources(seeds, citations, versions, resources).select("page_id", "l_linenumber", "version_id", "resource_id")


_PAGES = """pages AS (SELECT c_custkey AS page_id, CASE WHEN c_custkey % 11 = 0 THEN 'archived' ELSE 'active' END AS status, CASE c_custkey % 13 WHEN 0 THEN 'index' WHEN 1 THEN 'log' ELSE 'concept' END AS page_type,
c_mktsegment AS base, c_nationkey % 5 AS space, c_custkey % 3 AS version, CASE WHEN c_custkey % 7 = 0 THEN 9 ELSE c_custkey % 3 END AS current_version FROM customer)"""


def _pages(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 13 == 0, "index").when(k % 13 == 1, "log").otherwise("concept")
    return table(spark, sf, "customer").select(
        k.alias("page_id"), F.when(k % 11 == 0, "archived").otherwise("active").alias("status"), kind.alias("page_type"), F.col("c_mktsegment").alias("base"), (F.col("c_nationkey") % 5).alias("space"),
        (k % 3).cast("int").alias("version"), F.when(k % 7 == 0, 9).otherwise(k % 3).cast("int").alias("current_version"),
    )


_ACTIVE = "status = 'active' AND page_type NOT IN ('index', 'log') AND version = current_version"


@query(f"WITH {_PAGES} SELECT page_id, base, space FROM pages WHERE {_ACTIVE}")
def active_pages(spark, sf):
    return L.active_pages(_pages(spark, sf)).select("page_id", "base", "space")


@query(f"WITH {_PAGES} SELECT 'wiki' AS channel, CAST(page_id AS BIGINT) AS id FROM pages WHERE {_ACTIVE} AND base = 'BUILDING' AND space = 2 UNION ALL SELECT 'raw', CAST(o_orderkey AS BIGINT) FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def base_and_space(spark, sf):
    """What a base and a space of it hold: the space narrows pages only."""
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("base"))
    chunks = table(spark, sf, "orders").join(owners, "o_custkey").select(F.col("o_orderkey").alias("chunk_id"), "base")
    found = L.in_base(_pages(spark, sf), chunks, "BUILDING", 2)
    return found.select("channel", F.col("id").cast("long").alias("id"))


@query(f"""WITH {_PAGES}, n AS (SELECT count(*) AS n FROM customer), edges AS (SELECT o_orderkey, o_custkey AS source, o_orderkey % 3 AS source_version, (o_custkey * 7 + o_orderkey) % (SELECT n FROM n) + 1 AS target FROM orders), ends AS (SELECT * FROM pages WHERE status = 'active' AND page_type NOT IN ('index', 'log'))
SELECT o_orderkey, CAST(source AS BIGINT) AS source, CAST(target AS BIGINT) AS target FROM edges JOIN ends a ON a.page_id = source JOIN ends b ON b.page_id = target WHERE source_version = a.current_version AND a.base = b.base""")
def valid_edges(spark, sf):
    """Links whose source is still in the version that has them, between active pages of one base."""
    n = table(spark, sf, "customer").count()
    orders = table(spark, sf, "orders")
    edges = orders.select("o_orderkey", F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 3).cast("int").alias("source_version"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % n + 1).alias("target"))
    return L.valid_edges(edges, _pages(spark, sf)).select("o_orderkey", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


@query("""WITH named AS (SELECT user_id AS c_custkey FROM events WHERE event_type = 'purchase' UNION SELECT c_custkey FROM customer WHERE c_nationkey = 3) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM named)""")
def scope_of_traces(spark, sf):
    """Rows of the owners that are stated or that traces name."""
    traces = table(spark, sf, "events").where("event_type = 'purchase'").groupBy("event_type", F.col("event_id") % 100).agg(F.collect_set("user_id").alias("ids")).select("ids")
    stated = table(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return C.in_scope(table(spark, sf, "orders"), stated, traces, "o_custkey").select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey = new THEN 'active' WHEN new IS NOT NULL AND o_orderstatus = 'O' THEN 'superseded' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'indexed' END AS status
FROM orders LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS new FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) USING (o_custkey)""")
def generation_swap(spark, sf):
    """Runs after the newest finished one of each owner became active."""
    orders = table(spark, sf, "orders")
    runs = orders.select("o_custkey", F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("indexed").alias("status"))
    new = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("run_id"))
    return L.swap_generation(runs, new, ["o_custkey"]).select(F.col("run_id").alias("o_orderkey"), "status")


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(NULL AS DATE) AS added, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part")
def copy_common_columns(spark, sf):
    """Rows copied into a later schema: columns that both have, in the new types; the others are empty."""
    target = spark.createDataFrame([], "p_partkey long, p_name string, added date, p_retailprice string")
    return L.common_columns(table(spark, sf, "part"), target)


_WIKI = "text || ' [a](wiki://0A' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-0000-4000-8000-00000000000A) and wiki://0A' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-0000-4000-8000-00000000000A, not wiki://short'"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(t, '(?i)wiki://([0-9a-f-]{{36}})')) AS INTEGER) AS links, array_to_string(regexp_extract_all(t, '(?i)wiki://([0-9a-f-]{{36}})', 1), ',') AS ids FROM (SELECT doc_id, {_WIKI} AS t FROM documents)")
def wiki_link_repeats(spark, sf):
    """All page links of each text as they are written, repeats kept."""
    link = F.concat(F.lit("wiki://0A"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("-0000-4000-8000-00000000000A"))
    text = F.concat("text", F.lit(" [a]("), link, F.lit(") and "), link, F.lit(", not wiki://short"))
    found = table(spark, sf, "documents").select("doc_id", X.wiki_links(text).alias("w"))
    return found.select("doc_id", F.size("w").alias("links"), F.array_join("w", ",").alias("ids"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN source || chr(10) || chr(10) || text ELSE source || chr(10) || text END) AS sha FROM documents WHERE text != ''")
def embedding_inputs(spark, sf):
    """What is embedded: a chunk with its header and a blank line, without one where it is empty, or a page under its title."""
    k = F.col("doc_id") % 3
    chunk, page = X.embedding_input(F.when(k == 1, F.col("source")).otherwise(""), F.col("text")), X.embedding_input(F.col("source"), F.col("text"), "\n")
    return table(spark, sf, "documents").where("text != ''").select("doc_id", F.sha2(F.when(k == 2, page).otherwise(chunk), 256).alias("sha"))
