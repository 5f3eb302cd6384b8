"""Queries over the structure of texts, over chunks, and over the context assembled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import segments as S
from ..sources.tables import table
from .registry import query
from .search_queries import _BM25, _ranked
from .text_queries import est_tokens_sql

#: Markdown put after every third text, so that each class of line occurs.
TAIL = "\n# Alpha\n```py\n# none\n```\n## Beta\n| a | b |\n|---|---|\n1.2 Numbered part\nALL CAPITALS HERE\n---\n| A1 | B2 |\nABC é DEF\n第三章 Titel\n### Gamma"
_TAIL = "'" + TAIL.replace("\n", "' || chr(10) || '") + "'"


def _marked(spark, sf) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(TAIL))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", "source", text.alias("text"))


_UPTO = "OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND"
_LINES = rf"""md AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || {_TAIL} ELSE text END AS text FROM documents),
ln AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line, unnest(l) AS line_text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md)),
rec AS (SELECT *, CAST(coalesce(sum(length(line_text) + 1) {_UPTO} 1 PRECEDING), 0) AS BIGINT) AS start FROM ln),
fenced AS (SELECT *, sum(CASE WHEN regexp_matches(line_text, '^\s*(```|~~~)') THEN 1 ELSE 0 END) {_UPTO} CURRENT ROW) % 2 = 1 OR regexp_matches(line_text, '^\s*(```|~~~)') AS code FROM rec),
sorted AS (SELECT *, NOT code AND regexp_matches(line_text, '^\s{{0,3}}#{{1,6}}\s+\S') AS heading,
  NOT code AND (regexp_matches(line_text, '(?i)^\s*(\d+(\.\d+){{0,5}}[.)]?|第\s*[一二三四五六七八九十百千万\d]+\s*[章节]|(chapter|section|kapitel)\s+\d+)\s+\S+') OR regexp_matches(line_text, '^\s*[-*_](\s*[-*_]){{2,}}\s*$')
    OR (length(t) BETWEEN 4 AND 100 AND regexp_matches(t, '[A-Z]') AND t = upper(t))) AS marker,
  NOT code AND contains(t, '|') AND len(c) >= 2 AND (t[1] = '|' OR t[-1] = '|' OR regexp_matches(t, '\s\|\s') OR len(c) >= 3 OR len(list_filter(c, lambda x: NOT regexp_matches(trim(x), '^:?-{{3,}}:?$'))) = 0) AS table_,
  NOT code AND contains(line_text, chr(12)) AS page_break
  FROM (SELECT *, string_split(regexp_replace(regexp_replace(t, '^\|', ''), '\|$', ''), '|') AS c FROM (SELECT *, regexp_replace(line_text, '^\s+|\s+$', '', 'g') AS t FROM fenced))),
cls AS (SELECT *, CASE WHEN code THEN 'code' WHEN heading THEN 'heading' WHEN marker THEN 'marker' WHEN table_ THEN 'table' ELSE 'text' END AS kind FROM sorted)"""


@query(f"WITH {_LINES} SELECT doc_id, line, start, md5(line_text) AS h FROM rec")
def line_records(spark, sf):
    return S.lines(_marked(spark, sf)).select("doc_id", "line", "start", F.md5("line_text").alias("h"))


_PROFILE = f"""{_LINES}, prof AS (SELECT doc_id, count(*) FILTER (heading) AS headings, count(*) FILTER (marker) AS markers, count(*) FILTER (table_) AS table_lines,
count(*) FILTER (code) AS code_lines, count(*) FILTER (page_break) AS page_breaks, CAST(sum(length(line_text) + 1) - 1 AS BIGINT) AS code_points FROM cls GROUP BY doc_id)"""


@query(f"WITH {_PROFILE} SELECT *, round(CASE WHEN code_points > 0 THEN headings / code_points ELSE 0.0 END, 6) AS density FROM prof")
def doc_profile(spark, sf):
    return S.profile(_marked(spark, sf)).withColumn("density", F.round("density", 6))


@query(f"WITH {_PROFILE} SELECT doc_id, CASE WHEN headings >= 3 AND headings / code_points > 0.005 THEN 'heading' WHEN markers >= 5 OR page_breaks > 0 THEN 'heuristic' ELSE 'legacy' END AS strategy FROM prof")
def strategy_choice(spark, sf):
    return S.profile(_marked(spark, sf)).select("doc_id", S.strategy(F.col("headings"), F.col("density"), F.col("markers"), F.col("page_breaks")).alias("strategy"))


@query(f"WITH {_LINES} SELECT kind, count(*) AS n FROM cls GROUP BY kind")
def split_reason_counts(spark, sf):
    return S.classified(_marked(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


def _sections_sql(starts: str, title: str = r"trim(regexp_replace(line_text, '^\s*#+', ''))") -> str:
    return f"""{_LINES}, numbered AS (SELECT *, CAST(sum(CASE WHEN {starts} THEN 1 ELSE 0 END) {_UPTO} CURRENT ROW) AS INTEGER) AS section FROM cls),
sec AS (SELECT doc_id, section, min(start) AS start, max(start + length(line_text)) AS "end", max(CASE WHEN {starts} THEN {title} END) AS title FROM numbered GROUP BY doc_id, section)"""


@query(f"WITH {_sections_sql('heading')} SELECT * FROM sec")
def heading_sections(spark, sf):
    return S.sections(_marked(spark, sf), F.col("kind") == "heading")


_MARKS = "(marker OR page_break) AND start > 0"
#: A heading in capitals and lines with form feeds, which begin sections as well.
_BREAKS = "\n# ALPHA\nbefore \fafter\n\f\nlast"


def _broken(spark, sf) -> DataFrame:
    return _marked(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(_BREAKS))).otherwise(F.col("text")))


_BREAKS_SQL = "'" + _BREAKS.replace("\n", "' || chr(10) || '").replace("\f", "' || chr(12) || '") + "'"
_BROKEN = _sections_sql(_MARKS, r"regexp_replace(replace(line_text, chr(12), ' '), '^\s+|\s+$', '', 'g')").replace("FROM documents)", f"FROM (SELECT doc_id, text FROM documents)), md AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || {_BREAKS_SQL} ELSE text END AS text FROM md0)").replace("md AS (SELECT doc_id, CASE WHEN doc_id % 3", "md0 AS (SELECT doc_id, CASE WHEN doc_id % 3", 1)


@query(f"WITH {_BROKEN} SELECT * FROM sec")
def heuristic_sections(spark, sf):
    marks = (F.col("marker") | F.col("page_break")) & (F.col("start") > 0)
    return S.sections(_broken(spark, sf), marks, title=S.marker_title())


_STEP = S.TARGET - S.OVERLAP
_CHUNKS = f"""ck AS (SELECT * FROM (SELECT doc_id, source, CAST(s // {_STEP} AS INTEGER) AS sequence, s AS start, least(s + {S.TARGET}, length(text)) AS "end", substring(text, s + 1, {S.TARGET}) AS content
  FROM (SELECT doc_id, source, text, unnest(range(0, greatest(length(text) - 1 - {S.OVERLAP}, 0) + 1, {_STEP})) AS s FROM documents WHERE length(text) > 0)) WHERE trim(content) != '')"""


def _chunks(spark, sf) -> DataFrame:
    return S.fixed_chunks(table(spark, sf, "documents"))


@query(f'WITH {_CHUNKS} SELECT doc_id, sequence, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", md5(content) AS h FROM ck')
def fixed_size_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "sequence", "start", "end", F.md5("content").alias("h"))


@query(f"""WITH {_CHUNKS}, less AS (SELECT *, lag("end", 1, 0) OVER w AS le, lag(start, 1, -1) OVER w AS ls FROM ck WHERE (doc_id + sequence) % 7 != 0 WINDOW w AS (PARTITION BY doc_id ORDER BY sequence))
SELECT doc_id, sequence, CASE WHEN "end" <= start THEN 'empty' WHEN start > le THEN 'gap' ELSE 'order' END AS problem FROM less WHERE "end" <= start OR start > le OR start <= ls""")
def chunk_coverage(spark, sf):
    """What the coverage check says where some chunks are lost."""
    return S.coverage_gaps(_chunks(spark, sf).where((F.col("doc_id") + F.col("sequence")) % 7 != 0))


@query(f"WITH {_CHUNKS} SELECT source, count(*) AS chunks, round(avg(length(content)), 2) AS average, CAST(max(length(content)) AS INTEGER) AS largest FROM ck GROUP BY source")
def chunk_size_stats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return _chunks(spark, sf).select("doc_id", F.length("content").alias("n")).join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 2).alias("average"), F.max("n").alias("largest"))


_OVER = f"""{_sections_sql('heading')}, {_CHUNKS}"""


def _with_sections(spark, sf) -> DataFrame:
    sections = S.sections(_marked(spark, sf), F.col("kind") == "heading").select("doc_id", "section", F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return S.overlapping(_chunks(spark, sf).select("doc_id", "sequence", "start", "end"), sections)


@query(f'WITH {_OVER} SELECT doc_id, sequence, section FROM ck JOIN sec USING (doc_id) WHERE ck.start < sec."end" AND ck."end" > sec.start')
def range_overlap(spark, sf):
    return _with_sections(spark, sf).select("doc_id", "sequence", "section")


@query(f'WITH {_OVER} SELECT doc_id, sequence, section FROM ck JOIN sec USING (doc_id) WHERE ck.start >= sec.start AND ck.start < sec."end" AND ck."end" > sec.start')
def point_in_range(spark, sf):
    """The section that each chunk begins in."""
    return _with_sections(spark, sf).where("start >= other_start").select("doc_id", "sequence", "section")


@query(f"WITH {_LINES}, hit AS (SELECT doc_id, line FROM ln WHERE contains(line_text, 'tion')), last AS (SELECT doc_id, max(line) AS top FROM ln GROUP BY doc_id), want AS (SELECT doc_id, line + d AS line FROM hit, (VALUES (-1), (0), (1)) v(d) UNION SELECT doc_id, 0 FROM last WHERE doc_id NOT IN (SELECT doc_id FROM hit)) SELECT doc_id, CAST(line AS INTEGER) AS line FROM want JOIN last USING (doc_id) WHERE line BETWEEN 0 AND top")
def neighbor_blocks(spark, sf):
    """Matching blocks with those next to them; the first block where none matches."""
    lines = S.lines(_marked(spark, sf)).groupBy("doc_id").agg(F.max("line").alias("top"), F.collect_list(F.when(F.contains("line_text", F.lit("tion")), F.col("line"))).alias("hit"))
    around = F.when(F.size("hit") == 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.flatten(F.transform("hit", lambda i: F.array(i - 1, i, i + 1)))))
    return lines.select("doc_id", "top", F.explode(around).alias("line")).where("line between 0 and top").select("doc_id", "line")


@query("SELECT item_id, CAST(floor(b * 0.6) AS BIGINT) AS wiki, CAST(b - floor(b * 0.6) AS BIGINT) AS raw FROM (SELECT item_id, 1000 + item_id * 37 AS b FROM benchmark)")
def budget_split(spark, sf):
    b = 1000 + F.col("item_id") * 37
    wiki = F.floor(b * 0.6)
    return table(spark, sf, "benchmark").select("item_id", wiki.alias("wiki"), (b - wiki).alias("raw"))


BUDGET = 3200
_SIZED = f"{_BM25}, sizes AS (SELECT item_id, doc_id, keyword_rank AS rank, {est_tokens_sql('text')} AS tokens FROM ranked JOIN documents USING (doc_id) WHERE keyword_rank <= 10), run AS (SELECT *, coalesce(sum(tokens + 1) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes)"


def _sized(spark, sf) -> DataFrame:
    """The ten best documents of each query with their size and what those before them and a separator each take."""
    docs = table(spark, sf, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))
    before = W.partitionBy("item_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return _ranked(spark, sf, 10).select("item_id", "doc_id", "rank").join(docs, "doc_id").withColumn("before", F.coalesce(F.sum(F.col("tokens") + 1).over(before), F.lit(0)))


@query(f"WITH {_SIZED} SELECT item_id, doc_id, tokens FROM run WHERE before + tokens <= {BUDGET}")
def pack_whole_items(spark, sf):
    return _sized(spark, sf).where(F.col("before") + F.col("tokens") <= BUDGET).select("item_id", "doc_id", "tokens")


@query(f"WITH {_SIZED} SELECT item_id, doc_id, CAST(greatest(least(tokens, {BUDGET} - before), 0) AS BIGINT) AS used, CASE WHEN before + tokens <= {BUDGET} THEN 'whole' WHEN before < {BUDGET} THEN 'truncated' ELSE 'budget_exhausted' END AS outcome FROM run")
def pack_greedy(spark, sf):
    """By rank until the budget is used up; the item that meets its end is cut there."""
    left = F.lit(BUDGET) - F.col("before")
    outcome = F.when(F.col("tokens") <= left, "whole").when(left > 0, "truncated").otherwise("budget_exhausted")
    return _sized(spark, sf).select("item_id", "doc_id", F.greatest(F.least(F.col("tokens"), left), F.lit(0)).cast("long").alias("used"), outcome.alias("outcome"))


_HEALTH = """h AS (SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'version_missing' WHEN p_partkey IS NULL THEN 'chunk_missing' WHEN l_quantity > p_size THEN 'locator_out_of_range' WHEN o_orderkey != cur THEN 'needs_review' ELSE 'active' END AS status
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus != 'P') ON l_orderkey = o_orderkey LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS cur FROM orders GROUP BY o_custkey) USING (o_custkey) LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey)"""


def _health(spark, sf) -> DataFrame:
    """Each citation's state, the first that applies: its version, chunk and range must be there; a newer version asks for a review."""
    orders = table(spark, sf, "orders")
    versions = orders.where("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.lit(True).alias("known"))
    current = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("cur"))
    parts = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    status = (
        F.when(F.col("known").isNull(), "version_missing").when(F.col("p_size").isNull(), "chunk_missing").when(F.col("l_quantity") > F.col("p_size"), "locator_out_of_range")
        .when(F.col("l_orderkey") != F.col("cur"), "needs_review").otherwise("active")
    )
    cited = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    # The newest run of an owner is met by its few versions, not by each citation (those without a version would all meet at a null owner).
    versions = versions.join(current, "o_custkey", "left").drop("o_custkey")
    return cited.join(versions, "l_orderkey", "left").join(parts, "l_partkey", "left").select("l_orderkey", "l_linenumber", status.alias("status"))


@query(f"WITH {_HEALTH} SELECT * FROM h")
def citation_health(spark, sf):
    return _health(spark, sf)


@query(f"WITH {_HEALTH} SELECT count(*) AS checked, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'needs_review') AS needs_review, count(*) FILTER (status NOT IN ('active', 'needs_review')) AS broken FROM h")
def impact_counts(spark, sf):
    s = F.col("status")
    return _health(spark, sf).agg(F.count("*").alias("checked"), F.count_if(s == "active").alias("active"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(~s.isin("active", "needs_review")).alias("broken"))


@query(f"WITH {_HEALTH} SELECT l_orderkey, l_linenumber, status FROM h WHERE status != 'active'")
def impact_listing(spark, sf):
    return _health(spark, sf).where("status != 'active'")


@query("""WITH c AS (SELECT user_id, ['warn', 'required', 'tag_add'][CAST(user_id % 3 AS INTEGER) + 1] AS policy, count(*) FILTER (event_type = 'purchase') AS valid, count(*) FILTER (event_type = 'error' AND value > 50) AS invalid FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN policy = 'tag_add' THEN 'not_applicable' WHEN invalid > 0 THEN CASE policy WHEN 'required' THEN 'error' ELSE 'unverified' END WHEN valid = 0 THEN CASE policy WHEN 'required' THEN 'needs_evidence' ELSE 'unverified' END ELSE 'verified' END AS evidence,
CASE WHEN policy != 'warn' THEN NULL WHEN invalid > 0 THEN 'AGENT_CITATION_INVALID' WHEN valid = 0 THEN 'AGENT_CITATION_MISSING' END AS warning FROM c""")
def citation_policy(spark, sf):
    policy = F.get(F.array(F.lit("warn"), F.lit("required"), F.lit("tag_add")), (F.col("user_id") % 3).cast("int"))
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("valid"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 50)).alias("invalid")).withColumn("policy", policy)
    strict, bad, none = F.col("policy") == "required", F.col("invalid") > 0, F.col("valid") == 0
    evidence = F.when(F.col("policy") == "tag_add", "not_applicable").when(bad, F.when(strict, "error").otherwise("unverified")).when(none, F.when(strict, "needs_evidence").otherwise("unverified")).otherwise("verified")
    warning = F.when(F.col("policy") == "warn", F.when(bad, "AGENT_CITATION_INVALID").when(none, "AGENT_CITATION_MISSING"))
    return c.select("user_id", evidence.alias("evidence"), warning.alias("warning"))


@query("SELECT doc_id, substring(text, CAST(doc_id % 100 AS INTEGER) + 1, 64000) AS evidence FROM documents")
def scoped_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substr("text", (F.col("doc_id") % 100).cast("int") + 1, F.lit(64000)).alias("evidence"))


@query("SELECT doc_id, length(text) = n_chars AS complete, sha256(text) AS sha, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) != n_chars THEN 'size_differs' ELSE 'ok' END AS integrity FROM documents")
def provenance_rows(spark, sf):
    n = F.length("text")
    integrity = F.when(F.col("text").isNull(), "missing").when(n != F.col("n_chars"), "size_differs").otherwise("ok")
    return table(spark, sf, "documents").select("doc_id", (n == F.col("n_chars")).alias("complete"), F.sha2("text", 256).alias("sha"), integrity.alias("integrity"))


@query("SELECT 'q' || item_id AS query_id, trim(text) AS query, CAST(length(trim(text)) AS INTEGER) AS n FROM benchmark")
def benchmark_convert(spark, sf):
    """Queries as an evaluation takes them: normal form, trimmed, prefixed ids."""
    t = F.trim(X.nfkc(F.col("text")))
    return table(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), t.alias("query"), F.length(t).alias("n"))


@query("""WITH t AS (SELECT item_id, CASE WHEN item_id % 3 = 1 THEN ' ' || text || ' ' WHEN item_id % 3 = 2 THEN replace(text, ' ', chr(160)) ELSE text END AS raw, trim(text) AS plain FROM benchmark)
SELECT count(*) AS rows, count(*) FILTER (raw != plain) AS changed, arg_max('q' || item_id, item_id) AS last, CAST(max(length(plain)) AS INTEGER) AS longest FROM t""")
def conversion_counts(spark, sf):
    """What a conversion to normal form has changed, and the last id in the order of numbers."""
    k = F.col("item_id") % 3
    raw = F.when(k == 1, F.concat(F.lit(" "), "text", F.lit(" "))).when(k == 2, F.regexp_replace("text", " ", "\u00a0")).otherwise(F.col("text"))
    rows = table(spark, sf, "benchmark").select("item_id", raw.alias("raw")).withColumn("plain", F.trim(X.nfkc("raw")))
    named = F.concat(F.lit("q"), F.col("item_id").cast("string"))
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("raw") != F.col("plain")).alias("changed"), F.max_by(named, "item_id").alias("last"), F.max(F.length("plain")).alias("longest"))
