"""Queries over structural chunks, markdown pages, locators and page scopes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunking as C
from ..operators import context as X
from ..operators import lifecycle as L
from ..operators import markdown as M
from ..operators import pages as P
from ..sources.tables import spread, table
from .registry import query
from .structure_queries import _LINES, _PROFILE, _TAIL, _marked

_W = "OVER (PARTITION BY doc_id ORDER BY line"
#: Units by windows over lines: a table goes on from its first line through rows and blank lines, a fence to the next one.
_UNITS = rf"""{_LINES},
u1 AS (SELECT *, NOT code AND contains(line_text, '|') AND len(c) >= 2 AS row_, NOT code AND t = '' AS blank,
  code AND regexp_matches(line_text, '^\s*(```|~~~)') AND sum(CASE WHEN regexp_matches(line_text, '^\s*(```|~~~)') THEN 1 ELSE 0 END) {_W}) % 2 = 1 AS opens,
  contains(t, '|') AND len(c) >= 2 AND len(list_filter(c, lambda x: NOT regexp_matches(trim(x), '^:?-{{3,}}:?$'))) = 0 AS rule FROM cls),
u2 AS (SELECT *, table_ OR (row_ AND coalesce(lead(rule) {_W}), false)) AS tstart FROM u1),
u3 AS (SELECT *, coalesce(max(CASE WHEN tstart THEN line END) {_W}), -2) > coalesce(max(CASE WHEN code OR NOT (row_ OR blank) THEN line END) {_W}), -1) AS in_table FROM u2),
u4 AS (SELECT *, lag(in_table, 1, false) {_W}) AS p_table, lag(code, 1, false) {_W}) AS p_code, lag(blank, 1, false) {_W}) AS p_blank, lag(code, 2, line = 1) {_W}) AS pp_code FROM u3),
u5 AS (SELECT *, CASE WHEN code THEN opens WHEN in_table THEN NOT p_table OR p_code WHEN heading OR line = 0 OR p_code OR p_table THEN true WHEN blank THEN false ELSE p_blank AND NOT pp_code END AS begins FROM u4),
u6 AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) {_W}) - 1 AS unit FROM u5),
size AS (SELECT doc_id, length(text) AS n FROM md),
un AS (SELECT u6.doc_id, CAST(unit AS INTEGER) AS unit, CAST(min(start) AS INTEGER) AS start, CAST(least(max(start + length(line_text) + 1), any_value(n)) AS INTEGER) AS "end",
  arg_min(CASE WHEN code THEN 'code' WHEN in_table THEN 'table' WHEN heading THEN 'heading' WHEN blank THEN 'blank' ELSE 'paragraph' END, line) AS type FROM u6 JOIN size USING (doc_id) GROUP BY u6.doc_id, unit),
units AS (SELECT * FROM un WHERE "end" > start)"""


@query(f"WITH {_UNITS} SELECT * FROM units")
def structural_units(spark, sf):
    return C.document_units(_marked(spark, sf)).drop("path")


@query(f"""WITH {_UNITS} SELECT type, CASE WHEN type IN ('code', 'table') THEN type END AS protected, count(*) AS blocks, CAST(sum("end" - start) AS BIGINT) AS chars FROM units GROUP BY type""")
def block_type_counts(spark, sf):
    """How many blocks of each type the documents have, and which of these are protected."""
    kind = F.col("type")
    found = C.document_units(_marked(spark, sf)).groupBy("type").agg(F.count("*").alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    return found.select("type", F.when(kind.isin("code", "formula", "table"), kind).alias("protected"), "blocks", "chars")


@query(f"""WITH {_UNITS} SELECT doc_id, true AS joined, true AS small, CAST(coalesce(sum("end" - start) FILTER (type IN ('paragraph', 'heading', 'blank') AND "end" - start > 384), 0) AS BIGINT) AS cut,
CAST(coalesce(sum("end" - start) FILTER (type IN ('paragraph', 'heading', 'blank') AND "end" - start <= 384), 0) AS BIGINT) AS whole, CAST(max("end") AS INTEGER) AS ends FROM units GROUP BY doc_id""")
def structural_pieces(spark, sf):
    """How many code points of each text's plain units are cut by length at 384, and that all pieces join and none is longer (but for inline formulas and links)."""
    docs = _marked(spark, sf)
    made = C.document_pieces(docs).join(docs.select("doc_id", F.col("text").rlike(r"\$|\]\(").alias("_inline")), "doc_id")
    w = W.partitionBy("doc_id").orderBy("start")
    size, plain = F.col("end") - F.col("start"), ~F.col("type").isin("code", "formula", "table")
    checked = made.withColumn("_joined", F.col("start") == F.lag("end", 1, 0).over(w))
    total = lambda c: F.coalesce(F.sum(F.when(plain & c, size)), F.lit(0)).cast("long")
    long = F.coalesce(F.col("reason"), F.lit("")) == "length-split"
    return checked.groupBy("doc_id").agg(F.bool_and("_joined").alias("joined"), F.bool_and(~plain | (size <= 384) | F.col("_inline")).alias("small"), total(long).alias("cut"), total(~long).alias("whole"), F.max("end").alias("ends"))


_STRATEGY = "CASE WHEN headings >= 3 AND headings / code_points > 0.005 THEN 'heading' WHEN markers >= 5 OR page_breaks > 0 THEN 'heuristic' ELSE 'legacy' END"


@query(rf"""WITH {_PROFILE} SELECT doc_id, {_STRATEGY} AS strategy, md5(regexp_replace(text, '\s', '', 'g')) AS held, true AS begins FROM prof JOIN md USING (doc_id) WHERE regexp_matches(text, '\S')""")
def chunk_document(spark, sf):
    """The strategy of each document's chunks, and that its children hold all of its text once and in order."""
    made = C.chunk_documents(_marked(spark, sf)).where("kind = 'child'")
    own = F.regexp_replace(F.expr("substring(content, overlap + 1)"), r"\s", "")
    parts = F.array_sort(F.collect_list(F.struct("sequence", own.alias("own"))))
    return made.groupBy("doc_id").agg(F.first("strategy").alias("strategy"), F.md5(F.array_join(F.transform(parts, lambda p: p["own"]), "")).alias("held"), F.bool_and(F.col("overlap") <= 76).alias("begins"))


@query()
def document_chunks(spark, sf):
    """All chunks of the documents; tests hold the rules against plain versions."""
    return C.chunk_documents(_marked(spark, sf)).withColumn("content", F.md5("content"))


@query()
def token_target_chunks(spark, sf):
    """Children of at most 128 tokens by a public vocabulary, whose path is a setting."""
    path = spark.conf.get("spark.knowlattice.tokenizer", None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    made = C.chunk_documents(spread(_marked(spark, sf)), C.Config(child_tokens=128, tokenizer=path))
    return made.where("kind = 'child'").select("doc_id", "sequence", "start", "end", "split_reason", F.md5("content").alias("h"))


def _conversation_pages(spark, sf):
    """Conversations as documents: a turn is a page, its lines are blocks, and code where the assistant speaks."""
    turns = table(spark, sf, "conversations").where("text is not null")
    page = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("page")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    blocks = F.transform(lines, lambda x, i: F.struct(F.when((F.col("role") == "assistant") & (i % 2 == 1), "formula").otherwise("text").alias("kind"), x.alias("text"), i.alias("order")))
    return turns.select(F.col("conv_id").alias("doc_id"), page, F.lit("succeeded").alias("status"), blocks.alias("blocks"))


_PAGES = r"""turns AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, role, list_filter(string_split(text, chr(10)), lambda x: trim(x) != '') AS l FROM conversations WHERE text IS NOT NULL),
shown AS (SELECT *, CASE WHEN page > 1 THEN chr(10) || chr(10) ELSE '' END || '<!-- page:' || page || ' -->' AS marker, array_to_string(list_transform(l, lambda x: chr(10) || chr(10) || x), '') AS body FROM turns),
placed AS (SELECT *, coalesce(sum(length(marker) + length(body)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM shown),
pg AS (SELECT doc_id, page, CAST(before + length(marker) AS INTEGER) AS start, CAST(before + length(marker) + length(body) AS INTEGER) AS "end", l, role, marker, body FROM placed),
bl AS (SELECT doc_id, page, i, CASE WHEN role = 'assistant' AND i % 2 = 0 THEN 'formula' ELSE 'text' END AS kind, l[i] AS text, start + 2 * i + coalesce(length(array_to_string(l[1:i-1], '')), 0) AS start FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pg)),
whole AS (SELECT doc_id, string_agg(marker || body, '' ORDER BY page) AS text FROM pg GROUP BY doc_id)"""


@query(f"""WITH {_PAGES}, b AS (SELECT doc_id, string_agg(kind || ',' || CAST(start AS INTEGER) || ',' || CAST(start + length(text) AS INTEGER) || ',' || page, ';' ORDER BY start) AS blocks FROM bl GROUP BY doc_id),
p AS (SELECT doc_id, string_agg(page || ',' || start || ',' || "end", ';' ORDER BY page) AS pages FROM pg GROUP BY doc_id) SELECT doc_id, md5(text) AS h, pages, md5(blocks) AS blocks FROM whole JOIN p USING (doc_id) JOIN b USING (doc_id)""")
def page_canonical_text(spark, sf):
    made = P.canonical_pages(_conversation_pages(spark, sf))
    line = lambda x, names: F.concat_ws(",", *[x[n] for n in names])
    joined = lambda c, names: F.array_join(F.transform(c, lambda x: line(x, names)), ";")
    return made.select("doc_id", F.md5("text").alias("h"), joined("pages", ("number", "start", "end")).alias("pages"), F.md5(joined("blocks", ("kind", "start", "end", "page"))).alias("blocks"))


@query(rf"""WITH {_PAGES} SELECT doc_id, md5(regexp_replace(text, '\s', '', 'g')) AS held, CASE WHEN count(bl.kind) > 1 OR max(pages) > 1 OR bool_or(bl.kind = 'formula') THEN 'parser' END AS strategy,
true AS inside FROM whole JOIN bl USING (doc_id) JOIN (SELECT doc_id, count(*) AS pages FROM pg GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, whole.text HAVING strategy IS NOT NULL""".replace("whole JOIN bl USING (doc_id)", "(SELECT doc_id, text FROM whole) whole JOIN (SELECT doc_id, kind FROM bl) bl USING (doc_id)"))
def parser_chunks(spark, sf):
    """Chunks by a parser's blocks and pages: they hold the whole text, and none goes over a page's end."""
    docs = P.canonical_pages(_conversation_pages(spark, sf))
    made = C.chunk_documents(docs).where("kind = 'child' and strategy = 'parser'").join(docs.select("doc_id", "pages"), "doc_id")
    over = F.exists("pages", lambda p: (F.col("start") + F.col("overlap") < p["end"]) & (F.col("end") > p["end"]))
    own = F.regexp_replace(F.expr("substring(content, overlap + 1)"), r"\s", "")
    parts = F.array_sort(F.collect_list(F.struct("sequence", own.alias("own"))))
    return made.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["own"]), "")).alias("held"), F.first("strategy").alias("strategy"), F.bool_and(~over).alias("inside"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 5 THEN 'page_number' WHEN length(text) < 40 THEN 'page_range' WHEN doc_id % 7 = 0 THEN 'page_twice' WHEN doc_id % 7 = 1 THEN 'pages_overlap' WHEN doc_id % 7 = 2 THEN 'block_range' WHEN doc_id % 7 = 3 THEN 'blocks_overlap'
WHEN doc_id % 7 = 4 THEN 'block_page' END AS problem FROM documents WHERE text IS NOT NULL""")
def parser_problems(spark, sf):
    """What is wrong with pages and blocks that have planted faults."""
    k = F.col("doc_id") % 7
    number = lambda n, at: F.when(k == at, F.lit(1 if at == 0 else 0)).otherwise(n).cast("int")
    page = lambda n, a, b: F.struct(n.alias("number"), F.lit(a).cast("int").alias("start"), b.cast("int").alias("end"))
    pages = F.array(page(number(F.lit(1), 5), 0, F.when(k == 1, 21).otherwise(20)), page(number(F.lit(2), 0), 20, F.lit(40)))
    block = lambda p, a, b: F.struct(F.lit("text").alias("kind"), F.lit(a).alias("start"), b.cast("int").alias("end"), p.cast("int").alias("page"))
    blocks = F.array(block(F.when(k == 4, 0), 0, F.when(k == 3, 11).otherwise(10)), block(F.lit(None), 10, F.when(k == 2, 10).otherwise(12)))
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", C.parser_problem(pages, blocks, F.length("text")).alias("problem"))


@query(rf"""WITH md AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || {_TAIL} ELSE text END AS text FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM md),
h AS (SELECT *, regexp_matches(l, '^#{{1,6}}\s+\S') AS head FROM ln), g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM h)
SELECT doc_id, greatest(max(CASE WHEN head THEN 1 ELSE 0 END) * count(*) FILTER (head) + max(CASE WHEN o = 0 AND trim(l) != '' THEN 1 ELSE 0 END), 1) AS blocks FROM g GROUP BY doc_id""")
def markdown_blocks(spark, sf):
    return M.blocks(_marked(spark, sf), "doc_id").groupBy("doc_id").agg(F.count("*").alias("blocks"))


_EDITED = """v AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, 'Line ' || doc_id || ' more' AS extra FROM documents WHERE text IS NOT NULL),
e AS (SELECT *, array_to_string(list_concat(list_concat(l[1:doc_id % len(l)], [extra]), l[doc_id % len(l) + 2:]), chr(10)) AS after FROM v)"""


@query(f"WITH {_EDITED} SELECT doc_id, CAST(1 AS BIGINT) AS added, CAST(1 AS BIGINT) AS removed, CAST(len(l) - 1 AS BIGINT) AS context, md5(after) AS after, md5(text) AS before FROM e")
def line_diff(spark, sf):
    """Each text against itself with one line replaced at a place that depends on the id: both versions are made again from the difference."""
    lines = F.split("text", "\n")
    at = (F.col("doc_id") % F.size("_l")).cast("int")
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", lines.alias("_l"))
    changed = F.concat(F.slice("_l", F.lit(1), at), F.array(F.concat(F.lit("Line "), F.col("doc_id").cast("string"), F.lit(" more"))), F.slice("_l", at + 2, F.size("_l")))
    diff = docs.withColumn("after", F.array_join(changed, "\n")).withColumn("d", M.line_diff("text", "after"))
    n = lambda kind: F.size(F.filter("d", lambda x: x["type"] == kind)).cast("long")
    again = lambda lost: F.md5(F.array_join(F.transform(F.filter("d", lambda x: x["type"] != lost), lambda x: x["value"]), "\n"))
    return diff.select("doc_id", n("added").alias("added"), n("removed").alias("removed"), n("context").alias("context"), again("removed").alias("after"), again("added").alias("before"))


@query("SELECT c.event_id, p.event_type AS parent_event_type FROM events c LEFT JOIN (SELECT * FROM events WHERE event_type != 'error') p ON p.event_id = c.event_id // 3")
def child_parent(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 3).alias("up"))
    return L.with_active_parent(events, "event_id", "up", F.col("event_type") != "error", ["event_type"]).select("event_id", "parent_event_type")


#: Locators with planted faults, one of each kind, and what is wrong with them (sources of 1000 letters and 3 pages).
_LOCATORS = [
    ('{"startOffset": 3, "endOffset": 9}', None), ('{"startOffset": 9, "endOffset": 9}', "range_not_rising"), ('{"startOffset": 3, "endOffset": 1001}', "beyond_source"), ('{"page": 1, "color": 1}', "unknown_field"), ('{"color": 1}', "no_position"),
    ('{"page": "1"}', "not_a_number"), ('{"page": 1.0}', None), ('{"page": 0}', "page_below_one"), ('{"pageStart": 3, "pageEnd": 2}', "page_range_not_rising"), ('{"pages": [1, "2"]}', "pages_not_numbers"), ('{"pages": [1, 4]}', "beyond_pages"),
    ('{"chunkId": 5}', "empty_or_long"), ('{"selector": " "}', "empty_or_long"), ("[1]", "not_an_object"), ('{"lineStart": -1}', "not_a_number"), ('{"chunkId": "c1", "pages": [3]}', None),
]


@query("SELECT event_id, CASE event_id % " + str(len(_LOCATORS)) + "".join(f" WHEN {k} THEN '{p}'" for k, (_, p) in enumerate(_LOCATORS) if p) + " END AS problem FROM events")
def locator_problems(spark, sf):
    """What is wrong with locators that have planted faults, one kind for each remainder of the id."""
    locator = F.get(F.array(*[F.lit(x) for x, _ in _LOCATORS]), (F.col("event_id") % len(_LOCATORS)).cast("int"))
    return table(spark, sf, "events").select("event_id", X.locator_problem(locator, F.lit(1000), F.lit(3)).alias("problem"))
