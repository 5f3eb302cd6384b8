"""Queries over texts: tokens, estimates, canonical forms, links, gates, hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import table
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def words_sql(c: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({c}), '\p{{Han}}', ' ', 'g'), '[\p{{L}}\p{{N}}]+')"


def bigrams_sql(c: str) -> str:
    runs = rf"regexp_extract_all({c}, '\p{{Han}}+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"


def query_terms_sql(c: str) -> str:
    """Distinct words without stop words, in order of first appearance, then bigrams."""
    kept = f"list_filter({words_sql(c)}, lambda w: NOT list_contains([{_STOP}], w))"
    both = f"list_concat({kept}, {bigrams_sql(c)})"
    return f"list_filter({both}, lambda x, i: list_position({both}, x) = i)"


@query(f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_words, CAST(len(list_distinct({words_sql('text')})) AS BIGINT) AS n_distinct, CAST(len({bigrams_sql('text')}) AS BIGINT) AS n_bigrams FROM documents")
def tok_doc_stats(spark, sf):
    w = X.words(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"), F.size(X.bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


_LITERALS = ["知识库 retrieval", "what is the BM25", "漢", "検索エンジン and 知识图谱 2024", "naïve Ünïcode 字", ""]


_MIXED = "[" + ", ".join(f"'{t}'" for t in _LITERALS) + f"][CAST(doc_id % {len(_LITERALS)} AS INTEGER) + 1] || ' ' || substring(text, 1, 40 + CAST(doc_id % 200 AS INTEGER)) || ' 第' || doc_id || '章知识'"


@query(f"SELECT doc_id, array_to_string({bigrams_sql('t')}, ' ') AS bigrams, array_to_string({query_terms_sql('t')}, ' ') AS terms FROM (SELECT doc_id, {_MIXED} AS t FROM documents)")
def tok_bigrams_literal(spark, sf):
    """Bigrams and query terms of texts that mix scripts: a part of each document among words in other scripts."""
    first = F.get(F.array(*map(F.lit, _LITERALS)), (F.col("doc_id") % len(_LITERALS)).cast("int"))
    part = F.substr("text", F.lit(1), (F.col("doc_id") % 200).cast("int") + 40)
    mixed = F.concat(first, F.lit(" "), part, F.lit(" 第"), F.col("doc_id").cast("string"), F.lit("章知识"))
    texts = table(spark, sf, "documents").select("doc_id", mixed.alias("t"))
    return texts.select("doc_id", F.array_join(X.bigrams(F.col("t")), " ").alias("bigrams"), F.array_join(X.query_terms(F.col("t")), " ").alias("terms"))


@query(f"SELECT item_id, array_to_string({query_terms_sql('text')}, ' ') AS terms FROM benchmark")
def tok_query_terms(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.query_terms(X.nfkc("text")), " ").alias("terms"))


def est_tokens_sql(c: str) -> str:
    c, inner = f"coalesce({c}, '')", X.EMOJI[1:-1]
    words = rf"list_transform(regexp_extract_all(regexp_replace({c}, '[\p{{Han}}{inner}]', chr(1), 'g'), '[\p{{L}}\p{{N}}]+'), lambda w: ceil(length(w) / 4.0))"
    n = lambda pattern: f"len(regexp_extract_all({c}, '{pattern}'))"
    han = r"\p{Han}"
    return rf"CAST(coalesce(list_sum({words}), 0) + {n(han)} + 2 * {n(X.EMOJI)} + {n(f'[{X.SPACE}]+')} + length(regexp_replace({c}, '[\p{{L}}\p{{N}}\p{{Han}}{X.SPACE}{inner}]+', '', 'g')) AS BIGINT)"


@query(f"SELECT doc_id, {est_tokens_sql('text')} AS tokens FROM documents")
def est_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS code_points, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY source")
def size_metrics(spark, sf):
    n, b = F.length("text"), F.octet_length("text")
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(n).alias("code_points"), F.sum(b).cast("long").alias("bytes"), F.max(b).cast("long").alias("largest"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(chr(65279) || replace(text, chr(10), chr(13) || chr(10)), '^' || chr(65279), ''), '\r\n?', chr(10), 'g')) AS canonical_sha FROM documents")
def canonical_text(spark, sf):
    windows = F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.canonical(windows), 256).alias("canonical_sha"))


_TITLE = r"regexp_extract(html, '(?is)<title>([^<]*)</title>', 1)"


@query(rf"""SELECT page_id, coalesce(nullif(regexp_replace(substring(regexp_replace(regexp_replace(lower(trim({_TITLE})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), '-+$', '', 'g'), ''), 'page') AS slug FROM pages""")
def slug_from_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slug(F.regexp_extract("html", r"(?is)<title>([^<]*)</title>", 1)).alias("slug"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(md, '!\[[^\]]*\]\(([^)\s]+)[^)]*\)', 1), ' ') AS refs FROM (SELECT doc_id, '![a](img/' || doc_id || '.png "t") ' || substring(text, 1, 50) || ' ![](x' || source || ')' AS md FROM documents)""")
def asset_refs(spark, sf):
    md = F.concat(F.lit("![a](img/"), F.col("doc_id").cast("string"), F.lit('.png "t") '), F.substring("text", 1, 50), F.lit(" ![](x"), "source", F.lit(")"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.image_refs(md), " ").alias("refs"))


@query("""SELECT page_id, pos, target FROM (SELECT page_id, unnest(h) AS target, CAST(unnest(range(len(h))) AS INTEGER) AS pos FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\\s*=\\s*"([^"]*)"', 1) AS h FROM pages))""".replace("\\\\", "\\"))
def link_targets(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(X.hrefs(F.col("html"))).alias("pos", "target"))


_UUID = "lower('ABCDEF00-0000-4000-8000-' || lpad(CAST({} AS VARCHAR), 12, '0'))"


@query("SELECT part_key, n, first FROM (SELECT p_partkey AS part_key, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS n, " + _UUID.format("p_partkey") + " AS first FROM part)")
def wiki_link_list(spark, sf):
    ident = lambda n: F.concat(F.lit("ABCDEF00-0000-4000-8000-"), F.lpad(n.cast("string"), 12, "0"))
    k = F.col("p_partkey")
    md = F.concat(F.lit("[see](wiki://"), ident(k), F.lit("#a) and wiki://"), F.when(k % 3 == 0, ident(k)).otherwise(ident(k + 1)), F.lit("."))
    found = X.link_targets(md)
    return table(spark, sf, "part").select(k.alias("part_key"), F.size(found).alias("n"), F.get(found, 0).alias("first"))


@query(r"""SELECT doc_id, round(len(regexp_extract_all(text, chr(65533))) / greatest(length(text), 1), 6) AS replacement_ratio,
  round((length(text) - len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'))) / greatest(length(text), 1), 6) AS printable_ratio,
  trim(text) != '' AND len(regexp_extract_all(text, chr(65533))) / greatest(length(text), 1) <= 0.01
  AND (length(text) - len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]'))) / greatest(length(text), 1) >= 0.85 AS passes FROM documents""")
def quality_gate(spark, sf):
    q = X.quality(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", q.alias("q")).select("doc_id", F.round("q.replacement_ratio", 6).alias("replacement_ratio"), F.round("q.printable_ratio", 6).alias("printable_ratio"), F.col("q.passes").alias("passes"))


@query(r"""SELECT event_id, regexp_replace('call with Bearer ' || lpad(CAST(user_id AS VARCHAR), 9, 'x') || ' for ' || event_type, '(?i)(?:sk-[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._~-]{8,})', '[REDACTED]', 'g') AS message, '[REDACTED]' AS api_key FROM events""")
def redact_secrets(spark, sf):
    message = F.concat(F.lit("call with Bearer "), F.lpad(F.col("user_id").cast("string"), 9, "x"), F.lit(" for "), "event_type")
    m = X.redacted_map(F.create_map(F.lit("message"), message, F.lit("apiKey"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", m["message"].alias("message"), m["apiKey"].alias("api_key"))


@query("SELECT doc_id, sha256(text) AS sha, md5(text) AS md5 FROM documents")
def content_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md5"))


@query(f"""WITH w AS (SELECT doc_id, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT doc_id, {words_sql('text')} AS l FROM documents)),
  once AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM (SELECT doc_id, w, min(p) AS p FROM w GROUP BY doc_id, w) GROUP BY doc_id)
  SELECT doc_id, sha256(concat_ws(chr(10), text, coalesce(t, ''), '')) AS sha FROM documents LEFT JOIN once USING (doc_id)""")
def searchable_text_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(X.searchable(F.col("text")), 256).alias("sha"))


@query("SELECT doc_id, substring(text, greatest(doc_id % 500 - 160, 0) + 1, greatest(least(doc_id % 500 + 30 + 160, length(text)) - greatest(doc_id % 500 - 160, 0), 0)) AS around FROM documents")
def context_slice(spark, sf):
    start = (F.col("doc_id") % 500).cast("int")
    return table(spark, sf, "documents").select("doc_id", X.context_slice(F.col("text"), start, start + 30).alias("around"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id END AS BIGINT) AS parsed FROM events")
def json_fallback(spark, sf):
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"id": '), e.cast("string"), F.lit("}")))
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.id", "bigint"), F.lit(-1)).cast("long").alias("parsed"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) || '_' || CAST(event_id % 7 AS VARCHAR) END AS code FROM events")
def error_code_extract(spark, sf):
    e = F.col("event_id")
    code = F.concat(F.upper("event_type"), F.lit("_"), (e % 7).cast("string"), F.when(e % 2 == 0, ": went wrong").otherwise(" went wrong"))
    return table(spark, sf, "events").select("event_id", X.error_code(code).alias("code"))


@query("SELECT item_id, text AS literal FROM benchmark")
def pdf_literals(spark, sf):
    """Texts written as string literals of a page's content, and read back."""
    escaped = F.regexp_replace("text", r"([()\\])", r"\\$1")
    page = F.concat(F.lit("BT /F1 12 Tf ("), escaped, F.lit(") Tj ET"))
    found = F.array_join(F.regexp_extract_all(page, F.lit(r"\(((?:[^()\\]|\\.)*)\)\s*Tj"), F.lit(1)), "")
    return table(spark, sf, "benchmark").select("item_id", F.regexp_replace(found, r"\\(.)", "$1").alias("literal"))


@query(f"SELECT doc_id, true AS within, true AS begins, true AS longest FROM documents WHERE {est_tokens_sql('text')} > 100")
def prefix_truncate(spark, sf):
    """Texts of more than 100 estimated tokens cut to that: the cut is within, begins the text, and one more character exceeds it."""
    texts = table(spark, sf, "documents").select("doc_id", "text").where(X.estimate_tokens(F.col("text")) > 100)
    cut = texts.withColumn("prefix", X.truncate_to_tokens(F.col("text"), F.lit(100)))
    more = F.substr("text", F.lit(1), F.length("prefix") + 1)
    return cut.select("doc_id", (X.estimate_tokens(F.col("prefix")) <= 100).alias("within"), F.col("text").startswith(F.col("prefix")).alias("begins"), ((X.estimate_tokens(more) > 100) | (F.length("prefix") == 400)).alias("longest"))


@query("SELECT l_orderkey AS order_key, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS modes FROM (SELECT l_orderkey, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS l FROM lineitem GROUP BY l_orderkey)")
def ordered_union(spark, sf):
    """First-seen order of distinct values, by group."""
    seen = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("v"))))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_join(F.array_distinct(F.transform(seen, lambda s: s["v"])), ",").alias("modes"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source)), 'tion and the') OR contains(lower(concat_ws(' ', CAST(doc_id AS VARCHAR), text, lang, source)), 'src7')")
def haystack_search(spark, sf):
    hay = F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), "text", "lang", "source"))
    return table(spark, sf, "documents").where(hay.contains("tion and the") | hay.contains("src7")).select("doc_id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '7') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def name_status_filter(spark, sf):
    return table(spark, sf, "customer").where(F.lower("c_name").contains("7") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_name")
