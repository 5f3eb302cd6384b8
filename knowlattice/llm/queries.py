"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, lm, packing, pii, runs, sharding, simhash, spelling, substrings, tokens, toxicity, urlfilter
from .common import table


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
found AS (SELECT doc_id, i, grams.m AS m, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.m = windows.m),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op2_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op3_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shuffle_into_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep_text=False)


def op7_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.knowlattice.surrogateKey", pii.KEY)
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)


def op9_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, keep_text=False)


#: (verdict, host, path) as op10's contract lists them; ``OP10_SQL`` still has the words of ``urlfilter.RULES``.
OP10_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op10_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), OP10_RULES).drop("url", "html")


def op11_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _with_periodic_words(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) where every tenth text, by the CRC of its id, repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    n = F.size("_w")
    placed = words.withColumn("_n", n).withColumn("_a", (F.col("_g") % F.nullif("_n", F.lit(0))).cast("int"))
    placed = placed.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.expr("cast((_n - _a) div _p + 1 as int)")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), F.col("_n") - F.col("_a"))), " ")
    return placed.select("doc_id", F.when(F.col("_n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _with_periodic_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.find_runs(docs, keep_text=False)
    better = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)  # noqa: E731  runs come by start and period
    found = found.withColumn("best", F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better))
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _with_lost_letters(words: DataFrame) -> DataFrame:
    """``words`` (doc_id, word) where one in 97, by the CRC of id and word, lacks a letter; those without id stay as they are."""
    h = words.withColumn("_h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word")))
    return h.select(F.expr("CASE WHEN _h % 97 = 0 THEN overlay(word PLACING '' FROM cast(_h % length(word) as int) + 1 FOR 1) ELSE word END").alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.occurrences(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.vocabulary(_with_lost_letters(words)))


def _address_sql(url: str) -> str:
    host = f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = f"coalesce(regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1), '')"
    return f"{host} AS host, {path} AS path, concat(regexp_replace({host}, '^www\\.', ''), regexp_replace({path}, '/+$', ''), {query}) AS address"


OP10_SQL = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {", ".join(str(r) for r in urlfilter.RULES)}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
found AS (
  SELECT url, coalesce(
    CASE WHEN regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) END,
    CASE WHEN regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END) AS too FROM tags),
targets AS (
  SELECT url, CASE WHEN contains(too, '://') THEN too WHEN starts_with(too, '//') THEN 'http:' || too
    WHEN starts_with(too, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || too
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || CASE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)', 1) END || too END AS target
  FROM found WHERE too IS NOT NULL AND too != ''),
p AS (SELECT page_id, url, {_address_sql("url")} FROM pages),
t AS (SELECT target, {_address_sql("target")} FROM targets),
s AS (SELECT url, {_address_sql("url")} FROM targets),
e AS (SELECT s.address AS a, t.address AS b FROM targets JOIN s USING (url) JOIN t USING (target)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
fits AS (
  SELECT n.host, n.path, r.verdict, r.h || r.p AS rule, row_number() OVER (PARTITION BY n.host, n.path ORDER BY length(r.h || r.p) DESC) AS k
  FROM (SELECT host, path FROM p UNION SELECT host, path FROM t) n JOIN rules r ON (n.host = r.h OR suffix(n.host, '.' || r.h)) AND starts_with(n.path, r.p)),
best AS (SELECT * FROM fits WHERE k = 1),
seeds AS (
  SELECT address, max(verdict = 'allow') AS allow, max(verdict = 'block') AS block
  FROM (SELECT host, path, address FROM p WHERE url IS NOT NULL UNION SELECT host, path, address FROM t) JOIN best USING (host, path) GROUP BY address),
near AS (SELECT address AS a, address AS b FROM p WHERE url IS NOT NULL UNION SELECT a, b FROM reach),
inherited AS (SELECT a, max(allow) AS allow, max(block) AS block FROM near JOIN seeds ON b = address GROUP BY a)
SELECT page_id, p.host, p.path, rule, coalesce(best.verdict, CASE WHEN url IS NOT NULL AND inherited.block AND NOT inherited.allow THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (host, path) LEFT JOIN inherited ON p.address = inherited.a
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_fm_index_decontamination": OP1_SQL, "op10_redirect_equivalence": OP10_SQL}
