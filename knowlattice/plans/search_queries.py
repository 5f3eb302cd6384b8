"""Queries over keyword, vector and hybrid retrieval, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import evaluation, fusion, keyword, nearest
from ..operators import markdown as M
from ..sources.tables import kept, shared_folder, stored_once, table, version
from .registry import query
from .text_queries import bigrams_sql, query_terms_sql, words_sql

#: Bounds of a request.
QUERY_CHARS, MOST_RESULTS, MOST_TOKENS = 256, 20, 50_000


def _queries(spark, sf) -> DataFrame:
    """The benchmark's texts as queries, whole."""
    return table(spark, sf, "benchmark").select("item_id", "text", X.query_terms(X.nfkc("text")).alias("terms"))


_TERMS = f"list_concat({words_sql('text')}, {bigrams_sql('text')})"
_Q = f"q AS (SELECT item_id, text, {query_terms_sql('text')} AS terms FROM benchmark)"
_BM25 = f"""{_Q}, d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
sized AS (SELECT doc_id, len(t) AS len FROM d), stats AS (SELECT count(*) AS n, avg(len) AS average FROM sized),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wanted AS (SELECT item_id, unnest(terms) AS term FROM q),
scored AS (SELECT item_id, doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))) AS score
  FROM tf JOIN df USING (term) JOIN sized USING (doc_id) JOIN wanted USING (term), stats GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS keyword_rank FROM scored)"""


def _index(spark, sf) -> DataFrame:
    """The stored index of the documents, built when these files are first searched."""
    path = stored_once(spark, f"index-{version(spark, sf, 'documents')}", lambda p: keyword.build_index(_titled(spark, sf), p, title="title"))
    return keyword.read_index(spark, path)


def _best(spark, sf, k: int, rank: str = "rank") -> DataFrame:
    """Each query's k best, written once: few rows, so what they are joined with stays where it is."""
    return kept(keyword.top(keyword.best(_index(spark, sf), _queries(spark, sf), k), k, rank=rank), "best")


def _ranked(spark, sf, k: int) -> DataFrame:
    return _best(spark, sf, k).withColumnRenamed("key", "doc_id")


@query(f"WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents), tf AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(t) AS term FROM d)) SELECT term, count(*) AS df FROM tf GROUP BY term")
def postings_df(spark, sf):
    return keyword.document_frequencies(keyword.postings(table(spark, sf, "documents")))


@query(f"WITH {_BM25} SELECT item_id, doc_id, round(score, 6) AS score, CAST(keyword_rank AS INTEGER) AS rank FROM ranked WHERE keyword_rank <= 10")
def bm25_topk(spark, sf):
    return _ranked(spark, sf, 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _once_sql(c: str) -> str:
    return f"list_distinct(list_concat({words_sql(c)}, {bigrams_sql(c)}))"


_FLAT = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_TITLE = "substring(split_part({0}, chr(10), 1), 1, 80)"
_HITS = f"""hits AS (SELECT item_id, doc_id, n, count(*) AS matched FROM (SELECT DISTINCT doc_id, term FROM tf) JOIN (SELECT item_id, len(terms) AS n, unnest(terms) AS term FROM q) USING (term) GROUP BY ALL)"""
_MATCH = f"""{_HITS}, matches AS (SELECT item_id, doc_id, keyword_rank, matched, contains({_FLAT('d.text')}, {_FLAT('q.text')}) AS phrase, matched / n AS c, matched = n AS every,
  len(list_intersect(terms, {_once_sql(_TITLE.format('d.text'))})) / n AS t FROM hits JOIN ranked USING (item_id, doc_id) JOIN documents d USING (doc_id) JOIN q USING (item_id) WHERE keyword_rank <= 400),
match_scores AS (SELECT item_id, doc_id, keyword_rank, matched, phrase, least(1.0, 0.4 * c + 0.2 * t + CASE WHEN phrase THEN 0.25 ELSE 0 END + CASE WHEN every THEN 0.15 ELSE 0 END) AS match_score FROM matches)"""


def _titled(spark, sf) -> DataFrame:
    """Documents with a title: the first 80 characters of their first line."""
    return table(spark, sf, "documents").select("doc_id", "text", F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"))


def _matched(spark, sf, k: int) -> DataFrame:
    found = _best(spark, sf, k, "keyword_rank")
    return keyword.match_scores(found, _titled(spark, sf), _queries(spark, sf), title="title").withColumnRenamed("key", "doc_id")


@query(f"WITH {_BM25}, {_MATCH} SELECT item_id, doc_id, round(match_score, 6) AS match_score, matched, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(match_score, 9) DESC, doc_id) AS INTEGER) AS rank FROM match_scores WHERE keyword_rank <= 200) WHERE rank <= 10")
def match_score_topk(spark, sf):
    """The 200 best by BM25, ordered anew by match score."""
    found = keyword.top(_matched(spark, sf, 200), 10, key="doc_id", score="match_score")
    return found.select("item_id", "doc_id", F.round("match_score", 6).alias("match_score"), "matched", "rank")


@query(f"WITH {_BM25}, {_HITS} SELECT item_id, doc_id FROM hits JOIN documents d USING (doc_id) JOIN q USING (item_id) WHERE contains({_FLAT('d.text')}, {_FLAT('q.text')})")
def phrase_hits(spark, sf):
    return keyword.phrase_hits(keyword.best(_index(spark, sf), _queries(spark, sf), missing=2), _titled(spark, sf), _queries(spark, sf), title="title")


@query(rf"""WITH {_BM25}, best AS (SELECT item_id, doc_id FROM ranked WHERE keyword_rank <= 3),
found AS (SELECT item_id, doc_id, d.text, list_filter(list_transform(terms, lambda t: instr(trim(regexp_replace(lower(d.text), '\s+', ' ', 'g')), t)), lambda p: p > 0) AS places FROM best JOIN documents d USING (doc_id) JOIN q USING (item_id)),
s AS (SELECT item_id, doc_id, text, greatest(coalesce(places[1], 1) - 1 - 120, 0) AS st FROM found)
SELECT item_id, doc_id, CASE WHEN length(text) <= 360 THEN text ELSE concat(CASE WHEN st > 0 THEN '…' ELSE '' END, substring(text, st + 1, 360), CASE WHEN st + 360 < length(text) THEN '…' ELSE '' END) END AS snippet FROM s""")
def snippets(spark, sf):
    best = _ranked(spark, sf, 3).select("item_id", "doc_id")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    found = best.join(docs, "doc_id").join(_queries(spark, sf).select("item_id", "terms"), "item_id")
    return found.select("item_id", "doc_id", X.snippet(F.col("content"), F.col("terms")).alias("snippet"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id, list_cosine_similarity(q, embedding::DOUBLE[]) AS cosine FROM q, embeddings)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, vec_id) AS INTEGER) AS rank FROM c) WHERE rank <= 10""")
def cosine_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest.cosine_topk(vectors, asked, 10, "vec_id", "query_id").withColumn("cosine", F.round("cosine", 6))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 3 != 0 AND vec_id % 5 != 0 AND vec_id % 7 != 0")
def compatible_vectors(spark, sf):
    """Stored vectors of the query's provider, model and size that are ready."""
    k = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.when(k % 2 == 1, "local").otherwise("mock").alias("provider"), F.when(k % 3 == 0, "old").otherwise("m1").alias("model"), F.when(k % 5 == 0, "failed").otherwise("ready").alias("status"),
        F.when(k % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
    )
    return V.compatible(rows, "local", "m1", 64).select("vec_id", "label")


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN embedding[1:60] WHEN vec_id % 17 = 0 THEN list_transform(embedding, lambda x: 0.0) ELSE embedding END::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, CASE WHEN a.e IS NULL OR b.e IS NULL OR len(a.e) != len(b.e) THEN NULL WHEN list_max(list_transform(a.e, lambda x: abs(x))) = 0 OR list_max(list_transform(b.e, lambda x: abs(x))) = 0 THEN 0.0 ELSE round(list_cosine_similarity(a.e, b.e), 6) END AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""")
def cosine_of_pairs(spark, sf):
    """Cosines of neighbours, some of them missing, of another length or without length."""
    k, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    bent = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, F.slice(v, 1, 60)).when(k % 17 == 0, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    rows = table(spark, sf, "embeddings").select("vec_id", bent.alias("e"))
    both = rows.join(rows.select((k - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return both.select("vec_id", F.round(V.cosine(F.col("e"), F.col("f")), 6).alias("cosine"))


def _hash_sql(source: str, key: str, dims: int) -> str:
    return f"""(WITH parts AS (SELECT {key}, sha256(term) AS h, n FROM (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest({_TERMS}) AS term FROM {source}) GROUP BY ALL)),
  signed AS (SELECT {key}, CAST('0x' || h[1:8] AS BIGINT) % {dims} AS a, CAST('0x' || h[11:18] AS BIGINT) % {dims} AS b, n * CASE WHEN CAST('0x' || h[10:10] AS INTEGER) % 2 = 1 THEN -1.0 ELSE 1.0 END AS s FROM parts),
  places AS (SELECT {key}, slot, sum(w) AS w FROM (SELECT {key}, a AS slot, s AS w FROM signed UNION ALL SELECT {key}, b, s * 0.5 FROM signed) GROUP BY ALL),
  full_ AS (SELECT k.{key}, list(coalesce(CAST(w AS DOUBLE), 0.0) ORDER BY i) AS v FROM {source} k CROSS JOIN range({dims}) r(i) LEFT JOIN places p ON p.{key} = k.{key} AND p.slot = r.i GROUP BY k.{key})
  SELECT {key}, list_transform(v, lambda x: CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0 THEN x / sqrt(list_sum(list_transform(v, lambda y: y * y))) ELSE x END) AS embedding FROM full_)"""


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS i, round(embedding[i + 1], 6) AS value FROM {_hash_sql('documents', 'doc_id', 32)}, range(32) r(i)")
def hash_embedding(spark, sf):
    made = V.hash_embedding(table(spark, sf, "documents"), "doc_id", "text")
    return made.select("doc_id", F.posexplode("embedding").alias("i", "value")).withColumn("value", F.round("value", 6))


@query("""SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'dimensions_out_of_range' WHEN vec_id % 11 = 0 THEN 'all_zero' WHEN vec_id % 13 = 0 THEN 'dimensions_differ' END AS problem FROM embeddings""")
def vector_validation(spark, sf):
    v = F.col("embedding").cast("array<double>")
    bent = F.when(F.col("vec_id") % 7 == 0, F.slice(v, 1, 3)).when(F.col("vec_id") % 11 == 0, F.array_repeat(F.lit(0.0), 64)).when(F.col("vec_id") % 13 == 0, F.slice(v, 1, 60)).otherwise(v)
    return table(spark, sf, "embeddings").select("vec_id", V.problem(bent, 64).alias("problem"))


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))")
def normalize_l2(spark, sf):
    u = V.unit(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.dot(u, u), 6).alias("length"), F.round(F.get(u, 0), 6).alias("first"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents), first AS (SELECT sha, min(doc_id) AS owner, count(*) AS uses FROM h GROUP BY sha)
SELECT doc_id, owner AS reused_from, doc_id != owner AS cached FROM h JOIN first USING (sha)""")
def embedding_cache_hits(spark, sf):
    """Whose stored vector each document reuses: the first one with the same input hash."""
    hashed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    owners = hashed.groupBy("sha").agg(F.min("doc_id").alias("reused_from"))
    return hashed.join(owners, "sha").select("doc_id", "reused_from", (F.col("doc_id") != F.col("reused_from")).alias("cached"))


DIMS = 64
_VECTOR = f"""dv AS {_hash_sql('documents', 'doc_id', DIMS)}, qv AS {_hash_sql('benchmark', 'item_id', DIMS)},
cosines AS (SELECT item_id, doc_id, CASE WHEN list_max(list_transform(dv.embedding, lambda x: abs(x))) = 0 THEN 0.0 ELSE list_cosine_similarity(qv.embedding, dv.embedding) END AS cosine FROM qv, dv WHERE list_max(list_transform(qv.embedding, lambda x: abs(x))) > 0),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cosine, 9) DESC, doc_id) AS vector_rank FROM cosines) WHERE vector_rank <= 200)"""
_FUSED = f"""{_BM25}, {_VECTOR}, {_MATCH},
kw AS (SELECT item_id, doc_id, keyword_rank, match_score AS keyword_score FROM match_scores),
fused AS (SELECT item_id, doc_id, keyword_rank, keyword_score, vector_rank, cosine, coalesce(1.0 / (10 + keyword_rank), 0.0) + coalesce(1.0 / (10 + vector_rank), 0.0) AS rrf, coalesce(keyword_score, greatest(0.0, least(1.0, (cosine + 1) / 2)), 0.0) AS normalised FROM kw FULL JOIN vec USING (item_id, doc_id)),
placed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, doc_id) AS rank FROM fused) WHERE rank <= 10)"""


def fused(spark, sf, k: int = 10) -> DataFrame:
    """Hybrid results for each benchmark query: BM25 ranks with match scores, cosine of hash embeddings, fused.

    Texts are taken apart once, into an index that BM25 and the embeddings both read.
    """
    asked = _queries(spark, sf)
    indexed = _index(spark, sf)
    found = _best(spark, sf, 400, "keyword_rank")
    words = keyword.match_scores(found, _titled(spark, sf), asked, title="title").select("item_id", F.col("key").alias("doc_id"), "keyword_rank", F.col("match_score").alias("keyword_score"))
    vectors = V.hash_embedding(indexed.select(F.col("key").alias("doc_id"), "terms"), "doc_id", None, DIMS)
    near = nearest.cosine_topk(vectors, V.hash_embedding(asked.select("item_id", "text"), "item_id", "text", DIMS), 200, "doc_id", "item_id").withColumnRenamed("rank", "vector_rank")
    return fusion.fuse(words, near, k)


@query(f"WITH {_FUSED} SELECT item_id, doc_id, CAST(keyword_rank AS INTEGER) AS keyword_rank, CAST(vector_rank AS INTEGER) AS vector_rank, round(rrf, 6) AS rrf, CAST(rank AS INTEGER) AS rank FROM placed")
def rrf_fusion(spark, sf):
    return fused(spark, sf).select("item_id", "doc_id", "keyword_rank", "vector_rank", F.round("rrf", 6).alias("rrf"), "rank")


@query(f"WITH {_FUSED} SELECT item_id, doc_id, round(normalised, 6) AS normalised, keyword_score IS NULL AS vector_only FROM placed")
def normalized_score(spark, sf):
    return fused(spark, sf).select("item_id", "doc_id", F.round("normalised", 6).alias("normalised"), F.col("keyword_score").isNull().alias("vector_only"))


_GATED = """gated AS (SELECT *, s - lead(s, 1, 0.0) OVER (PARTITION BY item_id ORDER BY rank) AS margin FROM (SELECT *, coalesce(keyword_score, normalised) AS s FROM placed))"""


@query(f"WITH {_FUSED}, {_GATED} SELECT item_id, doc_id, round(margin, 6) AS margin, reason, reason IS NULL AS passes FROM (SELECT *, CASE WHEN keyword_rank IS NULL THEN 'no_keyword_rank' WHEN round(s, 9) < 0.7 THEN 'score_below_min' WHEN round(margin, 9) < 0.1 THEN 'margin_below_min' END AS reason FROM gated)")
def seed_gate(spark, sf):
    return fusion.gate(fused(spark, sf)).select("item_id", "doc_id", F.round("margin", 6).alias("margin"), "reason", "passes")


@query(f"WITH {_BM25} SELECT item_id, doc_id, CAST(keyword_rank AS INTEGER) AS rank, round(1.0 / (10 + keyword_rank), 6) AS rrf, 'no_embeddings' AS vector_status FROM ranked WHERE keyword_rank <= 10")
def degraded_mode(spark, sf):
    """Without any vectors the results are the keyword ones, and say so."""
    words = _ranked(spark, sf, 400).select("item_id", "doc_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    none = spark.createDataFrame([], "item_id long, doc_id long, vector_rank int, cosine double")
    return fusion.fuse(words, none, 10).select("item_id", "doc_id", "rank", F.round("rrf", 6).alias("rrf"), F.lit("no_embeddings").alias("vector_status"))


@query(f"""WITH {_FUSED} SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(rrf, 6) AS rrf, round(normalised, 6) AS score, sha256(d.text) AS content_sha FROM placed JOIN documents d USING (doc_id)""")
def hybrid_search(spark, sf):
    """The flagship: ten best documents for each benchmark query."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha"))
    return fused(spark, sf).join(docs, "doc_id").select("item_id", "doc_id", "rank", F.round("rrf", 6).alias("rrf"), F.round("normalised", 6).alias("score"), "content_sha")


def _judged(spark, sf, stated: DataFrame) -> DataFrame:
    """(item_id, doc_id, grade): 2 holds the whole item, 1 its first 40 characters, 0 ``stated`` negatives (item_id, doc_id)."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    held = evaluation.passages(docs, items.select("item_id", F.col("text").alias("item")), 40)
    return held.unionByName(stated.select("item_id", "doc_id", F.lit(0).alias("grade"))).groupBy("item_id", "doc_id").agg(F.max("grade").alias("grade"))


def qrels(spark, sf) -> DataFrame:
    """Judgments that the metrics read: each document is a stated negative of at most one item."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return _judged(spark, sf, docs.select("doc_id", (F.col("doc_id") % 997).alias("item_id")).join(items.select("item_id"), "item_id"))


def all_qrels(spark, sf) -> DataFrame:
    """All judgments: stated negatives are the pairs of equal ids modulo 97."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return _judged(spark, sf, docs.select("doc_id", (F.col("doc_id") % 97).alias("r")).join(items.select("item_id", (F.col("item_id") % 97).alias("r")), "r"))


_JUDGED = """qrels AS (SELECT * FROM (SELECT item_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 2 WHEN contains(d.text, substring(b.text, 1, 40)) THEN 1 WHEN {0} THEN 0 END AS grade FROM documents d, benchmark b) WHERE grade IS NOT NULL)"""
_QRELS, _ALL_QRELS = _JUDGED.format("doc_id % 997 = item_id"), _JUDGED.format("doc_id % 97 = item_id % 97")


@query(f"WITH {_ALL_QRELS} SELECT item_id, doc_id, CAST(grade AS INTEGER) AS grade FROM qrels")
def qrels_build(spark, sf):
    return all_qrels(spark, sf)


_METRICS = f"""{_BM25}, {_QRELS}, top AS (SELECT item_id, doc_id, keyword_rank AS rank FROM ranked WHERE keyword_rank <= 10), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
rel AS (SELECT item_id, k, n, sum(CASE WHEN r <= k THEN grade / log2(r + 1) END) AS ideal FROM (SELECT item_id, grade, row_number() OVER (PARTITION BY item_id ORDER BY grade DESC, doc_id) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM qrels WHERE grade > 0), ks GROUP BY item_id, k, n),
agg AS (SELECT item_id, k, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS hits, min(CASE WHEN grade > 0 THEN rank END) AS first, sum(CASE WHEN grade > 0 THEN grade / log2(rank + 1) ELSE 0 END) AS dcg, count(grade) AS judged, count(*) AS returned FROM top LEFT JOIN qrels USING (item_id, doc_id), ks WHERE rank <= k GROUP BY item_id, k),
per AS (SELECT item_id, k, coalesce(hits / n, 0.0) AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate, coalesce(1.0 / first, 0.0) AS mrr, coalesce(dcg / ideal, 0.0) AS ndcg, coalesce(judged / returned, 0.0) AS judged FROM rel LEFT JOIN agg USING (item_id, k))"""


def _per_query(spark, sf) -> DataFrame:
    return evaluation.metrics(_ranked(spark, sf, 10), kept(qrels(spark, sf), "qrels"))


def _metric(name: str):
    def builder(spark, sf):
        return _per_query(spark, sf).select("item_id", "k", F.round(name, 6).alias(name))

    builder.__name__ = f"metric_{name}"
    query(f"WITH {_METRICS} SELECT item_id, CAST(k AS INTEGER) AS k, CAST(round({name}, 6) AS DOUBLE) AS {name} FROM per")(builder)


for _name in ("recall", "hit_rate", "mrr", "ndcg", "judged"):
    _metric(_name)


@query(f"WITH {_METRICS} SELECT CAST(k AS INTEGER) AS k, round(avg(recall), 6) AS recall, round(avg(hit_rate), 6) AS hit_rate, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(judged), 6) AS judged FROM per GROUP BY k")
def metric_grid_macro(spark, sf):
    found = evaluation.macro(_per_query(spark, sf))
    return found.select("k", *[F.round(c, 6).alias(c) for c in found.columns if c != "k"])


_BUCKETS = ["0", "0-25%", "25-50%", "50-75%", "75-99%", "100%"]


@query(f"""WITH {_METRICS}, b AS (SELECT CASE WHEN recall = 0 THEN '0' WHEN recall <= 0.25 THEN '0-25%' WHEN recall <= 0.5 THEN '25-50%' WHEN recall <= 0.75 THEN '50-75%' WHEN recall < 1 THEN '75-99%' ELSE '100%' END AS bucket FROM per WHERE k = 10)
SELECT n.bucket, count(b.bucket) AS queries FROM (SELECT unnest({_BUCKETS}) AS bucket) n LEFT JOIN b USING (bucket) GROUP BY n.bucket""")
def score_histogram(spark, sf):
    r = F.col("recall")
    bucket = F.when(r == 0, "0").when(r <= 0.25, "0-25%").when(r <= 0.5, "25-50%").when(r <= 0.75, "50-75%").when(r < 1, "75-99%").otherwise("100%")
    counted = _per_query(spark, sf).where("k = 10").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, _BUCKETS))).alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("queries"))


@query(f"WITH {_METRICS} SELECT b.item_id, CASE WHEN recall IS NULL THEN 'missing' WHEN recall = 1 THEN 'perfect' WHEN recall > 0 THEN 'partial' ELSE 'miss' END AS status FROM benchmark b LEFT JOIN (SELECT * FROM per WHERE k = 10) p USING (item_id)")
def query_status(spark, sf):
    r = F.col("recall")
    status = F.when(r.isNull(), "missing").when(r == 1, "perfect").when(r > 0, "partial").otherwise("miss")
    return table(spark, sf, "benchmark").select("item_id").join(_per_query(spark, sf).where("k = 10"), "item_id", "left").select("item_id", status.alias("status"))


@query(f"WITH {_METRICS} SELECT item_id, CAST(coalesce(sum(CASE WHEN grade > 0 THEN 1 END), 0) AS BIGINT) AS hit, count(grade) AS judged, count(*) AS returned FROM top LEFT JOIN qrels USING (item_id, doc_id) GROUP BY item_id")
def query_detail_counts(spark, sf):
    found = _ranked(spark, sf, 10).join(qrels(spark, sf), ["item_id", "doc_id"], "left")
    return found.groupBy("item_id").agg(F.count_if(F.col("grade") > 0).alias("hit"), F.count("grade").alias("judged"), F.count("*").alias("returned"))


@query(f"WITH {_ALL_QRELS} SELECT count(DISTINCT item_id) AS queries, count(*) AS judgments, count(*) FILTER (grade > 0) AS relevant FROM qrels")
def qrel_counts(spark, sf):
    return all_qrels(spark, sf).agg(F.countDistinct("item_id").alias("queries"), F.count("*").alias("judgments"), F.count_if(F.col("grade") > 0).alias("relevant"))


@query(f"WITH {_QRELS} SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM qrels WHERE grade > 0)")
def missing_judgments(spark, sf):
    return table(spark, sf, "benchmark").select("item_id").join(qrels(spark, sf).where("grade > 0"), "item_id", "left_anti")


@query(f"WITH {_FUSED} SELECT count(*) AS returned, count(*) FILTER (keyword_rank IS NULL) AS without_keyword, count(*) FILTER (vector_rank IS NULL) AS without_vector FROM placed")
def channel_coverage(spark, sf):
    return fused(spark, sf).agg(F.count("*").alias("returned"), F.count_if(F.col("keyword_rank").isNull()).alias("without_keyword"), F.count_if(F.col("vector_rank").isNull()).alias("without_vector"))


_BENT = """bent AS (SELECT item_id, CASE WHEN item_id % 5 = 0 AND keyword_rank = 3 THEN 4 ELSE keyword_rank END AS rank, CASE WHEN item_id % 7 = 0 AND keyword_rank <= 2 THEN -1 ELSE doc_id END AS doc_id, CASE WHEN item_id % 3 = 0 AND keyword_rank = 1 THEN NULL ELSE score END AS score FROM ranked WHERE keyword_rank <= 10)"""


@query(f"""WITH {_BM25}, {_BENT}, per AS (SELECT item_id, count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT rank) AS ranks, count(score) AS scores FROM bent GROUP BY item_id)
SELECT item_id, 'duplicate_id' AS rule FROM per WHERE ids < n UNION ALL SELECT item_id, 'rank_gap' FROM per WHERE ranks < n UNION ALL SELECT item_id, 'score_not_finite' FROM per WHERE scores < n""")
def v_ranking(spark, sf):
    """The rules that a ranking with planted faults breaks."""
    item, rank = F.col("item_id"), F.col("rank")
    bent = _ranked(spark, sf, 10).select(
        "item_id",
        F.when((item % 5 == 0) & (rank == 3), 4).otherwise(rank).alias("rank"),
        F.when((item % 7 == 0) & (rank <= 2), -1).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when((item % 3 == 0) & (rank == 1), F.lit(None).cast("double")).otherwise(F.col("score")).alias("score"),
    )
    return evaluation.ranking_violations(bent)


@query(rf"""WITH {_BM25}, best AS (SELECT item_id, doc_id FROM ranked WHERE keyword_rank <= 10), page AS (SELECT DISTINCT doc_id FROM best),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents JOIN page USING (doc_id)),
of_ AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^#{{1,6}}\s+\S') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o FROM ln),
bl AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS INTEGER) AS block, string_agg(l, chr(10) ORDER BY i) AS text FROM of_ GROUP BY doc_id, o HAVING o > 0 OR bool_or(trim(l) != '')),
bt AS (SELECT DISTINCT doc_id, block, unnest({_TERMS}) AS term FROM bl)
SELECT DISTINCT item_id, doc_id, block FROM best JOIN bt USING (doc_id) JOIN wanted USING (item_id, term)""")
def matched_blocks(spark, sf):
    """(item_id, doc_id, block): of each query's ten best documents the Markdown blocks that hold a term of it."""
    best = _ranked(spark, sf, 10).select("item_id", "doc_id")
    pages = table(spark, sf, "documents").join(best.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    content = F.expr("substring(text, cast(start as int) + 1, cast(end - start as int))")
    blocks = M.blocks(pages, "doc_id").join(pages, "doc_id").select("doc_id", F.col("ordinal").alias("block"), F.explode(F.array_distinct(X.terms(X.nfkc(content)))).alias("term"))
    asked = _queries(spark, sf).select("item_id", F.explode("terms").alias("term"))
    return best.join(blocks, "doc_id").join(asked, ["item_id", "term"]).select("item_id", "doc_id", "block").distinct()


@query(f"""SELECT item_id, CASE WHEN trim(text) = '' THEN 'query_empty' WHEN length(text) > {QUERY_CHARS} THEN 'query_too_long' WHEN item_id % 30 NOT BETWEEN 1 AND {MOST_RESULTS} THEN 'results_out_of_range'
WHEN (item_id % 7) * 10000 NOT BETWEEN 1 AND {MOST_TOKENS} THEN 'tokens_out_of_range' END AS refused FROM benchmark""")
def request_bounds(spark, sf):
    """Which requests are refused, and why; none is cut to fit."""
    asked = table(spark, sf, "benchmark").select("item_id", "text", (F.col("item_id") % 30).alias("top_k"), (F.col("item_id") % 7 * 10000).alias("token_budget"))
    return asked.select("item_id", fusion.refused(F.col("text"), F.col("top_k"), F.col("token_budget"), QUERY_CHARS, MOST_RESULTS, MOST_TOKENS).alias("refused"))


@query(f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 1 THEN text || ' newly added words' ELSE text END AS text FROM documents WHERE doc_id % 50 != 3))
SELECT doc_id, CAST(len(t) AS INTEGER) AS len, md5(array_to_string(list_sort(t), ' ')) AS terms FROM d""")
def index_projection(spark, sf):
    """A stored index after some documents were changed and some removed: only their parts are written again."""
    path = f"{shared_folder(spark, 'projected_index')}"
    docs = _titled(spark, sf)
    keyword.build_index(docs, path, title="title")
    changed = docs.where("doc_id % 50 = 1").withColumn("text", F.concat("text", F.lit(" newly added words")))
    keyword.project(path, changed, docs.where("doc_id % 50 = 3"), title="title")
    return keyword.read_index(spark, path).select(F.col("key").alias("doc_id"), "len", F.md5(F.array_join(F.array_sort("terms"), " ")).alias("terms"))


@query(f"""WITH {_BM25}, b AS (SELECT item_id, doc_id, terms AS wa, list_distinct({_TERMS.replace('text', 'd.text')}) AS wb FROM ranked JOIN documents d USING (doc_id) JOIN q USING (item_id) WHERE keyword_rank <= 10)
SELECT item_id, doc_id, array_to_string(list_filter(wa, lambda x, i: list_contains(wb, x)), ' ') AS matched, array_to_string(list_filter(wa, lambda x, i: NOT list_contains(wb, x)), ' ') AS missing FROM b""")
def term_set_ops(spark, sf):
    """Which terms of a query each of its ten best documents holds, and which it lacks."""
    docs = table(spark, sf, "documents").select("doc_id", X.words_and_bigrams_once(X.nfkc("text")).alias("wb"))
    found = _ranked(spark, sf, 10).select("item_id", "doc_id").join(docs, "doc_id").join(_queries(spark, sf).select("item_id", F.col("terms").alias("wa")), "item_id")
    return found.select("item_id", "doc_id", F.array_join(F.array_intersect("wa", "wb"), " ").alias("matched"), F.array_join(F.array_except("wa", "wb"), " ").alias("missing"))
