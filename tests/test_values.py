"""Results of single rules, with expectations written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from knowlattice.functions import text as X
from knowlattice.functions import vectors as V
from knowlattice.operators import evaluation, fusion, keyword, markdown, nearest
from knowlattice.operators import lifecycle as L
from knowlattice.operators import segments as S


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_token_estimates(spark):
    rows = [("",), (None,), ("a b c",), ("hello world",), ("知识库",), ("go 🚀!",), ("a_b_c ",), ("x  \n y",), ("ℹ",), ("→",), ("abcde",)]
    got = [n for (n,) in values(spark, rows, "t string", X.estimate_tokens(F.col("t")))]
    assert got == [0, 0, 5, 5, 3, 5, 6, 3, 2, 1, 2]


def test_truncation(spark):
    texts = ["a_b_c " * 300, " " * 900, "short", None, "字" * 20, "abcdefghij"]
    got = [r for (r,) in values(spark, [(t,) for t in texts], "t string", X.truncate_to_tokens(F.col("t"), F.lit(2)))]
    assert got == ["a_", " " * 900, "short", None, "字字", "abcdefgh"]


@pytest.mark.parametrize("task, embedding, error, fits, want", [
    ("running", "ready", None, True, "running"), ("failed", "ready", None, True, "ready"), ("failed", None, "TASK_CANCELLED", False, "cancelled"),
    ("failed", None, None, False, "failed"), (None, "failed", "X", True, "failed"), (None, "ready", None, False, "missing"), ("succeeded", None, None, False, "missing"), (None, None, None, None, "missing"),
])
def test_item_status(spark, task, embedding, error, fits, want):
    got = values(spark, [(task, embedding, error, fits)], "task string, embedding string, error string, fits boolean", L.item_status(*map(F.col, ("task", "embedding", "error", "fits"))))
    assert got == [(want,)]


@pytest.mark.parametrize("run, enabled, counts, want", [
    ("superseded", False, (3, 3, 0, 0, 0, 0), "superseded"), ("failed", True, (3, 3, 0, 0, 0, 0), "failed"), ("indexed", False, (3, 3, 0, 0, 0, 0), "disabled"), ("pending", True, (0, 0, 0, 0, 0, 0), "pending"),
    ("indexed", True, (3, 1, 1, 0, 0, 1), "running"), ("indexed", True, (3, 3, 0, 0, 0, 0), "completed"), ("indexed", True, (3, 1, 0, 0, 0, 2), "degraded"), ("indexed", True, (3, 0, 0, 1, 0, 2), "failed"),
    ("indexed", True, (3, 0, 0, 0, 3, 0), "cancelled"), ("indexed", True, (0, 0, 0, 0, 0, 0), "integrity_warning"),
])
def test_run_status(spark, run, enabled, counts, want):
    names = ["run", "enabled", "total", "ready", "pending", "failed", "cancelled", "missing"]
    got = values(spark, [(run, enabled, *counts)], "run string, enabled boolean, total int, ready int, pending int, failed int, cancelled int, missing int", L.run_status(*map(F.col, names)))
    assert got == [(want,)]


def test_line_classes(spark):
    text = "# H\n| A1 | B2 |\nABC é DEF\nABC É DEF\n第三章 总则\n1.2 Part\n---\n```\n# no\n```\na | b\nx|y"
    got = {r.line_text: (r.heading, r.marker, r.table, r.code) for r in S.classified(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).where("doc_id = 1").collect()}
    assert got["| A1 | B2 |"] == (False, True, True, False)
    assert got["ABC é DEF"] == (False, False, False, False) and got["ABC É DEF"][1] and got["第三章 总则"][1] and got["1.2 Part"][1] and got["---"][1]
    assert got["# H"] == (True, False, False, False) and got["# no"] == (False, False, False, True) and got["a | b"][2] and not got["x|y"][2]


def test_repeated_and_null_keys_in_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "alpha gamma"), (None, "alpha"), (5, None), (6, "")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha beta", ["alpha", "beta"])], "item_id long, text string, terms array<string>")
    scored = keyword.bm25(keyword.index(docs), queries).collect()
    assert sorted((r.key is None, r.key or 0, r.matched) for r in scored) == [(False, 1, 2), (False, 1, 2), (False, 2, 1), (True, 0, 1)]
    one, other = [r.score for r in scored if r.key == 1]
    assert one == other
    vectors = V.hash_embedding(docs, "doc_id", "text")
    assert vectors.count() == 6 and all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 or not any(r.embedding) for r in vectors.collect())
    best = nearest.cosine_topk(vectors, V.hash_embedding(queries, "item_id", "text"), 3, "doc_id", "item_id").collect()
    assert [r["rank"] for r in sorted(best, key=lambda r: r["rank"])] == [1, 2, 3]
    titled = docs.withColumn("title", F.lit("Beta"))
    matched = keyword.match_scores(keyword.bm25(keyword.index(titled, title="title"), queries), titled, queries, title="title").where("key = 1").first()
    assert abs(matched.match_score - (0.4 + 0.1 + 0.25 + 0.15)) < 1e-9 and matched.phrase
    assert keyword.bm25(keyword.index(docs.limit(0)), queries).count() == 0


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([float("nan")], [1.0]), ([None], [1.0]), ([float("inf")], [1.0])]
    got = values(spark, rows, "a array<double>, b array<double>", V.cosine(F.col("a"), F.col("b")))
    assert [None if g[0] is None else round(g[0], 9) for g in got] == [0.0, round(11 / 125**0.5, 9), 0.0, None, None, None, None, None, None]


@pytest.mark.parametrize("block", [500, 1])
def test_passages_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(evaluation, "BLOCK", block)
    docs = [(1, "so the quick brown fox jumps over it"), (2, "the quick brown fox jumps over the lazy dog today"), (3, None), (4, "quick brown"), (5, "xabcdefghijy")]
    items = [(0, "the quick brown fox jumps over the lazy dog"), (1, "abcdefghij"), (2, None), (3, "fox"), (4, "today")]
    got = evaluation.passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"), 25).collect()
    want = {(i, d, 2 if item in t else 1) for i, item in items if item for d, t in docs if t and item[:25] in t}
    assert {tuple(r) for r in got} == want


def test_each_row_is_scored_by_its_own_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta and nothing"), (None, "alpha beta gamma"), (2, "x " * 300 + "abc")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "alpha beta gamma", ["alpha", "beta", "gamma"]), (1, "q " * 300 + "abc", ["q", "abc"])], "item_id long, text string, terms array<string>")
    scored = keyword.bm25(keyword.index(docs), queries)
    got = sorted((r.item_id, r.key or 0, r.matched, r.phrase, round(r.match_score, 6)) for r in keyword.match_scores(scored, docs, queries).collect())
    assert got == [(0, 0, 3, True, 0.8), (0, 1, 2, False, round(0.4 * 2 / 3, 6)), (0, 1, 3, True, 0.8), (1, 2, 1, False, 0.2)]
    assert sorted((r.item_id, r.doc_id) for r in keyword.phrase_hits(scored, docs, queries).collect() if r.doc_id) == [(0, 1)]
    assert keyword.phrase_hits(scored, docs, queries).where("doc_id is null").count() == 1


def test_queries_in_another_normal_form(spark):
    docs = spark.createDataFrame([(1, "ABC ﬁnal words")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "ＡＢＣ ﬁnal")], "item_id long, text string")
    queries = asked.withColumn("terms", X.query_terms(X.nfkc("text")))
    assert [r.matched for r in keyword.bm25(keyword.index(docs), queries).collect()] == [2]
    assert [r.phrase for r in keyword.match_scores(keyword.bm25(keyword.index(docs), queries), docs, queries).collect()] == [True]


def test_refused_requests(spark):
    rows = [("a", None, None), ("🙂" * 256, 20, 50_000), ("🙂" * 257, 1, 1), (" ", 1, 1), (None, 1, 1), ("a", 21, 1), ("a", 0, 1), ("a", 1, 50_001)]
    got = spark.createDataFrame(rows, "t string, k int, b int").select(fusion.refused(F.col("t"), F.col("k"), F.col("b"))).collect()
    assert [r[0] for r in got] == [None, None, "query_too_long", "query_empty", "query_empty", "results_out_of_range", "results_out_of_range", "tokens_out_of_range"]


def plain_difference(a, b):
    """The rule over the whole table of lengths."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n)[::-1]:
        for j in range(m)[::-1]:
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, at = [], (0, 0)
    while at != (n, m):
        i, j = at
        equal, right = i < n and j < m and a[i] == b[j], j < m and (i == n or best[i][j + 1] >= best[min(i + 1, n)][j])
        out.append(("context", a[i]) if equal else ("added", b[j]) if right else ("removed", a[i]))
        at = (i + (equal or not right), j + (equal or right))
    return out


def test_line_differences(spark):
    draw = random.Random(11)
    for _ in range(400):
        a, b = (draw.choices("abc", k=draw.randint(1, 14)) for _ in range(2))
        assert markdown._difference("\n".join(a), "\n".join(b)) == plain_difference(a, b), (a, b)
    rows = spark.createDataFrame([("a\nb", "a\nc"), (None, "x"), ("x", None), ("", "")], "a string, b string")
    got = [[(x["type"], x["value"]) for x in r[0]] for r in rows.select(markdown.line_diff("a", "b")).collect()]
    assert got == [[("context", "a"), ("added", "c"), ("removed", "b")], [("added", "x"), ("removed", "")], [("added", ""), ("removed", "x")], [("context", "")]]
    bound = rows.limit(1).select(markdown.line_diff("a", "b", most_cells=3)).first()[0]
    assert [x["type"] for x in bound] == ["removed", "removed", "added", "added"]


def test_nearest_in_blocks(spark, monkeypatch):
    draw = random.Random(3)
    vectors = [(k, [draw.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for k in range(60)] + [(None, [1.0, 0.0, 0.0, 0.0]), (70, None), (71, [1.0]), (72, [float("nan")] * 4)]
    asked = [(k, [draw.choice([-1.0, 0.5, 1.0]) for _ in range(4)]) for k in range(17)] + [(90, [0.0] * 4), (91, None), (92, [2.0])]
    v, q = spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>")
    whole = sorted(map(tuple, nearest.cosine_topk(v.repartition(3), q, 5, "vec_id", "query_id").collect()), key=repr)
    assert len(whole) == 17 * 5 + 1
    monkeypatch.setattr(nearest, "BLOCK", 4)
    assert sorted(map(tuple, nearest.cosine_topk(v.repartition(3), q, 5, "vec_id", "query_id").collect()), key=repr) == whole
    for query, key, cosine, rank in whole:
        if query < 90:
            a = dict(asked)[query]
            norm = lambda x: sum(y * y for y in x) ** 0.5
            all_ = sorted((-round(sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b), 9) if norm(b) else 0.0, k is not None, k or 0) for k, b in vectors if b and len(b) == 4 and b[0] == b[0])
            assert (key is not None, key or 0) == all_[rank - 1][1:]
