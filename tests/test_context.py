"""Context, locators, markdown blocks and differences, with expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from knowlattice.operators import context as X
from knowlattice.operators import lifecycle as L
from knowlattice.operators import markdown as M

RANKED = "item_id long, budget long, channel string, rank int, id long, title string, header string, parent string, content string, terms array<string>"


def test_assemble(spark):
    rows = [
        (1, 100, "wiki", 1, 7, "A", None, None, "alpha " * 10, ["alpha"]),
        (1, 100, "wiki", 2, 8, "B", None, None, "x\n\nbeta one\n\ny\n\n" + "z " * 200, ["beta"]),
        (1, 100, "wiki", 3, 9, "C", None, None, "late", ["beta"]),
        (1, 100, "raw", 1, 5, "R", "head", "parent words " * 50, "child", []),
        (2, 0, "raw", 1, 5, "R", None, None, "child", []),
        (3, 60, "raw", 1, 5, "R", None, None, None, None),
    ]
    got = {(r.item_id, r.channel, r.id): r for r in X.assemble(spark.createDataFrame(rows, RANKED)).collect()}
    assert got[1, "wiki", 7].outcome == "whole" and got[1, "wiki", 7].text.startswith("### Wiki · A\nalpha alpha")
    assert got[1, "wiki", 8].outcome == "page_truncated" and "beta one" in got[1, "wiki", 8].text and "z z" not in got[1, "wiki", 8].text
    raw = got[1, "raw", 5]
    assert raw.outcome == "chunk_truncated" and "Child chunk:\nchild" in raw.text and "Parent context:\nparent" in raw.text
    assert sum(r.tokens for k, r in got.items() if k[0] == 1) <= 100 and got[2, "raw", 5].outcome == "budget_exhausted" and got[3, "raw", 5].outcome == "whole"
    assert X.assemble(spark.createDataFrame([], RANKED)).count() == 0


@pytest.mark.parametrize("locator, want", [
    ('{"startOffset": 0, "endOffset": 5}', None), ('{"page": 2}', None), ('{"chunkId": "c"}', None), ("{}", "no_position"), ("nonsense", "not_an_object"), (None, "not_an_object"),
    ('{"other": 1}', "no_position"), ('{"page": 1, "other": 1}', "unknown_field"), ('{"page": -1}', "not_a_number"), ('{"page": "x"}', "not_a_number"), ('{"page": 0}', "page_below_one"),
    ('{"startOffset": 5, "endOffset": 5}', "range_not_rising"), ('{"startOffset": 5}', "range_not_rising"), ('{"startOffset": 0, "endOffset": 101}', "beyond_source"), ('{"pageStart": 3, "pageEnd": 2}', "page_range_not_rising"),
    ('{"page": "1"}', "not_a_number"), ('{"page": 1.0}', None), ('{"page": 1.5}', "not_a_number"), ('{"page": null}', "not_a_number"), ('{"chunkId": 5}', "empty_or_long"), ('{"selector": true}', "empty_or_long"), ('{"blockId": null}', "empty_or_long"),
    ('{"pages": [1.0]}', None), ('{"pages": ["1"]}', "pages_not_numbers"), ('{"pages": [1, null]}', "pages_not_numbers"), ('{"pages": []}', None), ('{"pages": 1}', "pages_not_numbers"), ('{"lineStart": 0, "lineEnd": 3}', None), ("[1]", "not_an_object"),
    ('{"selector": "' + "s" * 1001 + '"}', "empty_or_long"), ('{"page": 4}', "beyond_pages"), ('{"pages": [1, 9]}', "beyond_pages"), ('{"pages": [0]}', "pages_not_numbers"), ('{"chunkId": " "}', "empty_or_long"),
])
def test_locators(spark, locator, want):
    df = spark.createDataFrame([(locator, 100, 3)], "l string, n int, p int")
    assert df.select(X.locator_problem(F.col("l"), F.col("n"), F.col("p"))).first()[0] == want


def test_markdown_blocks(spark):
    text = "\n  \nintro\nmore\n# A\nx\n### C\n## B \n\n# D"
    rows = M.blocks(spark.createDataFrame([(1, text), (2, " \n"), (3, None), (4, "")], "page_id long, text string")).orderBy("page_id", "ordinal").collect()
    got = [(r.type, r.path, text[r.start : r.end]) for r in rows if r.page_id == 1]
    assert got == [("markdown", [], "intro\nmore\n"), ("heading", ["A"], "# A\nx\n"), ("heading", ["A", None, "C"], "### C\n"), ("heading", ["A", "B"], "## B \n\n"), ("heading", ["D"], "# D")]
    assert [(r.page_id, r.type, r.start, r.end) for r in rows if r.page_id != 1] == [(2, "markdown", 0, 2), (4, "markdown", 0, 0)]


def test_line_diff(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc\nd"), (None, "n"), ("same", "same")], "a string, b string")
    got = [[(x.type, x.value) for x in r[0]] for r in df.select(M.line_diff("a", "b")).collect()]
    assert got == [[("context", "a"), ("added", "x"), ("removed", "b"), ("context", "c"), ("added", "d")], [("added", "n"), ("removed", "")], [("context", "same")]]


def test_pages_edges_and_generations(spark):
    pages = spark.createDataFrame([(1, "active", "note", "k", "s", 2, 2), (2, "active", "log", "k", "s", 1, 1), (3, "active", "note", "k", "t", 1, 2), (4, "active", "note", "k", "t", 5, 5), (5, "archived", "note", "k", "s", 1, 1)], "page_id int, status string, page_type string, base string, space string, version int, current_version int")
    assert sorted(r.page_id for r in L.active_pages(pages, "k").collect()) == [1, 4] and [r.page_id for r in L.active_pages(pages, "k", "t").collect()] == [4]
    chunks = spark.createDataFrame([(10, "k"), (11, "other"), (None, "k")], "chunk_id int, base string")
    assert sorted(map(str, (r.id for r in L.in_base(pages, chunks, "k", "s").collect()))) == ["1", "10", "None"]
    edges = spark.createDataFrame([(1, 2, 4), (1, 1, 4), (1, 2, 5), (4, 5, 2)], "source int, source_version int, target int")
    assert [tuple(r) for r in L.valid_edges(edges, pages).collect()] == [(1, 2, 4)]
    runs = spark.createDataFrame([("a", 1, "active"), ("a", 2, "indexed"), ("b", 3, "active")], "r string, run_id int, status string")
    assert {r.run_id: r.status for r in L.swap_generation(runs, spark.createDataFrame([("a", 2)], "r string, run_id int"), ["r"]).collect()} == {1: "superseded", 2: "active", 3: "active"}
    kids = spark.createDataFrame([(1, None, "ok"), (2, 1, "ok"), (3, 9, "ok"), (4, 5, "ok"), (5, None, "gone")], "id int, up int, status string")
    assert {r.id: r.parent_status for r in L.with_active_parent(kids, "id", "up", F.col("status") == "ok", ["status"]).collect()} == {1: None, 2: "ok", 3: None, 4: None, 5: None}
    assert [tuple(r) for r in L.common_columns(kids.where("id = 2"), spark.createDataFrame([], "status string, extra date, id long")).collect()] == [("ok", None, 2)]


def test_sources_and_scope(spark):
    a = spark.createDataFrame([(0, 5, 1, "a"), (0, 6, 2, "a")], "item_id int, page_id int, rank int, of string")
    b = spark.createDataFrame([(0, 6, 1, "b"), (0, 7, 1, "b"), (0, 7, 2, "b"), (1, 5, 9, "b"), (1, None, 1, "b")], "item_id int, page_id int, rank int, of string")
    got = sorted((r.item_id, r.page_id or 0, r["rank"], r.of) for r in X.first_of_sources([a, b], ["item_id"]).collect())
    assert got == [(0, 5, 1, "a"), (0, 6, 2, "a"), (0, 7, 1, "b"), (1, 0, 1, "b"), (1, 5, 9, "b")]
    rows = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    traces = spark.createDataFrame([([2, 2, 9],), (None,), ([None],)], "ids array<int>")
    assert sorted(r.k for r in X.in_scope(rows, rows.where("k = 3"), traces, "k").collect()) == [2, 2, 3]


def test_cited_sources(spark):
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    seeds = frame([(1, 2), (1, 2), (2, 1)], "page_id int, page_version int")
    citations = frame([(1, 2, 10, "x"), (1, 1, 10, "old"), (2, 1, 11, "y"), (2, 1, 99, "no version"), (3, 1, 10, "no seed")], "page_id int, page_version int, version_id int, quote string")
    got = X.cited_sources(seeds, citations, frame([(10, 100), (11, 101)], "version_id int, resource_id int"), frame([(100, "r")], "resource_id int, name string")).collect()
    assert [(r.page_id, r.quote, r.name) for r in got] == [(1, "x", "r")]
