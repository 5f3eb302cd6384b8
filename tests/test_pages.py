"""Canonical page texts: places by hand, order, empty pages, and each problem planted once."""

from knowlattice.operators import pages as P

SCHEMA = "doc_id long, page int, status string, blocks array<struct<kind: string, text: string, order: int>>"


def test_places_and_order(spark):
    rows = [
        (1, 2, "succeeded", [("text", "zwei", 1), ("table", "e🙂s", 0)]),
        (1, 1, "succeeded", [("text", "a\r\nb", None)]),
        (1, 3, "succeeded", []),
        (2, 1, None, [("formula", "x", 0)]),
    ]
    got = {r.doc_id: r for r in P.canonical_pages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    text = "<!-- page:1 -->\n\na\nb\n\n<!-- page:2 -->\n\ne🙂s\n\nzwei\n\n<!-- page:3 -->"
    assert got[1].text == text and got[2].text == "<!-- page:1 -->\n\nx"
    assert [(b.kind, text[b.start : b.end], b.page) for b in got[1].blocks] == [("text", "a\nb", 1), ("table", "e🙂s", 2), ("text", "zwei", 2)]
    assert [(p.number, p.start, p.end) for p in got[1].pages] == [(1, 15, 20), (2, text.index("2 -->") + 5, text.index("zwei") + 4)], "a page without blocks has no range"
    assert P.canonical_pages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_problems(spark):
    good = [("text", "words", 0)]
    cases = {
        "block_kind": [(1, "succeeded", [("image", "x", 0)])],
        "block_blank": [(1, "succeeded", [("text", " ", 0)])],
        "page_number": [(0, "succeeded", good)],
        "page_status": [(1, "lost", good)],
        "page_order": [(1, "succeeded", good), (3, "succeeded", good)],
        "page_incomplete": [(1, "succeeded", good), (2, "skipped", good)],
        "no_blocks": [(1, "succeeded", [])],
    }
    rows = [(k, *page) for k, pages in enumerate(cases.values()) for page in pages] + [(99, 1, None, good), (99, 2, "succeeded", None)] + [(98, 1, "succeeded", good), (98, 1, "succeeded", good)]
    got = {r.doc_id: r.problem for r in P.page_problems(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(cases)) | {98: "page_order"}
