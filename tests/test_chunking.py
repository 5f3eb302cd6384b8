"""Structural chunks: hand-made texts, properties on random Markdown, and plain versions of cuts, overlaps and token limits."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from knowlattice.functions import layout as Y
from knowlattice.operators import chunking as C

CODE = "```py\n" + "".join(f"line_{i} = {i}\n" for i in range(900)) + "```\n"
TABLE = "| name | value |\n|---|---|\n" + "".join(f"| row {i} | {i * 7} |\n" for i in range(600))
VOCABULARY = __import__("public_tokenizers").path("byte_bpe_50k.json")


def units(text):
    return [(u.start, u.end, u.type) for u in Y.Lines(text).units()]


def kinds(text):
    return [u[2] for u in units(text)]


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("# One\nwords\n\nmore\n## Two\nend", ["heading", "paragraph", "heading"]),
        ("a|b\n---|---\nc|d\n\ne|f\nx", ["table", "paragraph"]),
        ("| a | b |\nnot a row\na | b\n--- | ---\n1 | 2\n", ["table", "paragraph", "table"]),
        ("cost in US$$\nmore\n$$\nx\n$$ \ny", ["paragraph", "formula", "paragraph"]),
        ("\\[ x \\]\nmore\n\\begin{eq}\na\n\\end{eq}\n", ["formula", "paragraph", "formula"]),
        ("text\n```\nnever closed\n\n# not a heading", ["paragraph", "code"]),
        ("\ntext", ["blank"]),
        ("\n\ntext", ["blank", "paragraph"]),
        ("```\nx\n```\n\n~~~\ny\n~~~", ["code", "blank", "code"]),
        ("", []),
    ],
)
def test_units_by_hand(text, wanted):
    found = units(text)
    assert [u[2] for u in found] == wanted
    assert "".join(text[a:b] for a, b, _ in found) == text


def markdown(draw):
    parts = [
        lambda: "# " * draw.randint(1, 3) + "Head " + str(draw.randint(1, 9)), lambda: "```py\n" + "x = 1\n" * draw.choice([1, 40, 200, 2000]) + draw.choice(["```", "```", ""]),
        lambda: "| a | b |\n|---|---|\n" + "| long cell | 2 |\n" * draw.choice([0, 3, 40, 400]), lambda: "$$\n" + "a + b\n" * draw.choice([2, 300]) + "$$", lambda: "Some words, a [link](http://x.y/z) and $f(x)$. " * draw.choice([1, 5, 60, 200]),
        lambda: "", lambda: "x" * draw.choice([10, 800, 9000]), lambda: "1.2 Part", lambda: "ALL CAPITALS", lambda: "\f", lambda: "---", lambda: "汉字。" * draw.choice([5, 400]), lambda: "🙂 " * 50, lambda: "US$$ [ ( ] \\[",
    ]
    return "\n".join(draw.choice(parts)() for _ in range(draw.randint(0, 25)))


@pytest.mark.parametrize("seed", range(60))
def test_random_markdown(seed):
    draw = random.Random(seed)
    text = markdown(draw)
    config = C.Config(parent=draw.choice([4096, 900]), child=draw.choice([384, 50]), overlap=draw.choice([76, 0, 500]), protected=draw.choice([7500, 1000]))
    assert "".join(text[a:b] for a, b, _ in units(text)) == text
    windows = C.split(text, "legacy", config.parent, config.protected)
    assert not [f for f in C.faults(windows, len(text), config.parent) if f != "large-document-single-chunk" and f != "oversized-chunk"]
    rows = C.chunk_text(text, config)
    assert [r["sequence"] for r in rows] == list(range(len(rows)))
    at = 0
    for r in rows:
        assert r["content"] == text[r["start"] : r["end"]] and r["end"] > r["start"]
        if r["kind"] == "parent":
            continue
        own = r["start"] + r["overlap"]
        assert not Y.trim(text[at:own]) and own >= at, "only blanks lie between children"
        at = r["end"]
        assert r["overlap"] <= config.overlap + 40 and not (r["overlap"] and r["protected_type"])
        if r["end"] - own > config.child:  # for a reason
            around = Y.Ranges(text[own : r["end"]])
            assert r["split_reason"] == "protected-atomic" or "protected-atomic" in (r["split_reason"] or "") or around.starts or r["protected_type"] == "table"
        if r["protected_type"] == "table" and r["part_index"] and not r["forced_split"]:
            assert r["content"].endswith("\n") or r["end"] == len(text) and "Table header" in r["context_header"]
        if r["protected_type"] == "code" and r["part_index"] is not None:
            assert "Code block" in r["context_header"] and "continuation (part" in r["context_header"]
    assert not Y.trim(text[at:])


def plain_cut(text, start, desired, end):
    """The rule, place by place."""
    if desired >= end:
        return end
    floor = start + int((desired - start) * 0.55)
    tests = [lambda p: p >= start + 2 and text[p - 2 : p] == "\n\n", lambda p: text[p - 1] == "\n", lambda p: text[p - 1] in "。！？；，.!?,;:：", lambda p: not Y.trim(text[p - 1])]
    return next((p for t in tests for p in range(desired, floor, -1) if t(p)), desired)


def test_cuts_equal_the_rule():
    draw = random.Random(5)
    for _ in range(400):
        text = "".join(draw.choice("abcdefgh \n.\n，\u3000") for _ in range(draw.randint(1, 200)))
        start = draw.randrange(len(text))
        desired, whole = draw.randint(start + 1, len(text) + 3), Y.Text(text)
        assert whole.cut(start, desired, len(text)) == plain_cut(text, start, desired, len(text))
        pieces = list(whole.pieces(start, len(text), 30))
        assert pieces[0][0] == start and pieces[-1][1] == len(text) and all(a[1] == b[0] and a[1] - a[0] <= 30 for a, b in zip(pieces, pieces[1:]))
    line = "w" * 1199 + "\n" + "v" * 500 + "\n" + "v" * 599
    assert list(Y.Text(line).pieces(0, len(line), 1200)) == [(0, 1200), (1200, 2300)], "what is left is not cut again"


def test_inline_ranges_stay_whole():
    for inside in ("[a b c d e f](http://example.com/some/path)", "$a + b + c + d + e + f$", "\\begin{x}one two\\end{x}"):
        text = "word " * 18 + inside + " word" * 40
        for a, b in Y.Text(text).pieces(0, len(text), 100, Y.Ranges(text), 7500):
            assert (inside in text[a:b]) or not set(range(text.index(inside) + 1, text.index(inside) + len(inside))) & {a, b}
    assert list(zip(Y.Ranges("![x](y) [z]() [a](b").starts, Y.Ranges("![x](y) [z]() [a](b").ends)) == [(0, 7)]
    assert Y.Ranges("[[[a](b)").around(3) == (0, 8)


def test_overlap_takes_the_nearest_boundary():
    text = "Twenty-four characters. " * 100
    whole = Y.Text(text)
    assert whole.overlap_start(1200, 1080) == 1199  # behind the full stop
    assert whole.overlap_start(1199, 1080) == 1176 - 1
    assert Y.Text("x" * 500).overlap_start(400, 300) == 400
    assert Y.Text("ab " + "x" * 50).overlap_start(40, 1) == 3


def test_strategies_and_chain():
    heads = "".join(f"# H{i}\nbody {i}\n" for i in range(5))
    caps = "ALPHA PART\ntext\n" * 6 + "end"
    assert C.choose(heads, C.Parser()) == "heading" and C.choose(caps, C.Parser()) == "heuristic" and C.choose("a\fb", C.Parser()) == "heuristic"
    assert C.choose("plain. " * 900 + "# A\n# B\n# C\n", C.Parser()) == "legacy"
    rows = C.chunk_text(heads)
    assert {r["strategy"] for r in rows} == {"heading"} and [r["context_header"] for r in rows] == [f"# H{i}" for i in range(5)]
    nested = C.chunk_text("# A\nx\n## B\ny\n# C\nz\n")
    assert [r["context_header"] for r in nested] == ["# A", "# A\n## B", "# C"]
    assert [(a, b) for a, b, _ in C.sections(caps, "heuristic")][:2] == [(0, 16), (16, 32)]
    one = "x" * 20_000 + "\n# A\n# B\n# C\n"
    assert C.chunk_text(one)[0]["strategy"] == "legacy"
    with pytest.raises(ValueError):
        C.Config(child=10, parent=10)
    assert C.faults([], 5, 100) == ["empty-output"] and C.faults(C.split("a\n" * 9, "legacy", 100, 7500), 17, 100) == ["coverage-boundary"]


def test_protected_blocks():
    rows = C.chunk_text("before\n" + CODE + "after\n" + TABLE + "\nlast")
    parents = [r for r in rows if r["kind"] == "parent"]
    tables = [r for r in parents if r["protected_type"] == "table"]
    assert [t["part_index"] for t in tables] == list(range(tables[0]["part_count"])) and tables[1]["context_header"] == "Table header continuation\nTable header:\n| name | value |\n|---|---|"
    assert len({t["protected_group"] for t in tables}) == 1 and all(t["table_header"] == "| name | value |\n|---|---|" for t in tables)
    code = [r for r in rows if r["protected_type"] == "code" and r["kind"] == "parent"]
    assert {r["split_reason"] for r in code} == {"code-block-size-limit"} and code[0]["context_header"].startswith("Code block (py) continuation (part 1/")
    small = C.chunk_text("```\n" + "x\n" * 700 + "```\n")
    assert [(r["kind"], r["split_reason"]) for r in small] == [("parent", None), ("child", "protected-atomic")]
    wide = "| h | i |\n|---|---|\n| " + "c" * 500 + " | 1 |\n| d | e |\n"
    assert any("table-row-too-large" in (r["split_reason"] or "") for r in C.chunk_text(wide))


def test_token_target_is_exact():
    config = C.Config(child_tokens=40, parent_tokens=200, tokenizer=VOCABULARY)
    count = C.counter(VOCABULARY)
    draw = random.Random(2)
    text = "# Head\n" + "".join(draw.choice(["word ", "zqxjk", "Ünïcödé ", "汉字", "🙂", ". ", "\n", "1234567890"]) for _ in range(1500))
    rows = [r for r in C.chunk_text(text, config) if r["kind"] == "child"]
    assert all(count("\n\n".join(filter(None, (r["context_header"], r["content"]))))[0] <= 40 for r in rows if count(r["context_header"] or "")[0] < 40)
    assert any("token-target" in (r["split_reason"] or "") for r in rows)
    chunk = C.split(text, "legacy", 4096, 7500)[1]
    parts = C.by_tokens(text, chunk, 40, count)
    assert parts[0].start == chunk.start and parts[-1].end == chunk.end and all(a.end == b.start for a, b in zip(parts, parts[1:]))
    for p in parts[:-1]:
        assert count(text[p.start : p.end])[0] <= 40
        furthest = p.start
        while count(text[p.start : furthest + 1])[0] <= 40:  # place by place
            furthest += 1
        assert p.end > p.start + int((furthest - p.start) * 0.5)
    assert C.by_tokens(text, chunk, 40, count, prefix="word " * 60) == [chunk]


def test_parser_blocks_and_pages(spark):
    text = "Title\nPlain words here.\nx = 1\ny = 2\nrest of it\n| a | b |\n"
    at = text.index
    blocks = [("title", 0, 6, 1, None), ("text", 6, at("x ="), 1, ["Title"]), ("fenced_code", at("x ="), at("rest"), None, ["Title"])]
    pages = [(1, 0, at("y =")), (2, at("y ="), len(text))]
    schema = f"doc_id long, text string, pages {C.PAGES}, blocks {C.BLOCKS}"
    rows = [(1, text, pages, blocks), (2, text, pages, None), (3, text, pages, [("text", 0, 9, 1, None), ("text", 8, 12, 1, None)]), (4, text, [(1, 0, 5), (1, 5, 9)], None), (5, None, pages, blocks), (6, text, [(1, 0, 999)], None)]
    docs = spark.createDataFrame(rows, schema)
    found = {}
    for r in sorted(C.document_units(docs).collect(), key=lambda r: (r.doc_id, r.unit)):
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {1, 2}, "documents with a problem have no units"
    for us in found.values():
        assert "".join(text[u.start : u.end] for u in us) == text
    assert [(u.type, u.end) for u in found[1]][2:4] == [("code", at("y =")), ("code", at("rest"))], "a block is cut where its page ends"
    assert '"Title", 1' in found[1][1].path and '["page", "", 2]' in found[1][3].path
    assert at("y =") in {u.start for u in found[2]}
    problems = docs.select("doc_id", C.parser_problem(F.coalesce("pages", F.array().cast(C.PAGES)), F.coalesce("blocks", F.array().cast(C.BLOCKS)), F.length("text")).alias("p"))
    assert {r.doc_id: r.p for r in problems.collect()} == {1: None, 2: None, 3: "blocks_overlap", 4: "page_twice", 5: None, 6: "page_range"}
    made = C.chunk_documents(docs.where("doc_id = 1")).collect()
    assert {r.strategy for r in made} == {"parser"} and any((r.context_header or "").startswith("Page 1\n# Title") for r in made)


def test_spark_rows(spark):
    rows = [(1, "\ufeffa\r\nb\rc"), (1, "\ufeffa\r\nb\rc"), (2, None), (3, ""), (4, " \n"), (None, "no key")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, content string").repartition(3)
    got = C.chunk_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.content) for r in got) == [(0, "no key"), (1, "a\nb\nc"), (1, "a\nb\nc")]
    assert C.chunk_documents(docs.limit(0)).collect() == []
    assert C.chunk_documents(docs).columns == ["doc_id", *[f.split()[0] for f in re.findall(r"\w+ [\w<>]+", C.CHUNK)]]


def test_time_is_linear():
    for text in ("One sentence. " * 20_000, "x" * 300_000, "](" * 100_000, "| a | b |\n" * 30_000, "\\]" + "\\[" * 100_000):
        begun = time.time()
        C.chunk_text(text)
        assert time.time() - begun < 10
