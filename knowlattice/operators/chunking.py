"""Structural chunks of documents: parents and children by a strategy that fits the text, as one narrow pass.

What a chunk is depends on its own document only, so nothing is shuffled: Spark deals out the documents, a task cuts each
of its texts (``functions.layout`` knows lines, units and cuts) and rows of chunks come out. Parsers' pages and blocks,
where there are any, travel with their document.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import layout as Y
from ..functions.layout import Span, Text, joined, path_header
from ..functions.tokens import Counter

STRATEGIES = ("auto", "parser", "heading", "heuristic", "legacy")
#: Boundaries of these nodes are never packed over.
_SECTIONS = ("page", "heading", "section")


@dataclass(frozen=True)
class Config:
    """Sizes in code points; ``child_tokens`` and ``parent_tokens`` are limits by the tokenizer file at ``tokenizer``."""

    strategy: str = "auto"
    parent: int = 4096
    child: int = 384
    overlap: int = 76
    protected: int = 7500
    parent_tokens: int | None = None
    child_tokens: int | None = None
    tokenizer: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"strategy is one of {', '.join(STRATEGIES)}")
        if not self.parent > self.child > 0 or self.overlap < 0 or self.protected <= 0:
            raise ValueError("sizes are positive, and a parent is longer than a child")
        if (self.parent_tokens or self.child_tokens) and not self.tokenizer:
            raise ValueError("a limit in tokens needs a tokenizer")


@dataclass(frozen=True)
class Parser:
    """Pages (number, start, end) and blocks (kind, start, end, page, headings) in the order of the text."""

    pages: tuple = ()
    blocks: tuple = ()

    def page_at(self, place: int) -> tuple:
        k = bisect_right(self.pages, place, key=lambda p: p[1])
        return (("page", "", self.pages[k - 1][0]),) if k and place < self.pages[k - 1][2] else ()

    def cells(self, n: int) -> Iterator[tuple[int, int, tuple, tuple | None]]:
        """Ranges that cover the text: blocks, cut where pages begin and end, and what stands between (pages, where there are no blocks)."""
        at = 0
        for start, end, block in [(b[1], b[2], b) for b in self.blocks] or [(p[1], p[2], None) for p in self.pages]:
            if start > at:
                yield at, start, self.page_at(at), None
            if block is None:
                yield start, end, self.page_at(start), None
            else:
                edges = sorted({start, end, *(e for p in self.pages for e in p[1:] if start < e < end)})
                for a, b in zip(edges, edges[1:]):
                    page = self.page_at(a) or ((("page", "", block[3]),) if block[3] else ())
                    path = joined(page, tuple(("heading", h, k + 1) for k, h in enumerate(block[4])), (("block", block[0], 0),))
                    yield a, b, path, block
            at = end
        if at < n:
            yield at, n, self.page_at(at), None

    def units(self, text: Text) -> Iterator[Span]:
        for a, b, path, block in self.cells(len(text.text)):
            if block and block[0] in Y.PROTECTED:
                yield Span(a, b, block[0], f"{block[0]}:{block[1]}:{block[2]}", path=path)
            else:
                yield from (Y._with(u, path=path) for u in Y.Lines(text.text[a:b], a).units())


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """Counts a text's tokens by the tokenizer file; one for each Python worker."""
    return Counter(path)


def sections(text: str, strategy: str) -> list[tuple[int, int, tuple]]:
    """(start, end, path) of the sections that a strategy sees; together they cover the text."""
    starts = Y.Lines(text).headings() if strategy == "heading" else Y.Lines(text).markers() if strategy == "heuristic" else []
    if not starts or starts[0][0] > 0:
        starts = [(0, ()), *starts]
    return [(a, b, path) for (a, path), b in zip(starts, [*(s for s, _ in starts[1:]), len(text)])]


def profile(text: str) -> dict[str, float]:
    lines = Y.Lines(text)
    plain = [t for t, code in zip(lines.text, lines.fenced) if not code]
    headings = sum(Y.heading(t) is not None for t in plain)
    marks = sum(bool(Y.NUMBERED.match(t) or Y.RULE.match(t)) or Y.is_capitals(t) for t in plain)
    return {"headings": headings, "density": headings / len(text) if text else 0.0, "markers": marks, "page_breaks": sum("\f" in t for t in plain)}


def choose(text: str, parser: Parser) -> str:
    """The strategy that fits a text: a parser's blocks, many headings, other section marks, or its size alone."""
    pages = max(len(parser.pages), len({b[3] for b in parser.blocks if b[3]}))
    if len(parser.blocks) > 1 or pages > 1 or any(b[0] in Y.PROTECTED for b in parser.blocks):
        return "parser"
    seen = profile(text)
    if seen["headings"] >= 3 and seen["density"] > 0.005:
        return "heading"
    return "heuristic" if seen["markers"] >= 5 or seen["page_breaks"] else "legacy"


@dataclass
class Chunk:
    start: int
    end: int
    header: str
    spans: tuple[Span, ...]
    path: tuple = ()
    overlap: int = 0
    reason: str | None = None
    forced: bool = False

    @property
    def protected(self) -> str | None:
        found = [s.type for s in self.spans if s.type in Y.PROTECTED]
        return ",".join(dict.fromkeys(found)) if found else None

    @property
    def group(self) -> str | None:
        protected = self.protected
        return next((s.group for s in self.spans if s.group), None) or (f"{protected.split(',')[0]}:{self.start}:{self.end}" if protected else None)

    def of_one(self, name: str):
        return getattr(self.spans[0], name) if len(self.spans) == 1 else None


def _chunk(spans: list[Span], path: tuple) -> Chunk:
    path = joined(path, spans[0].path)
    header = "\n".join(filter(None, [path_header(path), *dict.fromkeys([s.context for s in spans if s.context])])) if path or any([s.context for s in spans]) else ""
    reason = ",".join(dict.fromkeys([s.reason for s in spans if s.reason])) or None
    return Chunk(spans[0].start, spans[-1].end, header, tuple(spans), path, reason=reason, forced=any(s.forced for s in spans))


def _border(path: tuple) -> tuple:
    return tuple(node for node in path if node[0] in _SECTIONS)


def pack(spans: Iterator[Span], target: int, path: tuple = ()) -> Iterator[Chunk]:
    """Neighbouring spans as one chunk. A protected span is a chunk by itself, and none goes over a page, heading or section.

    A span is taken in while the place reached in the text and its length together stay within the target: from
    there on each span is a chunk.
    """
    held: list[Span] = []
    for span in spans:
        if held and (span.protected or held[-1].protected or held[-1].end + span.size > target or held[0].path != span.path and _border(held[0].path) != _border(span.path)):
            yield _chunk(held, path)
            held = []
        held.append(span)
    if held:
        yield _chunk(held, path)


def split(text: str, strategy: str, target: int, protected: int, parser: Parser | None = None, overlap: int = 0) -> list[Chunk]:
    """The chunks of a text by one strategy, with ``overlap`` into the one before where neither is protected."""
    whole, out = Text(text), []
    if strategy == "parser" and parser and (parser.blocks or parser.pages):
        parts = [((), parser.units(whole))]
    else:
        parts = [(path, Y.Lines(text[a:b], a).units()) for a, b, path in sections(text, strategy)]
    for path, units in parts:
        out += pack((piece for unit in units for piece in Y.cut_unit(whole, unit, target, protected)), target, path)
    if overlap:
        for before, chunk, k in zip(out[:-1], out[1:], range(1, len(out))):
            if not (chunk.protected or before.protected) and (chunk.path == before.path or _border(chunk.path) == _border(before.path)):
                earlier = whole.overlap_start(chunk.start, max(before.spans[0].start, chunk.start - overlap))
                out[k] = Chunk(earlier, chunk.end, chunk.header, chunk.spans, chunk.path, chunk.start - earlier, chunk.reason, chunk.forced)
    return out


def faults(chunks: list[Chunk], n: int, target: int) -> list[str]:
    """Why chunks are no division of a text of ``n`` code points: ends, gaps, overlaps, and sizes nothing explains."""
    if not chunks:
        return ["empty-output"] if n else []
    whole = lambda c: c.reason == "protected-atomic"
    found = ["coverage-boundary"] * (chunks[0].start != 0 or chunks[-1].end != n)
    for at, c in zip([0, *(c.end for c in chunks)], chunks):
        found += ["unexpected-parent-overlap"] * (c.start < at) + ["coverage-gap"] * (c.start > at) + ["empty-chunk"] * (c.end <= c.start)
        found += ["oversized-chunk"] * (c.end - c.start > 2 * target and not c.forced and not whole(c))
    return found + ["large-document-single-chunk"] * (n > 2 * target and len(chunks) == 1 and not whole(chunks[0]))


def by_tokens(text: str, chunk: Chunk, target: int | None, count: Counter | None, prefix: str = "") -> list[Chunk]:
    """The chunk in parts of at most ``target`` tokens, counted with ``prefix`` before them; protected chunks stay whole.

    How far a part may go is first read from where the tokens of the rest end, then made exact by counts on both
    sides of that place; the cut is then the last good separator. An inline link or formula around the cut is kept whole. A
    prefix that fills the target leaves the chunk as it is.
    """
    if not target or chunk.protected or count.whole(prefix) >= target:
        return [chunk]
    tokens = count.stretch(text, chunk.start, chunk.end, prefix)
    size = tokens.size
    if size(chunk.start, chunk.end) <= target:
        return [chunk]
    whole, ranges, out, start = Text(text), Y.Ranges(text[chunk.start : chunk.end], chunk.start), [], chunk.start
    reason = ",".join(dict.fromkeys([*filter(None, (chunk.reason or "").split(",")), "token-target"]))
    room = target - (count.whole(prefix + "\n\n") if prefix else 0)
    while start < chunk.end:
        if size(start, chunk.end) <= target:
            cut = chunk.end
        else:
            good, bad = start, chunk.end
            place, step = min(max(tokens.end_of(start, room), start + 1), chunk.end - 1), 4
            while bad - good > 1:
                if size(start, place) <= target:
                    good = place
                    place = min(good + step, bad - 1) if bad == chunk.end else (good + bad) // 2
                else:
                    bad = place
                    place = max(bad - step, good + 1) if good == start else (good + bad) // 2
                step *= 2
            good = max(good, start + 1)
            cut = whole.cut(start, good, chunk.end, ranges)
            if cut < good and size(start, cut) > target:  # rare: fewer letters can be more tokens
                cut = good
        out.append(Chunk(start, cut, chunk.header, chunk.spans, chunk.path, chunk.overlap, reason, True))
        start = cut
    return out


def chunk_text(text: str, config: Config = Config(), parser: Parser = Parser()) -> list[dict]:
    """Rows of one canonical text's chunks: stored parents, each before its children, in the order of the text.

    The strategies are tried in turn until one divides the text without faults; the last one's result stands. A parent
    with one child of the same range is not stored, but for a long or partial protected one. Blank children without header are left out.
    """
    first = choose(text, parser) if config.strategy == "auto" else config.strategy
    chain = dict.fromkeys([first, "heading", "heuristic", "legacy"] if config.strategy == "auto" else [first, "legacy"])
    count = counter(config.tokenizer) if config.tokenizer else None
    windows: list[Chunk] = []
    strategy = first
    for strategy in chain:
        windows = [part for c in split(text, strategy, config.parent, config.protected, parser) for part in by_tokens(text, c, config.parent_tokens, count)]
        if not faults(windows, len(text), config.parent):
            break
    out: list[dict] = []

    def add(chunk: Chunk, kind: str, parent: int | None, child: int | None, header: str, group: str | None, reason: str | None, forced: bool, types: list[str]) -> None:
        one = chunk.of_one
        out.append({
            "sequence": len(out), "kind": kind, "parent_index": parent, "child_index": child, "start": chunk.start, "end": chunk.end, "content": text[chunk.start : chunk.end], "context_header": header or None, "block_types": types,
            "protected_type": chunk.protected, "protected_group": group, "table_header": one("header"), "split_reason": reason, "forced_split": forced, "part_index": one("part"), "part_count": one("parts"), "overlap": chunk.overlap, "strategy": strategy,
        })

    for k, parent in enumerate(windows):
        content = text[parent.start : parent.end]
        if parent.protected:
            span = parent.spans[0]
            unit, local = Span(0, len(content), span.type, path=parent.path), Text(content)
            if span.type == "table":
                parts = Y.cut_table(local, unit, config.child, config.protected, span.header if span.part else None)
            else:
                parts = Y.cut_code(local, unit, config.child, config.protected, not ((span.parts or 0) > 1 or (span.reason or "").startswith(span.type + "-")))
            made = [Chunk(s.start, s.end, s.context or "", (s,), s.path, reason=s.reason, forced=s.forced) for s in parts]
        else:
            made = split(content, "legacy", config.child, config.protected, overlap=min(config.overlap, config.child // 2))
        children = []
        for c in made:
            header = "\n".join(filter(None, (parent.header, c.header)))
            reason = ",".join(dict.fromkeys(filter(None, (parent.reason if parent.protected else None, c.reason)))) or None
            moved = Chunk(c.start + parent.start, c.end + parent.start, header, c.spans, c.path, c.overlap, reason, c.forced or bool(parent.protected and parent.forced))
            children += by_tokens(text, moved, config.child_tokens, count, header)
        children = [c for c in children if Y.trim(text[c.start : c.end]) or Y.trim(c.header)]
        same = len(children) == 1 and (children[0].start, children[0].end) == (parent.start, parent.end)
        long = parent.protected and (len(content) > config.child or (parent.of_one("parts") or 0) > 1)
        stored = bool(children) and (not same or bool(long))
        types = lambda c: list(dict.fromkeys(s.type for s in c.spans))
        if stored:
            add(parent, "parent", k, None, parent.header, parent.group, parent.reason, parent.forced, types(parent))
        for j, c in enumerate(children):
            add(c, "child", k if stored else None, j, c.header, parent.group or c.group, c.reason, c.forced, types(c))
    return out


CHUNK = (
    "sequence int, kind string, parent_index int, child_index int, start int, end int, content string, context_header string, block_types array<string>, protected_type string, protected_group string, "
    "table_header string, split_reason string, forced_split boolean, part_index int, part_count int, overlap int, strategy string"
)
#: Code points of texts whose rows are sent together, but for the last one's.
SENT = 100_000
PAGES = "array<struct<number: int, start: int, end: int>>"
BLOCKS = "array<struct<kind: string, start: int, end: int, page: int, headings: array<string>>>"


def canonical(text: Column) -> Column:
    """Without a mark of byte order, all line ends one line feed."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def parser_problem(pages: Column, blocks: Column, n: Column) -> Column:
    """What is wrong with a document's pages and blocks, or null: ranges outside of its ``n`` code points, numbers used twice, overlaps."""
    outside = lambda x: x["start"].isNull() | x["end"].isNull() | (x["start"] < 0) | (x["end"] <= x["start"]) | (x["end"] > n)
    ordered = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    overlap = lambda a: F.exists(F.arrays_zip(F.slice(ordered(a), 1, F.greatest(F.size(a) - 1, F.lit(0))).alias("x"), F.slice(ordered(a), 2, F.greatest(F.size(a), F.lit(0))).alias("y")), lambda z: z["y"]["start"] < z["x"]["end"])
    numbers = F.transform(pages, lambda p: p["number"])
    return (
        F.when(F.exists(pages, lambda p: p["number"].isNull() | (p["number"] < 1)), "page_number")
        .when(F.exists(pages, outside), "page_range")
        .when(F.size(F.array_distinct(numbers)) < F.size(numbers), "page_twice")
        .when(overlap(pages), "pages_overlap")
        .when(F.exists(blocks, outside), "block_range")
        .when(F.exists(blocks, lambda b: b["page"] < 1), "block_page")
        .when(overlap(blocks), "blocks_overlap")
    )


#: Names of parsers' blocks and what they are; all others are paragraphs.
_KINDS = {"code": "code", "code_block": "code", "fenced_code": "code", "table": "table", "table_block": "table", "formula": "formula", "math": "formula", "equation": "formula", "heading": "heading", "header": "heading", "title": "heading"}


def _parser(pages: list[dict] | None, blocks: list[dict] | None) -> Parser:
    ordered = sorted(((p["number"], p["start"], p["end"]) for p in pages or []), key=lambda p: p[1:])
    found = [(_KINDS.get((b["kind"] or "").strip().lower(), "paragraph"), b["start"], b["end"], b["page"], [h.strip() for h in b["headings"] or [] if h and h.strip()]) for b in blocks or []]
    return Parser(tuple(ordered), tuple(sorted(found, key=lambda b: b[1:3])))


def _rows(docs: DataFrame, key: str, text: str, made: Callable[[str, Parser], list[dict]], fields: str) -> DataFrame:
    """``made`` of each text with a key, in one narrow pass; documents whose pages or blocks have a problem are left out."""
    pages = F.col("pages").cast(PAGES) if "pages" in docs.columns else F.lit(None).cast(PAGES)
    blocks = F.col("blocks").cast(BLOCKS) if "blocks" in docs.columns else F.lit(None).cast(BLOCKS)
    taken = docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("text"), pages.alias("pages"), blocks.alias("blocks")).where("text is not null")
    taken = taken.where(parser_problem(F.coalesce("pages", F.array().cast(PAGES)), F.coalesce("blocks", F.array().cast(BLOCKS)), F.length("text")).isNull())
    schema = T.StructType([T.StructField("key", taken.schema["key"].dataType), *T.StructType.fromDDL(fields)])
    arrow = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, held = [], [], 0
            for i in range(batch.num_rows):
                one = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                found = made(one["text"], _parser(one["pages"], one["blocks"]))
                keys += [one["key"]] * len(found)
                rows += found
                held += len(one["text"])
                if rows and (held >= SENT or i == batch.num_rows - 1):  # the rows of a few texts go out before the next one's are made
                    columns = [pa.array([r[n] for r in rows], _arrow(schema[n].dataType)) for n in arrow[1:]]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), *columns], names=arrow)
                    keys, rows, held = [], [], 0

    return taken.mapInArrow(run, schema).withColumnRenamed("key", key)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BooleanType: pa.bool_()}[type(kind)]


def chunk_documents(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``CHUNK``): the chunks of each document, by ``chunk_text``; ``docs`` may have ``pages`` (``PAGES``) and ``blocks`` (``BLOCKS``) of a parser.

    Places count code points of the canonical text. Null and empty texts have no chunks; nor have documents whose pages or
    blocks have a problem (``parser_problem``). Repeated rows are each cut; further columns are not read. A very long text is cut in time in proportion to it.
    """
    return _rows(docs, key, text, lambda t, p: chunk_text(t, config, p), CHUNK)


def document_units(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, unit, start, end, type, path): the block units that cover each text, those of its parser's pages and blocks where it has any."""

    def made(t: str, parser: Parser) -> list[dict]:
        units = parser.units(Text(t)) if parser.pages or parser.blocks else Y.Lines(t).units()
        return [{"unit": k, "start": u.start, "end": u.end, "type": u.type, "path": json.dumps(u.path, ensure_ascii=False)} for k, u in enumerate(units)]

    return _rows(docs, key, text, made, "unit int, start int, end int, type string, path string")


def document_pieces(docs: DataFrame, config: Config = Config(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, piece, start, end, type, reason, context): the units, those longer than a child in parts; as ``document_units`` otherwise."""

    def made(t: str, parser: Parser) -> list[dict]:
        whole = Text(t)
        units = parser.units(whole) if parser.pages or parser.blocks else Y.Lines(t).units()
        parts = [p for u in units for p in Y.cut_unit(whole, u, config.child, config.protected)]
        return [{"piece": k, "start": p.start, "end": p.end, "type": p.type, "reason": p.reason, "context": p.context} for k, p in enumerate(parts)]

    return _rows(docs, key, text, made, "piece int, start int, end int, type string, reason string, context string")
