"""Where one text may be cut: its lines, block units, inline ranges that stay whole, and cuts at the dearest separator.

A text's lines are classified once; from them tables of the next line of each kind are made, so that a unit is found by a
few look-ups whatever its length. Separators are searched backwards from where a cut is wanted, no further than it may be. All
work is linear in the text, but for the sorting of what was found.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import regex

# White space, patterns of lines, separators (dearest first), and sentence ends.
SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = f"[{SPACE}]"
FENCE = re.compile(rf"{_S}*(?:```|~~~)")
HEADING = re.compile(rf"{_S}{{0,3}}(#{{1,6}}){_S}+([^\n\r\u2028\u2029]+?){_S}*#*{_S}*\Z")
NUMBERED = re.compile(rf"{_S}*(?:(?:[0-9]+(?:\.[0-9]+){{0,5}})[.)]?|第{_S}*[一二三四五六七八九十百千万0-9]+{_S}*[章节]|(?:chapter|section|kapitel){_S}+[0-9]+){_S}+[^{SPACE}]", re.IGNORECASE)
RULE = re.compile(rf"{_S}*[-*_](?:{_S}*[-*_]){{2,}}{_S}*\Z")
DASHES = re.compile(r":?-{3,}:?\Z")
FORMULA_START = re.compile(rf"{_S}*(?:\$\$|\\\[|\\begin\{{[^}}]+\}})")
FORMULA_END = re.compile(rf"(?:\$\$|\\\]|\\end\{{[^}}]+\}}){_S}*\Z")
ENVIRONMENT_END = re.compile(rf"\\end\{{[^}}]+\}}{_S}*\Z")
SEPARATORS = [regex.compile(f"(?r){p}") for p in (r"\n\n", r"\n", "[。！？；，.!?,;:：]", _S)]
SENTENCE_END = regex.compile("(?r)[\n。！？.!?；;]")
INLINE = [re.compile(p) for p in (r"\$\$[\s\S]*?\$\$", r"\\\[[\s\S]*?\\\]", r"\\begin\{[^}]+\}[\s\S]*?\\end\{[^}]+\}", r"\$[^$\n]+\$")]
CLOSERS = ["$$", "\\]", "\\end{", "$"]
PROTECTED = ("code", "formula", "table")

_TRIM = "".join(chr(c) for a, _, b in re.findall(r"(.)(-(.))?", SPACE, re.S) for c in range(ord(a), ord(b or a) + 1))


def trim(s: str) -> str:
    return s.strip(_TRIM)


def cells(line: str) -> list[str]:
    """What a line's pipes part, without one at either end; empty where there is none."""
    if "|" not in line:
        return []
    return trim(line).removeprefix("|").removesuffix("|").split("|")


def is_row(line: str) -> bool:
    return len(cells(line)) >= 2


def is_separator(line: str) -> bool:
    found = cells(line)
    return len(found) >= 2 and all(DASHES.match(trim(c)) for c in found)


def is_table_line(line: str) -> bool:
    if not is_row(line):
        return False
    short = trim(line)
    return short[0] == "|" or short[-1] == "|" or len(cells(line)) >= 3 or bool(re.search(rf"{_S}\|{_S}", short)) or is_separator(line)


def is_whole_formula(line: str) -> bool:
    """A formula that ends in the line it begins in."""
    short = trim(line)
    if short in ("$$", "\\["):
        return False
    if short.startswith("$$"):
        return "$$" in short[2:]
    return short.endswith("\\]") if short.startswith("\\[") else short.startswith("\\begin{") and bool(ENVIRONMENT_END.search(short))


def is_capitals(line: str) -> bool:
    short = trim(line)
    return len(short) <= 100 and short == short.upper() and 4 <= len(short) + sum(c > "\uffff" for c in short) <= 100 and bool(re.search("[A-Z]", short))


def is_marker(line: str) -> bool:
    """A line that begins a section where there are no Markdown headings."""
    return "\f" in line or bool(NUMBERED.match(line) or RULE.match(line)) or is_capitals(line)


def heading(line: str) -> tuple[int, str] | None:
    found = HEADING.match(line) if "#" in line else None
    return (len(found[1]), trim(found[2])) if found else None


@dataclass
class Span:
    """A range of a text: what it is, why it was cut, and what the reader of a part must know."""

    start: int
    end: int
    type: str
    group: str | None = None
    reason: str | None = None
    forced: bool = False
    part: int | None = None
    parts: int | None = None
    context: str | None = None
    header: str | None = None
    path: tuple = ()

    @property
    def protected(self) -> bool:
        return self.type in PROTECTED

    @property
    def size(self) -> int:
        return self.end - self.start


class Lines:
    """The lines of a stretch of a text: where they start and end (with their line feed), and what they are."""

    def __init__(self, text: str, base: int = 0):
        self.text = text.split("\n")
        self.start = list(accumulate((len(t) + 1 for t in self.text), initial=base))[:-1]
        self.end = [*self.start[1:], base + len(text)]

    @cached_property
    def fenced(self) -> list[bool]:
        """Lines of code: fences, and lines behind an odd number of them."""
        fence = [("```" in t or "~~~" in t) and bool(FENCE.match(t)) for t in self.text]
        return [a or b % 2 == 1 for a, b in zip(fence, accumulate(fence))]

    def __len__(self) -> int:
        return len(self.text)

    def units(self) -> Iterator[Span]:
        """Ranges that cover the lines: code, formula, table, heading, paragraph or blank, by their first line."""
        n, text = len(self), self.text
        blank = [not trim(t) for t in text]
        # Patterns are only tried on lines that hold their signs.
        fence = [("```" in t or "~~~" in t) and bool(FENCE.match(t)) for t in text]
        formula = [("$$" in t or "\\" in t) and bool(FORMULA_START.match(t)) for t in text]
        row = [is_row(t) for t in text] if any("|" in t for t in text) else [False] * n
        table = [r and (is_table_line(t) or is_separator(after)) for t, r, after in zip(text, row, [*text[1:], ""])] if any(row) else row
        head = [heading(t) is not None for t in text]
        next_fence = _next(fence)
        next_end = _next([bool(FORMULA_END.search(t)) for t in text]) if any(formula) else []
        next_other = _next([not (r or b) for r, b in zip(row, blank)]) if any(table) else []
        next_block = _next([a or b or c or d for a, b, c, d in zip(fence, formula, table, head)])
        next_blank, next_filled = _next(blank), _next([not b for b in blank])
        i = 0
        while i < n:
            if fence[i]:
                kind, j = "code", next_fence[i + 1] + 1
            elif formula[i]:
                kind, j = "formula", i + 1 if is_whole_formula(text[i]) else next_end[i + 1] + 1
            elif table[i]:
                kind, j = "table", next_other[i + 1]
            else:
                kind = "heading" if head[i] else "blank" if blank[i] else "paragraph"
                gap, block = next_blank[i + 1], next_block[i + 1]
                j = next_filled[gap] if gap < block else block
            j = min(j, n)
            if self.end[j - 1] > self.start[i]:
                yield Span(self.start[i], self.end[j - 1], kind)
            i = j

    def headings(self) -> list[tuple[int, tuple]]:
        """Where sections begin by Markdown headings outside of code, each with the headings above it."""
        found, above = [], []
        for t, start, code in zip(self.text, self.start, self.fenced):
            own = None if code else heading(t)
            if own:
                above = [*[h for h in above if h[2] < own[0]], ("heading", own[1], own[0])]
                found.append((start, tuple(above)))
        return found

    def markers(self) -> list[tuple[int, tuple]]:
        """Where sections begin by numbered headings, rules, capitals and form feeds outside of code."""
        return [(s, (("section", trim(t.replace("\f", " ")), 0),)) for t, s, code in zip(self.text, self.start, self.fenced) if not code and s > 0 and is_marker(t)]


def _next(flags: list[bool]) -> list[int]:
    """For each place, and the one after the last, the first at or behind it where the flag is set (else the length)."""
    n = len(flags)
    found = [n] * (n + 2)
    if not any(flags):
        return found
    for i in range(n - 1, -1, -1):
        found[i] = i if flags[i] else found[i + 1]
    return found


def _links(text: str) -> Iterator[tuple[int, int]]:
    """``[...](...)`` with an optional ``!`` before; each bracket is looked at once."""
    done = 0
    for m in re.finditer(r"\]\(", text):
        if m.start() < done:
            continue
        close = text.find(")", m.end())
        if close < 0:
            return
        if close == m.end():
            continue
        start = text.find("[", max(done, text.rfind("]", done, m.start()) + 1), m.start())
        if start >= 0:
            done = close + 1
            yield start - (start > 0 and text[start - 1] == "!"), done


class Ranges:
    """Inline links and formulas, by start."""

    def __init__(self, text: str, base: int = 0):
        found = [(a + base, b + base) for a, b in _links(text)]
        for pattern, closer in zip(INLINE, CLOSERS) if "$" in text or "\\" in text else ():
            stop = text.rfind(closer) + len(closer)  # nothing that begins behind the last closer is ever closed
            stop = text.find("}", stop) + 1 if closer.endswith("{") else stop
            found += [(m.start() + base, m.end() + base) for m in pattern.finditer(text, 0, stop)]
        found.sort(key=lambda r: r[0])
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self.furthest = list(accumulate(self.ends, max))

    def around(self, place: int) -> tuple[int, int] | None:
        """The first range with ``place`` inside, not at its edges."""
        k = bisect_right(self.furthest, place)
        return (self.starts[k], self.ends[k]) if k < len(self.starts) and self.starts[k] < place else None


@dataclass
class Text:
    """A text with its inline ranges, made when they are first asked for."""

    text: str

    @cached_property
    def ranges(self) -> Ranges:
        return Ranges(self.text)

    def last_place(self, pattern: regex.Pattern, begin: int, up_to: int) -> int:
        """The last place up to ``up_to`` that stands behind what the pattern finds from ``begin`` on, or -1."""
        found = pattern.search(self.text, begin, up_to) if begin < up_to else None
        return found.end() if found else -1

    def cut(self, start: int, desired: int, end: int, ranges: Ranges | None = None, most: float = float("inf")) -> int:
        """The end of a piece from ``start``: at the last of the dearest separators in the upper 45 % up to ``desired``.

        What is left goes whole if it is no more than desired. A range around the cut is taken in if the piece
        then ends by ``end`` and has at most ``most`` code points, else the cut comes before it.
        """
        if desired >= end:
            return end
        around = ranges.around(desired) if ranges else None
        if around:
            if around[1] <= end and around[1] - start <= most:
                return around[1]
            desired = around[0] if around[0] > start else desired
        floor = start + int((desired - start) * 0.55)
        for k, pattern in enumerate(SEPARATORS):
            place = self.last_place(pattern, floor if k else max(floor - 1, start), desired)
            if place > floor:
                return place
        return desired

    def pieces(self, start: int, end: int, target: int, ranges: Ranges | None = None, most: float = float("inf")) -> Iterator[tuple[int, int]]:
        while start < end:
            cut = self.cut(start, min(end, start + target), end, ranges, most)
            yield start, cut
            start = cut

    def overlap_start(self, start: int, earliest: int) -> int:
        """Where a chunk from ``start`` begins if it takes in the end of the one before: the nearest line, paragraph or sentence from ``earliest`` on, else word, never inside an inline range."""
        begin = max(earliest - 1, 0)
        for pattern in (SENTENCE_END, SEPARATORS[3]):
            place = self.last_place(pattern, begin, start - 1)
            while place >= earliest and self.ranges.around(place):
                place = self.last_place(pattern, begin, place - 1)
            if place >= earliest and place >= 0:
                return place
        around = self.ranges.around(start)
        return around[0] if around and around[0] >= earliest else start


def cut_code(text: Text, unit: Span, target: int, most: int, atomic: bool = True) -> list[Span]:
    """A code block or formula: whole up to ``target``, and up to ``most`` where that is allowed, else groups of whole lines."""
    limit, kind = min(target, most), unit.type
    unit = _with(unit, group=unit.group or f"{kind}:{unit.start}:{unit.end}")
    if unit.size <= limit:
        return [unit]
    if atomic and unit.size <= most:
        return [_with(unit, reason="protected-atomic")]
    named = "code-block" if kind == "code" else kind
    whole, cut = f"{named}-size-limit" if unit.size > most else f"{kind}-line-group", f"{kind}-line-too-large"
    parts = [(a, b, cut if long else whole, long) for a, b, long in _grouped(text, _line_ranges(text, unit), limit)]
    language = re.match(rf"{_S}*(?:```|~~~){_S}*([^\n]*)", next((t for t in text.text[unit.start : unit.end].split("\n") if trim(t)), "")) if kind == "code" else None
    label = "Formula" if kind == "formula" else "Code block" + (f" ({trim(language[1])})" if language and trim(language[1]) else "")
    out = []
    for k, (a, b, reason, long) in enumerate(parts):
        told = f"{label} continuation (part {k + 1}/{len(parts)})"
        out.append(_with(unit, start=a, end=b, reason=reason, forced=long, part=k, parts=len(parts), context=told, path=joined(unit.path, (("continuation", told, 0),))))
    return out


def _with(span: Span, **changes) -> Span:
    return Span(**{**span.__dict__, **changes})


def _line_ranges(text: Text, unit: Span) -> list[tuple[int, int]]:
    lines = Lines(text.text[unit.start : unit.end], unit.start)
    return [(a, b) for a, b in zip(lines.start, lines.end) if b > a]


def _grouped(text: Text, ranges: Iterable[tuple[int, int]], limit: int, held: tuple[int, int] | None = None) -> Iterator[tuple[int, int, bool]]:
    """Neighbouring ranges together up to ``limit`` code points, after what is ``held``; longer ones cut by length (true)."""
    for a, b in ranges:
        if held and (b - a > limit or b - held[0] > limit):
            yield *held, False
            held = None
        if b - a > limit:
            yield from ((x, y, True) for x, y in text.pieces(a, b, limit))
        else:
            held = (held[0] if held else a, b)
    if held:
        yield *held, False


def cut_table(text: Text, unit: Span, target: int, most: int, header: str | None = None) -> list[Span]:
    """A table: groups of whole rows, each after the first with the header told. ``header`` is that of a table this is a later part of."""
    limit = min(target, most)
    unit = _with(unit, group=unit.group or f"table:{unit.start}:{unit.end}")
    lines = Lines(text.text[unit.start : unit.end], unit.start)
    rows = [k for k, t in enumerate(lines.text) if is_row(t)]
    body = unit.start
    if header is None:
        if not rows:
            return [unit] if unit.size <= limit else [_with(unit, start=a, end=b, reason="table-hard-split", forced=True) for a, b in text.pieces(unit.start, unit.end, limit)]
        ruled = len(rows) > 1 and is_separator(lines.text[rows[1]])
        body = lines.end[rows[1] if ruled else rows[0]]
        header, told = trim(text.text[unit.start : body]), True
    else:
        told = False
    # Rows of the body: each takes the lines up to the next row, the first also those before it.
    first = [lines.start[k] for k in rows if lines.end[k] > body]
    if not first:
        if unit.size <= limit:
            return [unit]
        if unit.size <= most:
            return [_with(unit, reason="protected-atomic")]
        parts = list(text.pieces(unit.start, unit.end, limit))
        return [_with(unit, start=a, end=b, reason="table-header-too-large", forced=True, part=k, parts=len(parts), header=header) for k, (a, b) in enumerate(parts)]
    ranges = list(zip([body, *first[1:]], [*first[1:], unit.end]))
    heads: list[tuple[int, int, bool]] = []
    held = None
    if told and body - unit.start > most:
        heads = [(a, b, True) for a, b in text.pieces(unit.start, body, limit)]
    elif told and ranges[0][1] - body <= limit:  # the header and the first row stay together
        held, ranges = (unit.start, ranges[0][1]), ranges[1:]
    elif told:
        heads = [(unit.start, body, False)]
    n_heads = len(heads) or int(told)
    groups = [*heads, *_grouped(text, ranges, limit, held)]
    out = []
    for k, (a, b, long) in enumerate(groups):
        reason = ("table-header-too-large" if b <= body and told else "table-row-too-large") if long else "table-row-split" if k else "protected-atomic" if b - a > limit else None
        further = told and k >= n_heads
        path = joined(unit.path, (("continuation", "Table header continuation", 0),)) if further else unit.path
        out.append(_with(unit, start=a, end=b, reason=reason, forced=long, part=k, parts=len(groups), header=header, context=f"Table header:\n{header}" if further else None, path=path))
    return out


def cut_unit(text: Text, unit: Span, target: int, most: int) -> list[Span]:
    """The unit, or its parts where it is longer than ``target`` (a protected one than ``most``)."""
    if unit.size <= (min(target, most) if unit.protected else target):
        return [unit]
    if unit.type == "table":
        return cut_table(text, unit, target, most)
    if unit.protected:
        return cut_code(text, unit, target, most)
    return [_with(unit, start=a, end=b, reason="length-split", forced=True) for a, b in text.pieces(unit.start, unit.end, target, text.ranges, most)]


def joined(*paths: tuple) -> tuple:
    """The nodes of the paths, each once."""
    return tuple(dict.fromkeys(node for path in paths for node in path)) if any(paths) else ()


def path_header(path: tuple) -> str:
    """A path as lines to put before a chunk."""
    say = {"page": lambda t, n: f"Page {n}", "heading": lambda t, n: f"{'#' * max(1, min(6, n))} {t}", "block": lambda t, n: f"{re.sub('[-_]+', ' ', t)} block"}
    return "\n".join(filter(None, (say.get(kind, lambda t, n: t)(title, number).strip() for kind, title, number in path)))
