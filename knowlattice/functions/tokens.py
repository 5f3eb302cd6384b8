"""Exact token counts of many stretches of one text, by a tokenizer file.

Byte-level vocabularies split a text into pieces (a word with the space before it, signs, white space) and merge bytes inside
of a piece only. So a text is split once, the tokens of a piece are asked of the library once and kept, and a stretch is a
difference of two sums but for its ends. How a piece is found depends on what follows, never on what stands before: from the
first place on where a stretch and the whole text both begin a piece, their pieces are the same.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right
from functools import cached_property, lru_cache
from itertools import accumulate

import regex
from tokenizers import Token, Tokenizer

#: Fixed value: how byte-level vocabularies split texts.
RUN = regex.compile(r"\s+")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.fullmatch(r"\s", c))
#: Pieces looked up last whose counts a worker keeps (as many from before stay within reach), and their code points at most.
KEPT, LONGEST = 400_000, 64


#: The printable characters that byte-level vocabularies write for bytes that have none of their own.
_OTHERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in (*range(33, 127), *range(161, 173), *range(174, 256)))}


class _Known(dict):
    """Tokens of pieces, asked of the library's model when they are first looked up; those not looked up for long are forgotten."""

    def __init__(self, library: Tokenizer):
        self.model, self.older = library.model, {}

    def asked(self, piece: str) -> list[Token]:
        plain = piece.isascii() and piece.isprintable()
        return self.model.tokenize(piece.replace(" ", chr(_OTHERS[32])) if plain else piece.encode().decode("latin-1").translate(_OTHERS))

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            n = len(self.asked(piece))
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts a text's tokens, and says where each ends, as the library of the file does; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding")) and all(t["special"] for t in spec.get("added_tokens", ()))
        #: Whether the file splits by ``PIECE``, with nothing before or after that.
        self.by_pieces = plain and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not spec["model"].get("dropout")
        self.known = _Known(self.library)
        self.checked: dict[str, bool] = {}
        self.splits = lru_cache(16)(self._splits)
        self.split = lru_cache(2)(self._split)
        self.whole = lru_cache(256)(lambda text: self(text)[0])
        self.ends = lru_cache(1 << 14)(self._ends)

    def __call__(self, text: str) -> tuple[int, list[int]]:
        found = self.library.encode(text, add_special_tokens=False)
        return len(found.ids), [b for _, b in found.offsets]

    def _ends(self, piece: str) -> list[int]:
        """Where the tokens of a piece end; those of ASCII have a byte, and so a code point, for each of their characters."""
        return list(accumulate(len(t.value) for t in self.known.asked(piece))) if piece.isascii() else self(piece)[1]

    def _agrees(self, c: str) -> bool:
        """Whether the library and ``PIECE`` take a code point for the same kind: letter, number, white space or sign."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        return all((len(split(a + c)) == 1) == (len(PIECE.findall(a + c)) == 1) for a in "a1!\t")

    def _splits(self, text: str) -> bool:
        """Whether the text's pieces are those of ``PIECE``."""
        if not self.by_pieces:
            return False
        found = set(text)
        for c in found - self.checked.keys():
            self.checked[c] = self._agrees(c)
        return all(map(self.checked.__getitem__, found))

    def _split(self, text: str) -> tuple[array, array]:
        """The places where pieces begin, and the text's end; and the tokens before each."""
        pieces = PIECE.findall(text)
        return array("q", accumulate(map(len, pieces), initial=0)), array("q", accumulate(map(self.known.__getitem__, pieces), initial=0))

    def stretch(self, text: str, start: int, end: int, prefix: str = "") -> Whole | Shifted:
        if not self.splits(prefix):
            return Whole(self, text, start, end, prefix)
        if self.splits(text):
            return Stretch(self, text, start, end, prefix)
        part = text[start:end]
        return Shifted(Stretch(self, part, 0, len(part), prefix), start) if self.splits(part) else Whole(self, text, start, end, prefix)


class Whole:
    """``text[start:end]``, with a prefix and a blank line before each stretch of it: every stretch is counted anew."""

    def __init__(self, count: Counter, text: str, start: int, end: int, prefix: str = ""):
        self.count, self.text, self.start, self.end = count, text, start, end
        self.lead = prefix + "\n\n" if prefix else ""

    def size(self, a: int, b: int) -> int:
        """The tokens of the prefix and ``text[a:b]``."""
        return self.count(self.lead + self.text[a:b])[0]

    @cached_property
    def _all_ends(self) -> list[int]:
        return [self.start + e for e in self.count(self.text[self.start : self.end])[1]]

    def end_of(self, a: int, n: int) -> int:
        """Where the ``n``-th of the text's tokens that end behind ``a`` ends, else the last."""
        return self._all_ends[min(bisect_right(self._all_ends, a) + n - 1, len(self._all_ends) - 1)]


class Stretch(Whole):
    """The same by the pieces of the whole text."""

    def __init__(self, count: Counter, text: str, start: int, end: int, prefix: str = ""):
        super().__init__(count, text, start, end, prefix)
        self.at, self.upto = count.split(text)
        self.tokens, self.begun = count.known.__getitem__, -1
        # White space at the end of what stands before is split together with what follows.
        k = len(self.lead)
        while k and self.lead[k - 1] in WHITE:
            k -= 1
        self.before, self.white = self._counted(self.lead[:k]), self.lead[k:]

    def _counted(self, text: str) -> int:
        return sum(map(self.tokens, PIECE.findall(text)))

    def _met(self, place: int) -> tuple[int, int]:
        """The first piece of the whole text that also begins where one does if the text began at ``place``; and the tokens before it."""
        n, j = 0, bisect_left(self.at, place)
        while self.at[j] != place:
            piece = PIECE.match(self.text, place)
            place, n = piece.end(), n + self.tokens(piece[0])
            j = bisect_left(self.at, place, j)
        return j, n

    def _begin(self, a: int) -> None:
        place, n = a, self.before
        if self.white and self.text[a] in WHITE:
            place = RUN.match(self.text, a).end()
            place -= place < len(self.text)  # the last white space before a sign or word is a piece of its own or begins the word's
            n += self.tokens(self.white + self.text[a:place])
        elif self.white:
            n += self.tokens(self.white[:-1]) + self.tokens(self.white[-1])
        j, more = self._met(place)
        self.begun, self.meets, self.less = a, self.at[j], n + more - self.upto[j]

    def _last(self, b: int) -> int:
        """The piece of the whole text where the last piece of a stretch up to ``b`` begins: white space at its end is one piece."""
        j = bisect_right(self.at, b - 1) - 1
        return j - (j > 0 and self.at[j] == b - 1 and self.text[b - 1] in WHITE and self.text[b - 2] in WHITE)

    def size(self, a: int, b: int) -> int:
        if a != self.begun:
            self._begin(a)
        j = self._last(b)
        place = self.at[j]
        if place < self.meets or place == a and self.white and self.text[b - 1] in WHITE:
            return self._counted(self.lead + self.text[a:b])
        if self.at[j + 1] == b:
            return self.less + self.upto[j + 1]
        count = self._counted if self.text[place] == "'" else self.tokens  # the beginning of a piece is one piece, but for an ending such as 're
        return self.less + self.upto[j] + count(self.text[place:b])

    def _ends_of(self, j: int) -> list[int]:
        place, after = self.at[j], self.at[j + 1]
        return [after] if self.upto[j + 1] - self.upto[j] == 1 else [place + e for e in self.count.ends(self.text[place:after])]

    @cached_property
    def _edges(self) -> tuple[int, int, int, int]:
        """The first piece of the whole text that is also one of this text, the tokens before it, its last piece, and the tokens before that."""
        first, n = self._met(self.start)
        last = self._last(self.end)
        return first, n, last, n + self.upto[last] - self.upto[first]

    @cached_property
    def _tail(self) -> list[int]:
        place = self.at[self._edges[2]]
        return [place + e for e in self.count(self.text[place : self.end])[1]]

    def end_of(self, a: int, n: int) -> int:
        first, head, last, tail = self._edges
        at, upto, less = self.at, self.upto, head - self.upto[first]
        if last < first or self.start < a < at[first]:
            return super().end_of(a, n)
        if a == self.start:
            k = n - 1
        elif a < at[last]:
            j = bisect_right(at, a) - 1
            k = less + upto[j] + bisect_right(self._ends_of(j), a) + n - 1
        else:
            k = tail + bisect_right(self._tail, a) + n - 1
        if k < head:
            return super().end_of(a, n)
        if k >= tail:
            return self._tail[min(k - tail, len(self._tail) - 1)]
        j = bisect_right(upto, k - less) - 1
        return self._ends_of(j)[k - less - upto[j]]


class Shifted:
    """A part of a text that is not split as a whole, by its own pieces; places are the text's."""

    def __init__(self, part: Stretch, base: int):
        self.part, self.base = part, base

    def size(self, a: int, b: int) -> int:
        return self.part.size(a - self.base, b - self.base)

    def end_of(self, a: int, n: int) -> int:
        return self.base + self.part.end_of(a - self.base, n)
