"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are one ragged array of symbols. In each round every pre-token finds its
lowest-rank pair of neighbours and merges all places of that pair at once, until no pre-token has a pair left;
what counts is how many symbols survive. Counts of pre-tokens are kept in a bounded table for the next batch.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import column, map_text

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a worker keeps; at more, it starts again.
KEPT = 400_000
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens of whole texts as the vocabulary file's library does (no added tokens; special strings in a text are one token each)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocabulary, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = ([vocabulary[p[i]] for p in pairs] for i in (0, 1))
        made = [vocabulary["".join(p)] for p in pairs]
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order, np.array(made, np.int64)
        names = _byte_symbols()
        self.inner = np.array([vocabulary[names[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[names[b] + self.suffix] for b in range(256)], np.int64)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.known: dict[str, int] = {}

    def merged(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        end = np.cumsum(size)
        symbol[end - 1] = self.last[raw[end - 1]]
        out = np.ones(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), size)
        while len(symbol) > 1:
            key = symbol[:-1] << 32 | symbol[1:]
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[slot] == key) & (word[:-1] == word[1:]), self.ranks[slot], _NONE)
            rank = np.append(rank, _NONE)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(word)))
            done = low == _NONE
            out[word[first[done]]] = length[done]
            low = np.repeat(low, length)
            here = (rank == low) & (low != _NONE)
            # In a run of overlapping places (aaa) every second one merges, from the left.
            run = here & ~np.concatenate([[False], here[:-1]])
            if here.sum() != run.sum():
                place = np.arange(len(here))
                begin = np.maximum.accumulate(np.where(run, place, 0))
                here &= (place - begin) % 2 == 0
            symbol = symbol.copy()
            symbol[here] = self.made[low[here]]
            stay = ~np.concatenate([[False], here[:-1]]) & (low != _NONE)
            symbol, word = symbol[stay], word[stay]
        if len(symbol):
            out[word[0]] = 1
        return out

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEPT:
            self.known = {}
            new = list(pieces)
        for i in range(0, len(new), 1 << 15):
            part = new[i : i + (1 << 15)]
            self.known.update(zip(part, self.merged([p.encode() for p in part]).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        pieces, extra = [], []
        for t in texts:
            parts = self.special.split(t) if "<|" in t else [t]
            extra.append(len(parts) - 1)
            found: list[str] = []
            for p in parts:
                if not p.isascii():
                    p = unicodedata.normalize("NFC", p).replace("Σ", "σ")
                found += self.split.findall(p.lower())
            pieces.append(found)
        self._learn(set(chain.from_iterable(pieces)))
        known = self.known
        return [sum(map(known.__getitem__, found)) + n for found, n in zip(pieces, extra)]


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of the whole text.

    Null and empty texts have 0 tokens. One narrow pass: nothing is shuffled. The file at ``path`` (a vocabulary
    with end-of-word suffixes) must be there on each worker.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = [t or "" for t in column(batch, text).to_pylist()]
        n = np.array(counter(path).count(texts), np.int64)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)]

    return map_text(docs, compute, "n_bytes long, n_tokens long, over_limit boolean", text, () if keep_text else (text,))
