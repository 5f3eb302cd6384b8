"""Benchmark decontamination: an FM-index for each shard of the training texts, searched with the test phrases.

A shard is a slice of whole texts inside one task (about ``SHARD_BYTES``), so nothing is shuffled and a lost
executor costs only its slices. The index is over words: suffix array, Burrows-Wheeler transform, wavelet
matrix for ranks, and every ``SAMPLE``-th text position kept to locate matches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, map_text, ranges, span_hashes, text_bytes

WINDOW = 10
SHARD_BYTES = 4 << 20
SEGMENT_WORDS = 1 << 20
SAMPLE = 16
#: Bytes of benchmark text that one pass takes; a larger benchmark is searched in several passes over the texts.
PHRASE_BYTES = 8 << 20

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x80:] = True
_WORD_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

RESULT = "n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"


def lower(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte and row of each word of texts that stand end to end."""
    low = _LOWER[raw]
    inside = _WORD_BYTE[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if len(raw) else inside
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if len(raw) else inside
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(at, start, "right") - 1
    return span_hashes(low, start, end), start, end, row


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose last one is unique, by prefix doubling; only tied suffixes are sorted again."""
    n = len(t)
    bits = max(1, int(t.max()).bit_length())
    depth = max(1, 63 // bits) if bits < 32 else 1
    depth = min(depth, 3)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([t.astype(np.uint64), np.zeros(depth, np.uint64)])
    for j in range(depth):
        key = (key << np.uint64(bits)) | padded[j : j + n]
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    slot = np.arange(n)
    ordered = key[sa]
    while True:
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = np.maximum.accumulate(np.where(new, slot, 0))
        rank[sa[slot]] = first
        tied = ~(new & np.concatenate([new[1:], [True]]))
        slot = slot[tied]
        if not len(slot):
            return sa
        at = sa[slot]
        further = at + depth
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0).astype(np.uint64)
        order = np.argsort(key)
        sa[slot] = at[order]
        ordered = key[order]
        depth *= 2


class FMIndex:
    """FM-index of symbol sequences, each ended by a separator of its own."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        sa = suffix_array(symbols)
        self.n = n
        self.bwt = symbols[sa - 1]
        counts = np.bincount(symbols)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        s = self.bwt.astype(np.int32)
        for level in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, n - int(ones[-1]), ones))
            s = np.concatenate([s[~bit], s[bit]])
        kept = sa % SAMPLE == 0
        self.kept = kept
        self.sampled = sa[kept]
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before its position."""
        start = np.zeros_like(position)
        for level, zeros, ones in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[start], ones[position]
            start = np.where(bit, zeros + a, start - a)
            position = np.where(bit, zeros + b, position - b)
        return position - start

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of patterns (rows, filled from the left): those that occur, and their rows of the suffix array."""
        live = np.arange(len(patterns))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for step in range(int(length.max(initial=0))):
            at = length[live] - 1 - step
            on = at >= 0
            symbol = patterns[live, np.maximum(at, 0)]
            low = np.where(on, self.before[symbol] + self.rank(symbol, low), low)
            high = np.where(on, self.before[symbol] + self.rank(symbol, high), high)
            found = low < high
            live, low, high = live[found], low[found], high[found]
        return live, low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: steps back until a sampled one."""
        position, todo, row, steps = np.zeros(len(row), np.int64), np.arange(len(row)), row.copy(), 0
        while len(todo):
            done = self.kept[row]
            position[todo[done]] = self.sampled[self.kept_before[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            symbol = self.bwt[row]
            row = self.before[symbol] + self.rank(symbol, row)
            steps += 1
        return position


@dataclass
class Phrases:
    """Distinct windows of the benchmark items: word hashes, lengths, and the items each comes from."""

    vocabulary: np.ndarray
    windows: np.ndarray
    length: np.ndarray
    owner_at: np.ndarray
    owner: np.ndarray
    names: list[str]


def phrases(item_ids: list, texts: list[str | None], window: int = WINDOW) -> Phrases:
    """The windows of ``window`` consecutive words of each text; a shorter text is one window, one without words none."""
    names = sorted({str(i) for i in item_ids if i is not None})
    number = {name: k for k, name in enumerate(names)}
    raw, at = text_bytes(pa.array(texts, pa.string()))
    hashes, _, _, row = words(raw, at)
    counts = np.bincount(row, minlength=len(texts))
    begin = np.cumsum(counts) - counts
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    size = np.minimum(counts, window)
    many = np.where(counts > 0, counts - size + 1, 0)
    start, length = ranges(begin, many), np.repeat(size, many)
    item = np.repeat(np.array([number.get(str(i), -1) if i is not None else -1 for i in item_ids], np.int64), many)
    grid = np.full((len(start), window), -1, np.int64)
    for j in range(window):
        on = j < length
        grid[on, j] = ids[start[on] + j]
    windows, which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
    pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
    pairs = pairs[pairs[:, 1] >= 0]
    return Phrases(vocabulary, windows, (windows >= 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1], names)


def occurrences(hashes: np.ndarray, row: np.ndarray, query: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Window and first word of each occurrence in texts given as word hashes; ``row`` rises along them."""
    found_window, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    overlap = query.windows.shape[1] - 1
    for begin in range(0, len(hashes), SEGMENT_WORDS):
        part = slice(begin, begin + SEGMENT_WORDS + overlap)
        vocabulary, ids = np.unique(hashes[part], return_inverse=True)
        ends = np.flatnonzero(np.diff(row[part], append=-1)) + 1
        texts = len(ends)
        place = np.arange(len(ids)) + np.searchsorted(ends, np.arange(len(ids)), "right")
        symbols = np.empty(len(ids) + texts, np.int64)
        symbols[place] = ids + texts
        symbols[ends + np.arange(texts)] = np.arange(texts)
        index = FMIndex(symbols)
        slot = np.searchsorted(vocabulary, query.vocabulary)
        known = vocabulary[np.minimum(slot, len(vocabulary) - 1)] == query.vocabulary
        symbol_of = np.append(np.where(known, slot + texts, -1), 0)
        grid = symbol_of[query.windows]
        usable = np.flatnonzero((grid >= 0).all(1))
        live, low, high = index.search(grid[usable], query.length[usable])
        position = index.locate(ranges(low, high - low))
        word = np.empty(len(symbols), np.int64)
        word[place] = np.arange(len(ids))
        at = word[position] + begin
        which = np.repeat(usable[live], high - low)
        own = at < begin + SEGMENT_WORDS
        found_window.append(which[own])
        found_at.append(at[own])
    return np.concatenate(found_window), np.concatenate(found_at)


def _search(batch: pa.RecordBatch, query: Phrases, text: str, more: bool) -> list[pa.Array]:
    """The result columns of one slice; with ``more``, joined with those that an earlier pass has left in it."""
    raw, at = text_bytes(column(batch, text))
    hashes, first, end, row = words(raw, at)
    n = batch.num_rows
    n_words = np.bincount(row, minlength=n)
    which, where = occurrences(hashes, row, query) if len(hashes) and len(query.windows) else (np.zeros(0, np.int64),) * 2
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, where, 1)
    np.add.at(change, where + query.length[which], -1)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    if more:
        earlier = column(batch, "spans")
        base = np.repeat(points[at[:-1]], earlier.value_lengths().to_numpy())
        word_points, flat = points[first], earlier.flatten()
        np.add.at(change, np.searchsorted(word_points, base + flat.field("start").to_numpy()), 1)
        np.add.at(change, np.searchsorted(word_points, base + flat.field("end").to_numpy()), -1)
    hit = np.cumsum(change[:-1]) > 0
    n_hit = np.bincount(row[hit], minlength=n)
    # Runs of hit words in one row are the merged spans; offsets are code points of the row's text.
    previous = np.concatenate([[False], hit[:-1]]) & (np.diff(row, prepend=-1) == 0)
    following = np.concatenate([hit[1:], [False]]) & (np.diff(row, append=-1) == 0)
    opens, closes = np.flatnonzero(hit & ~previous), np.flatnonzero(hit & ~following)
    base = points[at[row[opens]]]
    spans = pa.StructArray.from_arrays([pa.array(points[first[opens]] - base), pa.array(points[end[closes]] - base)], names=["start", "end"])
    span_at = np.searchsorted(row[opens], np.arange(n + 1))
    owners = query.owner_at[which + 1] - query.owner_at[which]
    pair = np.unique(np.stack([np.repeat(row[where], owners), query.owner[ranges(query.owner_at[which], owners)]], 1), axis=0)
    item_at = np.searchsorted(pair[:, 0], np.arange(n + 1))
    items = pa.ListArray.from_arrays(pa.array(item_at, pa.int32()), pa.array([query.names[i] for i in pair[:, 1]], pa.string()))
    if more:
        items = pa.array([sorted({*a, *b}) for a, b in zip(items.to_pylist(), column(batch, "items").to_pylist())], pa.list_(pa.string()))
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
        items,
    ]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with the columns of ``RESULT``: words, words inside benchmark windows, merged spans, items.

    A word is a run of digits, ASCII letters (either case alike) and non-ASCII characters. Spans are half-open
    code-point ranges of the text. Null and empty texts have no words, spans or items; repeated rows are each
    judged; an empty benchmark or table is allowed; a benchmark row without id marks words but names no item.
    Columns of ``docs`` that are named like a result give way to it.

    The phrases are sent to the executors in blocks of at most ``PHRASE_BYTES`` of text: a benchmark beyond that
    is searched in further passes, whose spans, counts and items are merged.
    """
    sc = docs.sparkSession.sparkContext
    item = F.col("item_id").cast("string").alias("item_id")
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // PHRASE_BYTES))
    for k in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.select(item, "text").collect()
        query = sc.broadcast(phrases([r[0] for r in rows], [r[1] for r in rows], window))
        drop = () if keep_text or k < blocks - 1 else (text,)
        docs = map_text(docs, lambda batch, q=query, more=k > 0: _search(batch, q.value, text, more), RESULT, text, drop, SHARD_BYTES)
    return docs


def without_spans(text: Column, spans: Column) -> Column:
    """The text with the spans cut out."""
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.substring(
            text,
            F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end"].cast("int") + 1),
            (F.when(i == F.size(spans), F.length(text)).otherwise(F.get(spans, i)["start"].cast("int")) - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"].cast("int"))),
        ),
    )
    return F.when(F.size(spans) > 0, F.array_join(gaps, "")).otherwise(text)
