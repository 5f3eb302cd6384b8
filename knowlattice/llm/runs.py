"""Periodic runs of words: every maximal stretch that repeats with a smallest period, found by the runs theorem.

The texts of a slice are one sequence of symbols, each text ended by a separator of its own. Of every position the
longest Lyndon word is taken under both orders of the symbols: it ends before the next smaller (or next greater) value of
the inverse suffix array. Each run has a position whose longest Lyndon word is one period of it; such a root is
extended to both sides by longest common prefixes, which are range minima over the LCP array.

One narrow pass: a text is looked at whole by one task, nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blank_words, column, map_text, ranges, text_bytes

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_BLOCK = 8
#: Rounds of pointer jumping before what is left is searched by range minima.
_ROUNDS = 48


class RangeMin:
    """Range minima over an array: a sparse table of the minima of blocks, and the blocks' own ends value by value."""

    def __init__(self, values: np.ndarray):
        self.values = values
        filled = np.full(-(-len(values) // _BLOCK) * _BLOCK, np.iinfo(values.dtype).max, values.dtype)
        filled[: len(values)] = values
        self.levels = [filled.reshape(-1, _BLOCK).min(1)]
        while (half := 1 << len(self.levels) - 1) * 2 <= len(self.levels[0]):
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The smallest of values[first..last], ends included."""
        found = np.minimum(self.values[first], self.values[last])
        a, b = first // _BLOCK + 1, last // _BLOCK  # whole blocks a..b-1
        for k in range(1, _BLOCK):
            found = np.minimum(found, self.values[np.minimum(first + k, np.minimum(a * _BLOCK - 1, last))])
            found = np.minimum(found, self.values[np.maximum(last - k, np.maximum(b * _BLOCK, first))])
        many = np.flatnonzero(b > a)
        if len(many):
            a, b = a[many], b[many]
            level = np.log2(b - a).astype(np.int64)
            level -= (1 << level) > b - a
            whole = np.empty(len(many), self.values.dtype)
            for k in np.unique(level):
                on = level == k
                whole[on] = np.minimum(self.levels[k][a[on]], self.levels[k][b[on] - (1 << k)])
            found[many] = np.minimum(found[many], whole)
        return found


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse suffix array and LCP array (of each suffix with the one before it in order; 0 for the first).

    Prefix doubling, where only tied suffixes are sorted again; two that part in a round share the length so far
    and what their rests share, which earlier rounds have found. The last symbol must occur nowhere else.
    """
    n, bits = len(symbols), max(1, int(symbols.max(initial=0)).bit_length())
    depth = 3 if bits <= 21 else 1
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(depth, np.uint64)])
    key = np.zeros(n, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    rank, lcp, slot, ordered = np.empty(n, np.int32), np.full(n, n, np.int32), np.arange(n), key[order]
    differ = ordered[1:] ^ ordered[:-1]
    shared = np.zeros(n - 1, np.int32)
    for j in range(1, depth):
        shared += differ >> np.uint64(bits * (depth - j)) == 0
    new = np.append(True, differ != 0)
    lcp[1:][new[1:]] = shared[new[1:]]
    lcp[0] = 0
    while True:
        rank[order[slot]] = np.maximum.accumulate(np.where(new, slot, 0))
        tied = ~(new & np.append(new[1:], True))
        # A group of ties is one stretch of slots: its first is new, so the next group's first is new too.
        slot, was_new = slot[tied], new[tied]
        if not len(slot):
            return rank, lcp
        at = order[slot]
        rest = rank[at + depth]
        by = np.argsort((rank[at].astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64), kind="stable")
        order[slot], rest = at[by], rest[by]
        parts = np.append(False, rest[1:] != rest[:-1]) & ~was_new
        apart = np.flatnonzero(parts)
        if len(apart):
            table = RangeMin(lcp)
            low, high = rest[apart - 1].astype(np.int64), rest[apart].astype(np.int64)
            lcp[slot[apart]] = depth + table.least(low + 1, high)
        new = was_new | parts
        depth *= 2


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length. Values differ.

    Places between a place and its pointer are known to be greater, so a pointer to a greater value may take over that
    value's pointer; what is still open after some rounds is bisected by range minima.
    """
    n = len(values)
    guarded = np.append(values, np.iinfo(values.dtype).min)
    to, still = np.append(np.arange(1, n + 1), n), np.arange(n)
    for _ in range(_ROUNDS):
        still = still[guarded[to[still]] > guarded[still]]
        if not len(still):
            return to[:n]
        to[still] = to[to[still]]
    table = RangeMin(guarded)
    low, high = to[still], np.full(len(still), n)  # the first smaller one is in low..high
    while (low < high).any():
        middle = (low + high) // 2
        inside = table.least(low, middle) < guarded[still]
        low, high = np.where(inside, low, np.minimum(middle + 1, high)), np.where(inside, middle, high)
    to[still] = low
    return to[:n]


def find(ids: np.ndarray, size: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Distinct runs (row, start, length, period), by row, start and period, in sequences of ``ids`` of ``size`` symbols each, end to end."""
    none = np.zeros((0, 4), np.int64)
    if not len(ids):
        return none
    rows = len(size)
    row = np.repeat(np.arange(rows), size)
    begin = np.cumsum(size + 1) - (size + 1)
    place = np.arange(len(ids)) + row
    symbols = np.empty(len(ids) + rows, np.int64)
    symbols[place] = ids.astype(np.int64) + rows
    symbols[begin + size] = np.arange(rows)
    rank, lcp = suffixes(symbols)
    table = RangeMin(lcp)
    first, stop = begin[row], (begin + size)[row]

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = rank[a].astype(np.int64), rank[b].astype(np.int64)
        return table.least(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)

    found = [none]
    for values in (rank, -rank):
        root = next_smaller(values)[place] - place
        # The root and its next repetition start in the same text; a run's words agree one period apart somewhere beside it.
        inside = np.flatnonzero(place + root < stop)
        at, period = place[inside], root[inside]
        agree = (symbols[at] == symbols[at + period]) | ((at > first[inside]) & (symbols[at - 1] == symbols[at + period - 1]))
        inside, at, period = inside[agree], at[agree], period[agree]
        if not len(at):
            continue
        ahead = common(at, at + period)
        # Backwards: the most places d such that d words from at - d on agree with those one period later.
        most = at - first[inside]
        low, high = np.zeros(len(at), np.int64), np.minimum(most, 1)
        open_ = high > 0
        while open_.any():  # in steps twice as long each time
            w = np.flatnonzero(open_)
            good = common(at[w] - high[w], at[w] - high[w] + period[w]) >= high[w]
            low[w[good]] = high[w[good]]
            more = good & (high[w] < most[w])
            high[w[more]] = np.minimum(high[w[more]] * 2, most[w[more]])
            high[w[good & ~more]] += 1
            open_[w[~more]] = False
        while (high - low > 1).any():
            w = np.flatnonzero(high - low > 1)
            middle = (low[w] + high[w]) // 2
            good = common(at[w] - middle, at[w] - middle + period[w]) >= middle
            low[w[good]], high[w[~good]] = middle[good], middle[~good]
        length = low + period + ahead
        long = (length >= least_words) & (length >= least_periods * period)
        found.append(np.stack([row[inside], at - low - first[inside], period, length], 1)[long])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 1, 3, 2]]


def find_runs(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with the columns of ``RESULT``: words, runs by start and period, and the collapsed text.

    A word is what blanks (space, tab to carriage return) part. A run has at least ``least_words`` words and
    ``least_periods`` (two or more) periods, and no neighbouring word extends it. ``start`` counts words from 0. The collapsed text is the
    words that are in no run beyond its first period, joined by one space. Null and empty texts have no words and
    an empty collapsed text. Repeated rows are each judged; a very long text is looked at whole, in memory in proportion
    to it; columns of ``docs`` named like a result give way to it.
    """
    if least_periods < 2:
        raise ValueError("a run has at least two periods")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, at = text_bytes(column(batch, text))
        words = blank_words(raw, at)
        runs = find(words.ids(raw), words.size, least_words, least_periods)
        run_at = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
        spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        change = np.zeros(len(words.start) + 1, np.int64)
        base = words.first[runs[:, 0]] + runs[:, 1]
        np.add.at(change, base + runs[:, 3], 1)
        np.add.at(change, base + runs[:, 2], -1)
        kept = np.cumsum(change[:-1]) == 0
        return [pa.array(words.size, pa.int64()), pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), spans), words.joined(raw, kept)]

    return map_text(docs, compute, RESULT, text, () if keep_text else (text,), chunk_bytes=2 << 20)
