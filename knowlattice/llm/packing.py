"""Packing token sequences by non-negative least squares over length combinations.

Each document is cut into whole windows and one remainder. In groups of bounded size, combinations of two or three
remainder lengths that fill a window are enumerated, the repeats of each are found by non-negative least squares
against the histogram of lengths, rounded, and dealt out. Remainders that are left over are cut at powers of two
and packed greedily, so what is wasted does not depend on how the lengths are distributed.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import column, map_text, written

VOCABULARY = "byte_bpe_50k"
WINDOW = 2048
END = 1
#: Lengths are counted in steps of this many tokens, rounded up.
STEP = 8
#: A remainder that no combination takes is cut into powers of two from half a window to this, and a rest below.
LEAST_CUT = 64
#: Rows whose remainders are packed together, on average at most.
GROUP_ROWS = 8_192
SWEEPS = 40


class Encoder:
    """Ids of ``<name>.json`` as its library gives them, by the same vocabulary's faster reader where both agree."""

    def __init__(self, name: str):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text and any(s in text for s in self.special):
            found = self.library.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_ordinary(text)
        found.append(END)
        return np.array(found, "<u4")


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def cut_lengths(rest: int, window: int) -> list[int]:
    """The powers of two in ``rest`` from half a window down to ``LEAST_CUT``, then what is left."""
    parts = [p for p in (window >> i for i in range(1, window.bit_length())) if p >= LEAST_CUT and rest & p]
    left = rest - sum(parts)
    return parts + [left] * (left > 0)


def combinations_of(present: np.ndarray, units: int) -> list[tuple[int, ...]]:
    """Two or three of the present lengths (in units) that fill ``units`` exactly."""
    have = {int(b) for b in present}
    lengths = sorted(have)
    pairs = [(a, units - a) for a in lengths if 2 * a <= units and units - a in have]
    triples = [(a, b, units - a - b) for i, a in enumerate(lengths) if 3 * a <= units for b in lengths[i:] if a + 2 * b <= units and units - a - b in have]
    return ([(units,)] if units in have else []) + pairs + triples


def repeats(histogram: np.ndarray, combos: list[tuple[int, ...]]) -> np.ndarray:
    """Non-negative least squares: how often to repeat each combination, by coordinate descent on |A x - h|."""
    x, left = [0.0] * len(combos), histogram.astype(float).tolist()
    columns = []
    for c in combos:
        count: dict[int, int] = {}
        for b in c:
            count[b] = count.get(b, 0) + 1
        columns.append((list(count.items()), sum(v * v for v in count.values())))
    scale = max(1.0, float(histogram.sum()))
    for _ in range(SWEEPS):
        moved = 0.0
        for k, (entries, norm) in enumerate(columns):
            step = max(-x[k], sum(left[b] * v for b, v in entries) / norm)
            if step:
                x[k] += step
                moved += abs(step)
                for b, v in entries:
                    left[b] -= v * step
        if moved < 1e-3 * scale:
            break
    return np.array(x)


def plan(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """Pieces (item, part, sequence, offset) of items of 1 to ``window`` - 1 tokens; part -1 is the whole item, others count ``cut_lengths``."""
    units = window // STEP
    unit = -(-lengths // STEP)
    order = np.argsort(unit, kind="stable")
    waiting = {int(b): order[a:z].tolist() for b, a, z in zip(*_runs(unit[order]))}
    combos = combinations_of(np.unique(unit), units)
    pieces: list[tuple[int, int, int, int]] = []
    sequence = 0
    if combos:
        x = repeats(np.bincount(unit, minlength=units + 1), combos)
        for k in np.argsort(-x, kind="stable"):
            times = int(x[k] + 0.5)
            if not times:
                break
            for _ in range(times):
                taken = []
                for b in combos[k]:
                    if not waiting[b]:
                        break
                    taken.append(waiting[b].pop())
                else:
                    offset = 0
                    for item in taken:
                        pieces.append((item, -1, sequence, offset))
                        offset += int(lengths[item])
                    sequence += 1
                    continue
                for b, item in zip(combos[k], taken):
                    waiting[b].append(item)
                break
    left = [(length, item, part) for items in waiting.values() for item in items for part, length in enumerate(cut_lengths(int(lengths[item]), window))]
    left.sort(key=lambda p: -p[0])
    # Powers of two in falling order fill windows exactly; the rests below the least of them then fill up what is open.
    offset = 0
    for length, item, part in left:
        if offset + length > window:
            sequence, offset = sequence + 1, 0
        pieces.append((item, part, sequence, offset))
        offset += length
    return pieces


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.diff(values, prepend=values[0] - 1 if len(values) else 0))
    return values[first], first, np.append(first[1:], len(values))


_ITEMS = "doc_tokens long, whole_crcs array<long>, rest_crc long, cut_crcs array<long>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, text: str = "text", window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """Per row its id, number of ids, and CRC-32 of the ids of each whole window, of the remainder, and of the remainder's cuts."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        totals, whole, rests, cuts = [], [], [], []
        for t in column(batch, text).to_pylist():
            ids = encoder(name).ids(t or "")
            full = len(ids) // window * window
            totals.append(len(ids))
            whole.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, full, window)])
            rest = ids[full:]
            rests.append(zlib.crc32(rest.tobytes()))
            found, at = [], 0
            for n in cut_lengths(len(rest), window):
                found.append(zlib.crc32(rest[at : at + n].tobytes()))
                at += n
            cuts.append(found)
        lists = pa.list_(pa.int64())
        return [pa.array(totals, pa.int64()), pa.array(whole, lists), pa.array(rests, pa.int64()), pa.array(cuts, lists)]

    return map_text(docs.select("doc_id", text), compute, _ITEMS, text, (text,))


def _pack_group(items: pa.Table, window: int) -> pa.Table:
    total = items["doc_tokens"].to_numpy()
    rest = total % window
    pieces = np.array(plan(rest, window), np.int64).reshape(-1, 4)
    item, part, sequence, offset = pieces.T
    base = (total - rest)[item]
    start, length = base.copy(), rest[item].copy()
    crc = items["rest_crc"].to_numpy()[item].copy()
    for i in np.flatnonzero(part >= 0):
        parts = cut_lengths(int(rest[item[i]]), window)
        start[i] += sum(parts[: part[i]])
        length[i] = parts[part[i]]
        crc[i] = items["cut_crcs"][int(item[i])][int(part[i])].as_py()
    ids = items["doc_id"].take(pa.array(item))
    group = items["group"][0].as_py() if items.num_rows else 0
    return pa.table([ids, start, length, crc, total[item], sequence + (group << 32), offset], names=[f.split()[0] for f in PIECES.split(", ")])


def pack(docs: DataFrame, text: str = "text", window: int = WINDOW, name: str = VOCABULARY) -> DataFrame:
    """Every row's ids (of ``text``, then id 1) as pieces placed in sequences of at most ``window`` ids.

    Columns ``PIECES``: document, first id's place in it, number of ids, CRC-32 of the ids (little-endian unsigned
    32-bit), the document's ids, sequence, and the place there (gapless from 0). Each id lies in exactly one piece.
    Null and empty texts are one id; ids of documents may be null or repeat; an empty table has no pieces. Only
    ``doc_id`` and the text are read. ``window`` is a power of two.

    The texts are read and tokenised once; the rows that are packed hold lengths and checksums only.
    """
    items = written(tokenised(docs.withColumn("doc_id", F.col("doc_id").cast("long")), text, window, name), "tokenised")
    groups = max(1, -(-items.count() // GROUP_ROWS))
    whole = items.select("doc_id", "doc_tokens", F.posexplode("whole_crcs").alias("k", "ids_crc32")).select(
        "doc_id",
        (F.col("k") * F.lit(window)).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(1 << 61) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    rests = items.where(F.col("doc_tokens") % window > 0).select(
        "doc_id", "doc_tokens", "rest_crc", "cut_crcs", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("group")
    )
    packed = rests.groupBy("group").applyInArrow(lambda t: _pack_group(t, window), PIECES)
    return whole.unionByName(packed)
