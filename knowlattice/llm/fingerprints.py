"""Document fingerprints by winnowing, and the likeness of two of them.

Every run of ``K`` code points is hashed; of each ``W`` consecutive hashes the smallest is kept, the rightmost
of equal ones, with its position. Two texts that share ``W + K - 1`` code points in a row share a fingerprint
hash. A text of fewer than ``K`` code points is one run; an empty one has no hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, map_text, mix64, partitions, text_bytes

K = 16
W = 25
GUARANTEE = W + K - 1
_BASE = 0x9E6C63D0876A9A47
_LAST = np.uint64(2**64 - 1)
_CHUNK_POINTS = 1 << 20


def gram_hashes(cps: np.ndarray) -> np.ndarray:
    """Hash of the ``K`` code points from each place on (K a power of two: halves are joined)."""
    h, width = cps.astype(np.uint64) + np.uint64(1), 1
    while width < K:
        h = h[:-width] * np.uint64(pow(_BASE, width, 2**64)) + h[width:]
        width *= 2
    return mix64(h)


def winnow(cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept hashes and their positions in the text for texts of code points end to end; and where each text's begin."""
    size = np.diff(at)
    # Each text, shorter ones filled up to K, then W - 1 runs that no window prefers.
    room = np.maximum(size, np.where(size > 0, K, 0))
    place = np.cumsum(room + W + K) - (room + W + K)
    flat = np.zeros(int((room + W + K).sum()) + K, np.uint32)
    flat[np.arange(len(cps)) + np.repeat(place - at[:-1], size)] = cps
    short = (size > 0) & (size < K)
    flat[place[short] + size[short]] = 0x110000 + size[short]
    hashes = np.minimum(gram_hashes(flat), _LAST - np.uint64(1))
    n_grams = np.where(size > 0, room - K + 1, 0)
    n_windows = np.where(n_grams > 0, np.maximum(n_grams - W + 1, 1), 0)
    own = np.zeros(len(hashes) + 1, np.int8)
    np.add.at(own, place, 1)
    np.add.at(own, place + n_grams, -1)
    hashes = np.where(np.cumsum(own[:-1]) > 0, hashes, _LAST)
    best, where, width = hashes, np.arange(len(hashes)), 1
    while width < W:
        step = min(width, W - width)
        left, right = best[:-step], best[step:]
        best, where = np.where(right <= left, right, left), np.where(right <= left, where[step:], where[:-step])
        width += step
    use = np.zeros(len(best) + 1, np.int8)
    np.add.at(use, place, 1)
    np.add.at(use, place + n_windows, -1)
    chosen = where[np.flatnonzero(np.cumsum(use[:-1]) > 0)]
    chosen = chosen[np.diff(chosen, prepend=-1) != 0]
    first = np.searchsorted(chosen, np.append(place, len(flat)))
    return hashes[chosen], chosen - np.repeat(place, np.diff(first)), first


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes; two empty fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def encode(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def _each(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and positions of each text, many texts to an array at a time."""
    part, points = [], 0
    for i, t in enumerate(texts):
        part.append(t)
        points += len(t) + 64
        if points > _CHUNK_POINTS or i == len(texts) - 1:
            cps, at = code_points(*text_bytes(pa.array(part, pa.string())))
            hashes, positions, first = winnow(cps, at)
            for k in range(len(part)):
                yield hashes[first[k] : first[k + 1]], positions[first[k] : first[k + 1]]
            part, points = [], 0


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FINGERPRINT = "fingerprint string, positions array<int>"


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with their winnowing ``fingerprint`` (16 hex digits a hash, in text order) and the hashes' ``positions``.

    Null and empty texts have an empty fingerprint. Equal texts have equal fingerprints.
    """
    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        found = list(_each([t or "" for t in column(batch, text).to_pylist()]))
        return [pa.array([encode(h) for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.list_(pa.int32()))]

    return map_text(docs, compute, FINGERPRINT, text)


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def _cuts_up_to(key: Column, cuts: list[int], equal: bool) -> Column:
    """How many of the rising cuts are below ``key`` (or at most it): first in steps of whole groups, then in one group."""
    width = max(1, int(len(cuts) ** 0.5))
    passed = lambda values: F.size(F.filter(values, lambda c: c <= key if equal else c < key))
    whole = passed(F.lit(cuts[width - 1 :: width]).cast("array<long>")) * width
    return whole + passed(F.slice(F.lit(cuts).cast("array<long>"), whole + 1, F.lit(width)))


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of an edited text and of the next document by ascending ``doc_id``.

    Rows are dealt into ranges of (``doc_id``, hash of the text) once, with the first row of each range also sent to the
    range before it (to the last: the first of all), and read in order. Null ids come first; equal ids are ordered by
    their texts' hashes, and an id that fills several ranges is split among them; null texts are empty. A single
    document is its own next; an empty table has no rows. Very long texts are read whole, one at a time.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("hash", F.xxhash64("text"))
    n = 4 * partitions(spark)
    cuts = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).first()[0]
    if cuts is None:
        return spark.createDataFrame([], PAIRS)
    below, up_to = _cuts_up_to(F.col("key"), cuts, False), _cuts_up_to(F.col("key"), cuts, True)
    # An id that equals several cuts has as many ranges, filled by the rising hash of its texts.
    within = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * (up_to - below)).cast("int")
    docs = docs.withColumn("part", F.least(up_to, below + F.when(up_to > below, within + 1).otherwise(0)))
    # At most one row for each of the n ranges.
    firsts = docs.groupBy("part").agg(F.min(F.struct("key", "hash")).alias("m")).orderBy("part").collect()
    before = {r["part"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}
    lead = spark.createDataFrame([(r["part"], before[r["part"]], r["m"]["key"], r["m"]["hash"]) for r in firsts], "part int, sent_to int, key long, hash long")
    head = docs.join(F.broadcast(lead), ["part", "key", "hash"]).groupBy("sent_to").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    head = head.select("r.doc_id", "r.text", F.col("sent_to").alias("part"), F.lit(1).alias("guest"))
    both = docs.select("doc_id", "text", "part", F.lit(0).alias("guest")).unionByName(head)
    # One range to a task, so that none gets several of the long ones by chance of a hash.
    dealt = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", "doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                # Only the first guest of a range counts: it is what follows its last row.
                if held and held[-1][1] and held[-1][0] == row[0]:
                    continue
                held.append(row)
                size += len(row[3]) + 100
                if size > 2 << 20 and len(held) > 1:
                    yield _compared(held)
                    held, size = [row], len(row[3])
        if held:
            yield _compared(held)

    return dealt.mapInArrow(run, PAIRS)


def _compared(rows: list[tuple]) -> pa.RecordBatch:
    """Results for the rows that are followed by one of their range; the last row only follows."""
    own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
    texts = [r[3] for r in rows]
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    prints = list(_each(texts))
    sets = [np.unique(h) for h, _ in prints]
    others = [h for h, _ in _each(changed)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([encode(prints[i][0]) for i in own], pa.string()),
            pa.array([encode(h) for h in others], pa.string()),
            pa.array([likeness(sets[i], np.unique(h)) for i, h in zip(own, others)], pa.float64()),
            pa.array([likeness(sets[i], sets[i + 1]) for i in own], pa.float64()),
            pa.array([prints[i][1] for i in own], pa.list_(pa.int32())),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"],
    )
