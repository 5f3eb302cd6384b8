"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected components.

Two fingerprints that differ in at most ``MAX_BITS`` = 3 bits agree on at least three of six blocks, so each of the
twenty choices of three blocks is a join key and close pairs meet under one of them. Only distinct fingerprints
are joined: copies are counted to their fingerprint before. Inside a key, a task keeps the links that hold its
fingerprints together (never all pairs); a key with more than ``KEY_ROWS`` fingerprints is split again by a
further pigeonhole over the bits that may still differ, until what is left has few enough free bits to enumerate.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, look_up, map_text, partitions, text_bytes, written
from .components import components, labels

MAX_BITS = 3
SHINGLE = 3
SEED = 42
KEY_ROWS = 1024
#: With so few free bits a key's fingerprints fit a table of all their values.
FREE_BITS = 16


def simhash(text: bytes) -> int:
    """The 64-bit fingerprint of one text: a bit is set where more than half of the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(length) - length
    end = start + length - 1
    width = min(SHINGLE, len(words))
    spans = zip(start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def add_simhash(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows of ``docs`` with ``simhash``, a signed 64-bit word; null and blank texts have 0."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        raw, at = text_bytes(column(batch, text))
        raw, at = raw.tobytes(), at.tolist()
        return [pa.array(np.array([simhash(raw[a:b]) for a, b in zip(at, at[1:])], np.uint64).view(np.int64))]

    return map_text(docs, compute, "simhash long", text, () if keep_text else (text,))


def _blocks(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` in ``parts`` masks of equal size (one bit more or less)."""
    bits = [b for b in range(64) if mask >> b & 1]
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[cut[i] : cut[i + 1]]) for i in range(parts)]


#: Masks of the bits that must be equal: three of six blocks.
FIRST_MASKS = [sum(c) for c in combinations(_blocks(2**64 - 1, 6), 3)]


def _further(mask: int) -> list[int]:
    """What ``mask`` grows to: close pairs that agree on it also agree on one of four blocks of the other bits."""
    return [mask | b for b in _blocks(2**64 - 1 ^ mask, MAX_BITS + 1)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _forest(prints: np.ndarray, near: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links between the smallest fingerprint of each connected group and the others of it."""
    label = labels(len(prints), near)
    other = np.flatnonzero(label != np.arange(len(prints)))
    return prints[other], prints[label[other]]


def _near_pairs(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(prints), 256):
        block = prints[i : i + 256]
        a, b = np.nonzero(np.bitwise_count(block[:, None] ^ prints[None, i:]) <= MAX_BITS)
        keep = b > a
        yield a[keep] + i, b[keep] + i


def _near_by_table(prints: np.ndarray, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs that differ in ``free`` bits only: every change of at most three of them is looked up."""
    bits = [b for b in range(64) if free >> b & 1]
    small = np.zeros(len(prints), np.int64)
    for i, b in enumerate(bits):
        small |= (prints >> np.uint64(b) & np.uint64(1)).astype(np.int64) << i
    where = np.full(1 << len(bits), -1, np.int64)
    where[small] = np.arange(len(prints))
    for n in range(1, MAX_BITS + 1):
        for change in combinations(range(len(bits)), n):
            other = where[small ^ sum(1 << c for c in change)]
            yield np.flatnonzero(other >= 0), other[other >= 0]


_LINKS = "a long, b long, mask long"


def _links_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads fingerprints sorted by (mask, key): links (a, b, null) of each key, or (a, null, mask) for each fingerprint of a key to be split."""
    held: list[np.ndarray] = []
    size, current, mask, table = 0, None, 0, False

    def batch(a, b, m) -> pa.RecordBatch:
        none = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), none(b if b is None else b.view(np.int64)), none(m)], names=["a", "b", "mask"])

    def close() -> Iterator[pa.RecordBatch]:
        if size < 2 or not held:
            return
        prints = np.unique(np.concatenate(held))
        near = _near_by_table(prints, 2**64 - 1 ^ mask) if table and size > KEY_ROWS else _near_pairs(prints)
        a, b = _forest(prints, near)
        if len(a):
            yield batch(a, b, None)

    for rows in batches:
        masks, keys, prints = (column(rows, c).to_numpy() for c in ("mask", "key", "simhash"))
        if not len(keys):
            continue
        prints = prints.view(np.uint64)
        cut = np.flatnonzero((np.diff(keys) != 0) | (np.diff(masks) != 0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
            group = (int(masks[i]), int(keys[i]))
            if group != current:
                yield from close()
                held, size, current = [], 0, group
                mask = group[0] % 2**64
                table = 64 - mask.bit_count() <= FREE_BITS
            held.append(prints[i:j])
            size += j - i
            if size > KEY_ROWS and not table:
                for part in held:
                    yield batch(part, None, np.full(len(part), _signed(mask)))
                held = []
    yield from close()


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that hold together all fingerprints (column ``simhash``, distinct) within ``MAX_BITS`` bits of another."""
    masks = F.array(*[F.lit(_signed(m)) for m in FIRST_MASKS])
    rows = prints.select("simhash", F.explode(masks).alias("mask"))
    found = []
    while True:
        keyed = rows.withColumn("key", F.col("simhash").bitwiseAND(F.col("mask")))
        dealt = keyed.repartition(partitions(prints.sparkSession), "mask", "key").sortWithinPartitions("mask", "key")
        made = written(dealt.mapInArrow(_links_of_keys, _LINKS), "links")
        found.append(made.where("b is not null").select("a", "b"))
        split = made.where("b is null").select(F.col("a").alias("simhash"), "mask")
        used = [r[0] for r in split.select("mask").distinct().collect()]  # some of a fixed set of masks
        if not used:
            break
        grown = F.create_map(*[x for m in used for x in (F.lit(m), F.array(*[F.lit(_signed(g)) for g in _further(m % 2**64)]))])
        rows = split.select("simhash", F.explode(grown[F.col("mask")]).alias("mask"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row (``key``, simhash, component_id) per row of ``docs``: the smallest key reachable over links of at most 3 bits.

    Null and blank texts have fingerprint 0 and link like any other. Repeated rows are kept and share a component.
    A null key is never a component's id unless all its keys are null. Only the key and the text are read. Copies share a
    fingerprint; one that many rows have is looked up in a broadcast table of bounded size, so no task gets all of them.
    """
    narrow = written(add_simhash(docs.select(F.col(key).alias(key), F.col(text).alias(text)), text, keep_text=False), "simhash")
    first = written(narrow.groupBy("simhash").agg(F.min(key).alias("_first"), F.count("*").alias("_n")), "prints")
    groups = components(links(first.select("simhash")))
    linked = first.join(groups, first["simhash"] == groups["node"]).select("simhash", "_first", "root")
    ids = linked.groupBy("root").agg(F.min("_first").alias("_id"))
    joined = linked.join(ids, "root").select("simhash", F.col("_id"))
    component = first.join(joined, "simhash", "left").select("simhash", F.coalesce("_id", "_first").alias("component_id"), "_n")
    return look_up(narrow, written(component, "named"), "simhash", "_n", narrow.count()).select(key, "simhash", "component_id")
