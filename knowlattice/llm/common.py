"""Helpers shared by the operators of this package: shared folder, tables, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset on a single machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: on a cluster it must be one that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="knowlattice-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys of more rows than this, and than one in ``MOST_HOT`` of all rows, are hot; so there are at most ``MOST_HOT`` of them.
HOT_ROWS, MOST_HOT = 256, 10_000


def look_up(rows: DataFrame, values: DataFrame, key: str, n_rows: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row for each ``key`` of ``rows`` and counts them in ``n_rows``.

    A hot key is looked up in a broadcast table of at most ``MOST_HOT`` keys (or total / ``HOT_ROWS``, if that is less),
    so its rows stay where they are; the others are joined by a shuffle. ``rows`` is read twice: it must be repeatable.
    Rows of a null key are left out.
    """
    is_hot = F.col(n_rows) > max(HOT_ROWS, total // MOST_HOT)
    hot = F.broadcast(values.where(is_hot).drop(n_rows))
    cold = rows.join(hot.select(key), key, "left_anti").join(values.where(~is_hot).drop(n_rows), key)
    return rows.join(hot, key).unionByName(cold)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, all else untouched (``lower`` would change other alphabets too)."""
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_chunks(batches: Iterable[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``max_bytes`` of text each; a longer row comes alone and whole."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + max_bytes, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes end to end, and where each row starts in them."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    return cps, first[at]


_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\n\x0b\x0c\r"]] = True


@dataclass
class Words:
    """Where the words of texts end to end start and end (bytes), how many each row has, and which is its first."""

    start: np.ndarray
    end: np.ndarray
    size: np.ndarray
    first: np.ndarray

    def ids(self, raw: np.ndarray) -> np.ndarray:
        """A number for each word; equal numbers for equal words only."""
        length = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(length)])
        letters = pa.py_buffer(raw[~_BLANK[raw]])
        array = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets), letters])
        return array.dictionary_encode().indices.to_numpy()

    def joined(self, raw: np.ndarray, kept: np.ndarray) -> pa.Array:
        """The kept words of each row, joined by one space."""
        row = np.repeat(np.arange(len(self.size)), self.size)[kept]
        length = (self.end - self.start)[kept]
        last = np.append(row[1:] != row[:-1], True)[: len(row)]
        wide = length + ~last
        at = ranges(self.start[kept], wide)
        out = raw[np.minimum(at, len(raw) - 1)] if len(at) else np.zeros(0, np.uint8)
        out[(np.cumsum(wide) - 1)[~last]] = 32
        rows = np.concatenate([[0], np.cumsum(np.bincount(row, wide, len(self.size)).astype(np.int64))])
        return pa.Array.from_buffers(pa.large_string(), len(self.size), [None, pa.py_buffer(rows), pa.py_buffer(out)]).cast(pa.string())


def blank_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """The words, parted by space and tab to carriage return, of texts end to end."""
    solid, edge = ~_BLANK[raw], np.zeros(len(raw) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(solid & (edge[:-1] | ~np.append(False, solid[:-1])[: len(solid)]))
    end = np.flatnonzero(solid & (edge[1:] | ~np.append(solid[1:], False)[: len(solid)])) + 1
    size = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=len(at) - 1)
    return Words(start, end, size, np.cumsum(size) - size)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on the input (splitmix finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE_INVERSE = pow(0xD6E8FEB86659FD93, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each span: one prefix sum of a polynomial, whatever the spans' lengths."""
    n = len(values)
    table = mix64((np.arange(int(values.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(1)) * _MUL) if n else np.zeros(1, np.uint64)
    down = _power_table("down", _BASE_INVERSE, n + 1)
    up = _power_table("up", 0xD6E8FEB86659FD93, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(table[values] * down[:n], out=prefix[1:])
    return mix64((prefix[end] - prefix[start]) * up[start] + (end - start).astype(np.uint64) * _MUL)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), then the same for the next."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, length)


def map_text(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    fields: str,
    text: str = "text",
    drop: tuple[str, ...] = (),
    chunk_bytes: int = 4 << 20,
) -> DataFrame:
    """The rows of ``df`` without ``drop``, and the columns ``fields`` (DDL) that ``compute`` makes of each slice.

    Runs in one narrow pass. A slice holds about ``chunk_bytes`` of text, or one longer row. A column of
    ``df`` with the name of a new one gives way to it.
    """
    new = T.StructType.fromDDL(fields)
    kept = [i for i, f in enumerate(df.schema) if f.name not in new.names and f.name not in drop]
    schema = T.StructType([df.schema[i] for i in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, chunk_bytes, text):
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + made, names=schema.names)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
