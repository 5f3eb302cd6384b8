"""Exact nearest vectors: a stated set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import kept
from .keyword import top

BLOCK = 1024


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, key: str, query: str, embedding: str = "embedding") -> DataFrame:
    """(query, key, cosine, rank): the k rows of ``vectors`` with the largest cosine for each row of ``queries``.

    Blocks of at most ``BLOCK`` query vectors go to the executors; each task keeps its k best per query, so what is
    shuffled is k rows a task and query, whatever the number of vectors. Ties go by key. Rows without a vector, with
    another length or values that aren't finite are not compared; keys may be null or repeat; a query without length is dropped, a row without has cosine 0.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(embedding).isNotNull()).select(query, F.col(embedding).cast("array<double>").alias("v"))
    asked = asked.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    kinds = dict(vectors.dtypes)
    schema = f"{query} {dict(queries.dtypes)[query]}, {key} {kinds[key]}, cosine double"
    # A block at a time comes to the driver; with more than one, each block's best rows are written before the next.
    blocks = _blocks(asked.sortWithinPartitions(F.size("v")).toLocalIterator(prefetchPartitions=False), query)
    parts: list[DataFrame] = []
    source, block = vectors.select(key, embedding), next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        if following is not None and not parts:
            source = kept(source, "vectors")
        found = _block_best(source, block, k, key, query, schema)
        parts.append(kept(found, "nearest") if following is not None or parts else found)
        block = following
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, k, query, key, "cosine")


def _blocks(rows: Iterator, query: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of up to ``BLOCK`` queries of one length at a time."""
    ids, held = [], []
    for r in rows:
        if held and (len(held) >= BLOCK or len(r["v"]) != len(held[0])):
            yield ids, np.array(held)
            ids, held = [], []
        ids.append(r[query])
        held.append(r["v"])
    if held:
        yield ids, np.array(held)


def _block_best(vectors: DataFrame, block: tuple[list, np.ndarray], k: int, key: str, query: str, schema: str) -> DataFrame:
    """(query, key, cosine): of each task's vectors the k best for each query of the block."""
    ids, matrix = block
    size = matrix.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        kept, batch_key = [(np.zeros(0), [])] * len(ids), None
        for batch in batches:
            batch_key = batch.schema.field(0).type
            lists = batch.column(1)
            usable = np.flatnonzero(lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == size)
            if not len(usable):
                continue
            m = lists.take(pa.array(usable)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            finite = np.isfinite(m).all(1)
            usable, m = usable[finite], m[finite]
            length = np.linalg.norm(m, axis=1)
            cosines = units @ (m / np.where(length > 0, length, 1)[:, None]).T
            keys = batch.column(0).take(pa.array(usable)).to_pylist()
            for q in range(len(ids)):
                old, names = kept[q]
                values, names = np.concatenate([old, cosines[q]]), names + keys
                if len(values) > k:
                    order = sorted(range(len(values)), key=lambda j: (-round(values[j], 9), _order(names[j]))) if len(values) < 4 * k else _first(values, names, k)
                    values, names = values[order[:k]], [names[j] for j in order[:k]]
                kept[q] = (values, names)
        for q, (values, names) in enumerate(kept):
            if names:
                yield pa.RecordBatch.from_arrays([pa.array([ids[q]] * len(names)), pa.array(names, batch_key), pa.array(values, pa.float64())], names=[query, key, "cosine"])

    return vectors.mapInArrow(best, schema)


def _order(key) -> tuple:
    """Null keys go first among ties."""
    return (key is not None, key)


def _first(values: np.ndarray, names: list, k: int) -> list[int]:
    """Places of the k best, ties by name: those at least as good as the k-th are sorted."""
    rounded = np.round(values, 9)
    limit = np.partition(rounded, len(rounded) - k)[len(rounded) - k]
    near = np.flatnonzero(rounded >= limit)
    return sorted(near.tolist(), key=lambda j: (-rounded[j], _order(names[j])))
