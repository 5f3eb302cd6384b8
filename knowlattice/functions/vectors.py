"""Vector expressions over arrays of numbers: cosine, norms, validation, hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import spread
from .text import nfkc, terms

HASH_DIMENSIONS, HASH_ROWS = 32, 256


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null for missing, empty or differently long vectors or ones with values that aren't finite; 0 if one has no length."""
    finite = lambda v: F.forall(_doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & finite(a) & finite(b)
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(usable, F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length))


def compatible(rows: DataFrame, provider: str, model: str, dimensions: int, embedding: str = "embedding") -> DataFrame:
    """Stored vectors (provider, model, status, embedding) that a query's vector may be compared with: of its provider, model and size, and ready."""
    return rows.where((F.col("provider") == provider) & (F.col("model") == model) & (F.size(embedding) == dimensions) & (F.col("status") == "ready"))


def unit(v: Column) -> Column:
    """The vector at length 1; one without length stays zero."""
    n = norm(v)
    return F.transform(_doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def problem(v: Column, dimensions: int | None = None) -> Column:
    """Why a vector can't be stored, null if it can: its size, values that aren't finite, or no length."""
    size = F.size(v)
    values = _doubles(v)
    return (
        F.when(v.isNull(), "missing")
        .when((size < 4) | (size > 4096), "dimensions_out_of_range")
        .when(F.lit(dimensions is not None) & (size != (dimensions or 0)), "dimensions_differ")
        .when(F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.forall(values, lambda x: x == 0), "all_zero")
    )


def hash_embedding(docs: DataFrame, key: str, text: str | None, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """(key, embedding): each term adds 1 at one hashed place and half at another, with a hashed sign; length 1.

    One narrow pass: each batch hashes its distinct terms and adds them up where they are. ``text`` None reads a column
    ``terms`` that is there already. Every row has its own vector, whatever its key; a null text has a zero one.
    """
    made = spread(docs).select(F.col(key).alias(key), (F.col("terms") if text is None else terms(nfkc(text))).alias("terms"))
    schema = T.StructType([made.schema[0], T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some rows at a time: the distinct terms of a whole batch may be millions.
        for batch in (b.slice(i, HASH_ROWS) for b in batches for i in range(0, b.num_rows, HASH_ROWS)):
            lists = batch.column(1).fill_null([])
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            coded = lists.flatten().dictionary_encode()
            digest = [hashlib.sha256(t.encode()).hexdigest() for t in coded.dictionary.to_pylist()]
            first, second = (np.array([int(d[a : a + 8], 16) % dimensions for d in digest], np.int64) for a in (0, 10))
            sign = np.array([-1.0 if int(d[9], 16) % 2 else 1.0 for d in digest])
            term = coded.indices.to_numpy()
            sums = np.zeros((batch.num_rows, dimensions))
            if len(term):
                np.add.at(sums, (row, first[term]), sign[term])
                np.add.at(sums, (row, second[term]), 0.5 * sign[term])
            length = np.linalg.norm(sums, axis=1, keepdims=True)
            vectors = sums / np.where(length > 0, length, 1)
            at = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(vectors.ravel()))], names=[key, "embedding"])

    return made.mapInArrow(run, schema)
