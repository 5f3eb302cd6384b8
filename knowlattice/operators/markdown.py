"""Markdown pages: blocks by headings with their paths, and line differences of two versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .segments import lines

HEADING = r"^(#{1,6})\s+(\S.*?)\s*$"
#: Fixed value: beyond so many pairs of lines a difference is all lines out, then all lines in.
MOST_CELLS = 4_000_000


def blocks(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, ordinal, type, path, start, end, block_key): a block from each heading to the next, and one before the first.

    ``path`` holds the titles above and at the heading, null where a level is skipped. What stands before the first
    heading begins at its first line that is not blank; a text without any such line is one block. Null texts have none.
    """
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    found = lines(pages, key, text).withColumn("_depth", F.length(F.regexp_extract("line_text", HEADING, 1))).withColumn("_title", F.regexp_extract("line_text", HEADING, 2))
    found = found.withColumn("_of", F.sum((F.col("_depth") > 0).cast("int")).over(w))
    for d in range(1, 7):
        found = found.withColumns({f"_at{d}": F.max(F.when(F.col("_depth") == d, F.struct("line", "_title"))).over(w), f"_above{d}": F.max(F.when(F.col("_depth").between(1, d - 1), F.col("line"))).over(w)})
    level = lambda d: F.when(F.col(f"_at{d}.line") > F.coalesce(F.col(f"_above{d}"), F.lit(-1)), F.col(f"_at{d}._title"))
    path = F.slice(F.array(*[level(d) for d in range(1, 7)]), 1, F.greatest(F.col("_depth"), F.lit(0)))
    begins = (F.col("_depth") > 0) | ((F.col("_of") == 0) & (F.trim("line_text") != ""))
    rows = found.withColumn("_path", path).where((F.col("_of") > 0) | begins)
    n = pages.select(key, F.length(text).cast("long").alias("_n")).where("_n is not null")
    made = rows.groupBy(key, "_of").agg(F.min("start").alias("start"), F.min_by("_path", "line").alias("path"))
    made = n.join(made, key, "left").withColumns({"start": F.coalesce("start", F.lit(0).cast("long")), "path": F.coalesce("path", F.array().cast("array<string>")), "_of": F.coalesce("_of", F.lit(0))})
    order = W.partitionBy(key).orderBy("start")
    made = made.withColumns({"ordinal": F.row_number().over(order) - 1, "end": F.coalesce(F.lead("start").over(order), F.col("_n")), "type": F.when(F.col("_of") > 0, "heading").otherwise("markdown")})
    named = F.to_json(F.struct(F.col("type").alias("blockType"), F.col("path").alias("headingPath"), "ordinal"), {"ignoreNullFields": "false"})
    return made.select(key, "ordinal", "type", "path", "start", "end", F.substring(F.sha2(named, 256), 1, 32).alias("block_key"))


def _suffix_row(line: int, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the left lines from ``line`` on and each rest of the right lines."""
    reach = np.maximum(below[:-1], np.where(right == line, below[1:] + 1, 0))
    return np.append(np.maximum.accumulate(reach[::-1])[::-1], 0).astype(np.int32)


def _difference(before: str, after: str, most_cells: int | None = None) -> list[tuple[str, str]]:
    """Lines as (context, added or removed; the line): a longest common subsequence, added before removed where either may come.

    Each left line ends a run of added lines: at its match, or where going on would lose one. Every so many rows of lengths
    are kept, and those between are made again when they are needed, so memory grows with the longer version times the root of the
    shorter's lines.
    """
    a, b = before.split("\n"), after.split("\n")
    if most_cells is not None and len(a) * len(b) > most_cells:
        return [("removed", x) for x in a] + [("added", x) for x in b]
    code: dict[str, int] = {}
    left, right = (np.array([code.setdefault(x, len(code)) for x in lines_]) for lines_ in (a, b))
    step = max(1, int(len(a) ** 0.5))
    row = np.zeros(len(b) + 1, np.int32)
    kept = {len(a): row}
    for i in range(len(a) - 1, 0, -1):
        row = _suffix_row(left[i], right, row)
        if i % step == 0:
            kept[i] = row
    out: list[tuple[str, str]] = []
    j = 0
    for first in range(0, len(a), step):
        last = min(first + step, len(a))
        rows = [kept.pop(last)]
        for i in range(last - 1, first - 1, -1):
            rows.append(_suffix_row(left[i], right, rows[-1]))
        for i in range(first, last):
            here, below = rows[last - i][j:], rows[last - i - 1][j:]
            stops = np.flatnonzero((right[j:] == left[i]) | (here[1:] < below[:-1]))
            stop = j + int(stops[0]) if len(stops) else len(b)
            out += [("added", x) for x in b[j:stop]]
            same = stop < len(b) and right[stop] == left[i]
            out.append(("context" if same else "removed", a[i]))
            j = stop + same
    return out + [("added", x) for x in b[j:]]


def line_diff(before: Column | str, after: Column | str, most_cells: int | None = MOST_CELLS) -> Column:
    """The lines of two versions as context, added or removed; a null version is empty.

    Versions of more than ``most_cells`` pairs of lines are all lines out and all in; without that bound each difference is exact.
    """

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])))
    def found(one: pa.Array, other: pa.Array) -> pa.Array:
        rows = [[{"type": k, "value": v} for k, v in _difference(x or "", y or "", most_cells)] for x, y in zip(one.to_pylist(), other.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())])))

    return found(before, after)
