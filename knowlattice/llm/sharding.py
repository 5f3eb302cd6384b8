"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks (by a hash). How many rows each block gives each shard is drawn exactly, from the law that a
uniform permutation of all rows would follow. Each block is permuted and cut at those counts, the rows change hands,
and each shard is permuted again. Everything that touches rows is DataFrame expressions.
"""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, written

SHARDS = 16
SEED = 20_240_229
#: Rows of a block, and of a part of a shard that one task permutes, on average, until there are ``MOST_BLOCKS``.
BLOCK_ROWS = 500_000
#: So the matrix has at most ``MOST_BLOCKS`` x shards numbers; larger blocks are permuted by a sort that spills.
MOST_BLOCKS = 8_192


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among ``drawn`` of ``good + bad``: inversion outward from the mode, at any population size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)
    top = exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    while True:
        u, up, down, i, j = rng.random() - top, top, top, mode, mode
        if u <= 0:
            return mode
        while i < high or j > low:
            if i < high:
                up *= (good - i) * (drawn - i) / ((i + 1) * (bad - drawn + i + 1))
                i += 1
                u -= up
                if u <= 0:
                    return i
            if j > low:
                down *= j * (bad - drawn + j) / ((good - j + 1) * (drawn - j + 1))
                j -= 1
                u -= down
                if u <= 0:
                    return j
            if up + down < 1e-300:
                break


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows that each block gives each shard, given the blocks' counts; shards' sizes are at most one apart."""
    rng = random.Random(seed)
    total = sum(counts)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        rest, given = sum(left), []
        for s in range(shards):
            k = hypergeometric(rng, left[s], rest - left[s], n)
            rest -= left[s]
            left[s] -= k
            n -= k
            given.append(k)
        out.append(given)
    return out


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` with ``shard`` (0 to ``shards`` - 1, sizes at most one apart) and ``slot`` (gapless from 0 in it).

    The order is a uniform permutation. Rows are told apart by a number that is drawn once and written with them, so
    rows with equal or null ids, equal texts or nothing to tell them apart are spread and permuted like any others; the
    same seed gives the same order for the same scan. Columns of ``df`` are only carried: any may be null, texts
    may have any length; columns named shard or slot give way. An empty table stays empty. The driver sees one
    count per block (at most ``MOST_BLOCKS``) and draws the matrix; no shard is gathered in one task.
    """
    spark = df.sparkSession
    rows = written(df.drop("shard", "slot").withColumn("_row", F.monotonically_increasing_id()), "rows")
    drawn_by = lambda k: F.xxhash64(F.lit(seed + k), "_row")
    blocks = min(MOST_BLOCKS, max(partitions(spark), -(-rows.count() // BLOCK_ROWS)))
    parts = -(-blocks // shards)
    block = F.pmod(drawn_by(0), F.lit(blocks))
    counted = {r["_block"]: r["count"] for r in rows.select(block.alias("_block")).groupBy("_block").count().collect()}
    drawn = matrix([counted.get(b, 0) for b in range(blocks)], shards, seed)
    cuts = [{"_block": b, "upto": [sum(given[: s + 1]) for s in range(shards)]} for b, given in enumerate(drawn)]
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(cuts)), "array<struct<_block: bigint, upto: array<bigint>>>")))

    place = F.row_number().over(W.partitionBy("_block").orderBy(drawn_by(1), "_row")) - 1
    assigned = (
        rows.withColumn("_block", block)
        .withColumn("_place", place)
        .join(F.broadcast(table), "_block")
        .withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("_place"))))
        .withColumn("_part", F.pmod(drawn_by(2), F.lit(parts)))
        .drop("_block", "_place", "upto")
    )
    sizes = assigned.groupBy("shard", "_part").count()
    before = sizes.select("shard", "_part", (F.sum("count").over(W.partitionBy("shard").orderBy("_part")) - F.col("count")).alias("_before"))
    order = F.row_number().over(W.partitionBy("shard", "_part").orderBy(drawn_by(3), "_row")) - 1
    slots = assigned.withColumn("_order", order).join(F.broadcast(before), ["shard", "_part"])
    return slots.withColumn("slot", F.col("_before") + F.col("_order")).select(*[c for c in rows.columns if c != "_row"], "shard", "slot")
