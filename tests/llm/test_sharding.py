"""Exact shard sizes, gapless slots, and the law of the matrix."""

import random
from collections import Counter

import pytest

from knowlattice.llm import sharding


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1003])
def test_shards(spark, n):
    rows = [(i if i % 7 else None, f"t{i % 3}", "old") for i in range(n)]
    got = sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string, shard string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((a, b) for a, b, _ in rows), key=str)
    sizes = Counter(r.shard for r in got)
    assert not n or max(sizes.values()) - min(sizes.get(s, 0) for s in range(16)) <= 1
    for s, size in sizes.items():
        assert 0 <= s < 16 and sorted(r.slot for r in got if r.shard == s) == list(range(size))


def test_same_seed_same_order_and_other_seed_other(spark):
    docs = spark.range(500).withColumnRenamed("id", "doc_id")
    order = lambda **k: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, **k).collect()}
    assert order() == order() != order(seed=7)


def test_hypergeometric_law():
    rng = random.Random(1)
    draws = [sharding.hypergeometric(rng, 30, 70, 40) for _ in range(20_000)]
    mean, var = sum(draws) / 20_000, 40 * 0.3 * 0.7 * 60 / 99
    assert abs(mean - 12) < 0.06 and abs(sum((d - mean) ** 2 for d in draws) / 20_000 - var) < 0.2
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    assert abs(sharding.hypergeometric(rng, 10**11, 10**12, 10**6) - 90_909) < 3_000


def test_matrix_sums():
    counts = [17, 0, 250, 3]
    drawn = sharding.matrix(counts, 16, 5)
    assert [sum(r) for r in drawn] == counts
    assert {sum(r[s] for r in drawn) for s in range(16)} <= {270 // 16, 270 // 16 + 1}


def test_equal_rows_are_spread(spark):
    """A table of one repeated row: each block and shard still gets its share."""
    same = spark.createDataFrame([(7, "t")] * 4000, "doc_id long, text string").repartition(8)
    sizes = Counter(r.shard for r in sharding.shuffle_into_shards(same).collect())
    assert set(sizes.values()) == {250}


def test_every_place_is_equally_likely(spark):
    """Over many seeds each of six rows stands at each of six places (two shards of three) about equally often."""
    docs = spark.range(6, numPartitions=2).withColumnRenamed("id", "doc_id").cache()
    seen = Counter()
    for seed in range(24):
        for r in sharding.shuffle_into_shards(docs, shards=2, seed=seed * 1000).collect():
            seen[r.doc_id, r.shard * 3 + r.slot] += 1
    chi = sum((seen[a, b] - 4) ** 2 / 4 for a in range(6) for b in range(6))
    assert chi < 52  # 25 degrees of freedom, one in a thousand
