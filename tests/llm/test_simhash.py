"""Fingerprints against a plain version, components against brute force, hot keys included."""

import random

import numpy as np
import xxhash

from knowlattice.llm import components as cm
from knowlattice.llm import simhash as sh
from knowlattice.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(root)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in items}


def test_fingerprint():
    for t in ["", "   ", "One", "one two", "A b\tc\nd", "é\x85x y\xa0z w", "the same " * 50, " ".join(str(i * i) for i in range(300))]:
        assert sh.simhash(t.encode()) == plain(t)


def _documents(rng):
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(120)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 5].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + i, " ".join(words)))
    return rows + [(300, None), (301, ""), (302, "\t"), (7, base[7]), (None, base[3]), (303, base[2]), (304, base[2])]


def test_components_match_brute_force(spark):
    rows = _documents(random.Random(3))
    docs = spark.createDataFrame([(i, t, "src", 9) for i, t in rows], "doc_id long, text string, source string, simhash int")
    got = sh.near_duplicates(docs).collect()
    prints = [plain(t) for _, t in rows]
    root = brute(prints)
    smallest = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            smallest[root[p]] = min(i, smallest.get(root[p], i))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.simhash % 2**64, r.component_id) for r in got) == sorted((i is None, i or 0, p, smallest[root[p]]) for (i, _), p in zip(rows, prints))


def test_empty(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hot_key_is_split_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    prints = {center}
    for _ in range(700):
        p = center
        for _ in range(rng.randrange(1, 6)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    monkeypatch.setattr(sh, "KEY_ROWS", 20)
    frame = spark.createDataFrame([(sh._signed(p),) for p in prints], "simhash long")
    got = {r.node % 2**64: r.root % 2**64 for r in components(sh.links(frame)).collect()}
    want = brute(prints)
    same = lambda d: {frozenset(x for x in prints if d.get(x, x) == r) for r in {d.get(x, x) for x in prints}}
    assert same(got) == same(want)


def test_table_finds_the_same_pairs():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 2**16, 300).astype(np.uint64))
    pairs = lambda found: {(min(x, y), max(x, y)) for a, b in found for x, y in zip(a.tolist(), b.tolist())}
    assert pairs(sh._near_by_table(prints, 2**16 - 1)) == pairs(sh._near_pairs(prints))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_components_in_one_task_and_by_steps(spark, monkeypatch):
    """Few edges take two writes, not some for each round, and both ways give the same; edges of other types go by steps."""
    rng, real, made = random.Random(2), cm.written, []
    monkeypatch.setattr(cm, "written", lambda df, what: made.append(what) or real(df, what))
    pairs = [(i, i + 1) for i in range(-30, 30)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(180)] + [(-(2**63), 2**63 - 1), (500, 500), (None, 1)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    found = lambda e: sorted((int(r.node), int(r.root)) for r in components(e).collect())
    few = found(edges)
    assert len(made) == 2
    monkeypatch.setattr(cm, "TASK_EDGES", 200)
    assert found(edges) == few and len(made) > 6
    assert len({r for _, r in few}) > 3 and all(b <= a for a, b in few)
    assert components(edges.limit(0)).collect() == []
    texts = [(r.node, r.root) for r in components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")).collect()]
    assert sorted(texts) == [("a", "a"), ("b", "a"), ("c", "a")]
