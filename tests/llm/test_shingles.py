"""Near duplicates by shingles against the Jaccard likeness of all pairs."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from knowlattice.llm import shingles as sh

D = "/root/testdata/sf0.01"


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    """Smallest place of each component; pairs that share no shingle are not alike."""
    sets, root, by = [grams(t) for t in texts], list(range(len(texts))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [i for i, s in enumerate(sets) if not s]
    for i in empty:
        root[i] = empty[0]
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in by[g]:
                shared[j] += 1
            by[g].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_edited_copies_and_chains(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 150))) for _ in range(40)]
    for i in range(12):
        words = texts[i].split()
        for _ in range(25):  # each an edit of the last or of the first
            words = words[:] if rng.random() < 0.5 else texts[i].split()
            for _ in range(1 + len(words) // 40):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
    texts += ["", None, " \t", "One two", "one  TWO\n", "one two three", texts[3], texts[3].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute(texts)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_keeps_one_of_each_component(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = sorted(pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    want = [rows[i]["doc_id"] for i in sorted(set(brute([r["text"] for r in rows])))]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, f"/root/testdata/{sf}")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want


def test_empty(spark):
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
