"""Removal of repeated passages against every window of every document, in one slice and over many tasks."""

import hashlib
import random
import re

import pytest

from knowlattice.llm import queries, substrings

BLANK = re.compile("[^ \t-\r]+")


def plain(rows, window=50):
    """(key, words, removed, kept) of each row, from the smallest key of each window."""
    least, out, big = {}, [], float("inf")
    for key, text in rows:
        words = BLANK.findall(text or "")
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            least[w] = min(least.get(w, big), big if key is None else key)
    for key, text in rows:
        words = BLANK.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if least[tuple(words[i : i + window])] < (big if key is None else key):
                gone.update(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def some_rows(seed, n=150):
    draw = random.Random(seed)
    word = lambda k=400: f"w{draw.randrange(k)}"
    passages = [[word() for _ in range(draw.choice([49, 50, 51, 60, 80, 200]))] for _ in range(12)]
    rows = []
    for key in range(n):
        kind, words = draw.random(), [word() for _ in range(draw.choice([0, 3, 40, 90, 300]))]
        for _ in range(draw.choice([0, 1, 1, 2])):
            p, at = draw.choice(passages), draw.randint(0, len(words))
            words[at:at] = p if draw.random() < 0.7 else p[draw.randrange(10) :][: draw.choice([49, 50, 70])]
        text = draw.choice([" ", "\n", "  "]).join(words)
        if kind < 0.25 and rows:
            text = draw.choice(rows)[1]
            if text and kind < 0.15:  # a near copy
                words = BLANK.findall(text)
                if words:
                    words[draw.randrange(len(words))] = "edited"
                text = " ".join(words)
        rows.append((key, text))
    rows += [(3, rows[40][1]), rows[10], rows[10], (10, rows[11][1]), (None, rows[12][1]), (None, rows[12][1]), (None, " ".join(passages[0])), (7000, None), (7001, ""), (-5, " ".join(passages[1]))]
    rows += [(8000, "same " * 120), (8001, "same " * 51), (8002, "same " * 50), (8003, "same " * 49)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,slices", [(1, 1), (2, 7), (3, 40)])
def test_equals_all_windows(spark, seed, slices):
    rows = some_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(slices)
    got = substrings.remove_repeats(docs)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == plain(rows)
    assert sum(r[2] > 0 for r in plain(rows)) > 30


def test_small_batches(spark):
    """Groups that go over the ends of many batches."""
    rows = some_rows(8, 250)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=repr) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cover_has_all_differences():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


def test_query(spark, tmp_path):
    rows = some_rows(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_difference_cover_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    wanted = [(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in plain(rows)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)


def test_long_text_empty_table_and_clashing_columns(spark):
    long = " ".join(str(k % 70_001) for k in range(200_000))
    rows = [(2, long, 5), (1, " ".join(str(k) for k in range(30_000, 30_060)), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 180 and got[2].n_words == 200_000
    assert substrings.remove_repeats(docs).columns == ["doc_id", "text", "n_words", "n_removed", "kept"]
    assert substrings.remove_repeats(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs.withColumnRenamed("kept", "_copy"))
