"""Contaminated words and items against a plain search, in one pass over the benchmark and in several."""

import re

import pytest

from knowlattice.llm import decontamination as D

WORDS = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven other foxes sleep near the old mill"
ITEMS = [(0, PASSAGE), (1, "only three words"), (2, None), (3, "..."), (4, PASSAGE), (5, "alpha beta " * 12)]
DOCS = [(1, f"Before. {PASSAGE.upper()}! After"), (2, "Only, three -- WORDS, only three words"), (3, None), (4, ""), (5, "nothing to see here"), (6, "alpha beta " * 40), (6, "alpha beta " * 40), (None, PASSAGE[:60]), (7, "x " * 30_000 + PASSAGE)]


@pytest.mark.parametrize("phrase_bytes", [None, 60])
def test_against_plain_search(spark, monkeypatch, phrase_bytes):
    if phrase_bytes:
        monkeypatch.setattr(D, "PHRASE_BYTES", phrase_bytes)
    docs = spark.createDataFrame([(*r, "old") for r in DOCS], "doc_id long, text string, spans string")
    got = D.find_contamination(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    windows = {}
    for i, t in ITEMS:
        w = WORDS(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in DOCS:
        w, hit, items = WORDS(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        want.append((str(i), len(w), len(hit), sorted(items)))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in got) == sorted(want)
