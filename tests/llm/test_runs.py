"""Runs against every period tried at every place, and the digests of the query against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from knowlattice.llm import queries, runs

BLANK = re.compile("[^ \t-\r]+")


def plain_runs(s, least_words=24, least_periods=3):
    found = set()
    for p in range(1, len(s) // 2 + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            start, length = i, j - i + p
            if j > i and length >= max(least_words, least_periods * p):
                part = s[start : start + length]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    found.add((start, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    inside = {i for start, length, p in found for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in inside)


def texts(seed=3, n=120):
    draw = random.Random(seed)
    made = [None, "", " \t\n ", "a", "a " * 24, "a " * 23, ("x y " * 20 + "z ") * 4, "é  ñ " * 12, "a b " * 20 + "c " + "b a " * 20]
    for _ in range(n):
        words = [draw.choice("abcd") for _ in range(draw.randint(1, 90))]
        if draw.random() < 0.6:
            a, p = draw.randrange(len(words)), draw.randint(1, 12)
            words = [words[i] if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else "a" for i in range(len(words))]
        made.append(draw.choice([" ", "\n", "  ", "\x0b"]).join(words))
    return made


@pytest.mark.parametrize("least", [(24, 3), (1, 2), (6, 2), (5, 4)])
def test_equals_all_periods_tried(spark, least):
    made = texts()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r for r in runs.find_runs(docs, least_words=least[0], least_periods=least[1]).collect()}
    for k, text in enumerate(made):
        words = BLANK.findall(text or "")
        wanted = plain_runs(words, *least)
        assert [(r.start, r.length, r.period) for r in got[k].runs] == wanted, text
        assert got[k].n_words == len(words) and got[k].collapsed == collapsed(words, wanted) and got[k].text == text


def test_query_equals_plain_python(spark, tmp_path):
    draw = random.Random(9)
    rows = [(k, None if k % 41 == 0 else " ".join(draw.choice(["uno", "dos", "tres", "más"]) for _ in range(draw.choice([0, 1, 5, 40, 200, 400])))) for k in range(400)] + [(5, "again"), (5, "again"), (None, "b " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = []
    for key, text in rows:
        words = BLANK.findall(text or "")
        h, n = zlib.crc32(str(key).encode()) if key is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        wanted.append((key, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(collapsed(words, found))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert sum(w[1] > 0 for w in wanted) >= 8


def test_long_text_empty_table_and_clashing_columns(spark):
    long = "p q r " * 40_000 + "end"
    docs = spark.createDataFrame([(1, long, "mine", "runs too")], "doc_id long, text string, n_words string, runs string")
    row = runs.find_runs(docs).first()
    assert [tuple(x) for x in row.runs] == [(0, 120_000, 3)] and row.collapsed == "p q r end" and row.n_words == 120_001
    assert runs.find_runs(docs.limit(0)).collect() == []
    assert runs.find_runs(docs, keep_text=False).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_pointers_that_move_one_place_at_a_time():
    import numpy as np

    values = np.concatenate([[0], np.arange(5000, 0, -1), [-1]]).astype(np.int32)
    to = runs.next_smaller(values)
    assert to[0] == 5001 and to[-1] == 5002 and (to[1:5001] == np.arange(2, 5002)).all()
