"""Near words against all pairs, and the query against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from knowlattice.llm import queries, spelling


def near(u, v):
    """Exactly one inserted, deleted or replaced letter apart."""
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    k = 0
    while k < min(len(u), len(v)) and u[k] == v[k]:
        k += 1
    return u[k + (len(u) >= len(v)) :] == v[k + (len(v) >= len(u)) :]


def plain_variants(counts, times=2):
    out = []
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        form = min(others, key=lambda v: (-counts[v], v), default=None)
        out.append([w, form if form and counts[form] >= times * n else None, n, len(others)])
    forms = {w: f for w, f, *_ in out}
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted((w, f, root, n, k, counts[f] if f else None) for w, f, n, k, root in out)


def some_words(seed, n, letters="abé", least=5, most=9):
    draw = random.Random(seed)
    made = {"".join(draw.choice(letters) for _ in range(draw.randint(least, most))): draw.choice([3, 3, 4, 6, 7, 12, 30, 100]) for _ in range(n)}
    return made | {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "ÿaaaa": 3}


@pytest.mark.parametrize("group_words", [20_000, 40, 3])
def test_equals_all_pairs(spark, monkeypatch, group_words):
    monkeypatch.setattr(spelling, "MOST_SENT", 2 if group_words == 3 else 10_000)
    counts = some_words(group_words, 700)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(words, group_words=group_words).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) > 500
    assert {frozenset(p) for p in pairs} == {frozenset((u, v)) for u in counts for v in counts if u < v and near(u, v)}
    got = sorted(map(tuple, spelling.variants(words, group_words=group_words).collect()))
    assert got == plain_variants(counts)


def test_automaton_numbers_words_and_shares_states():
    words = sorted({"".join(random.Random(k).choices("abc", k=5)) for k in range(300)})
    automaton = spelling.Automaton(words)
    for k, word in enumerate(words):
        state = number = 0
        for letter in word:
            state, before = automaton.go[state][letter]
            number += before
        assert number == k and automaton.final[state]
        assert sorted(automaton.one_error(word, 2)) == [i for i, v in enumerate(words) if near(word, v) and v[:2] == word[:2]]
    assert len(automaton.go) < sum(map(len, words)) / 4
    assert len(spelling.Automaton([]).go) == 1


def test_query_equals_plain_python(spark, tmp_path):
    draw = random.Random(4)
    base = ["Garten", "Gärten", "straße", "Straßen", "niño", "ocean", "Oceans", "ÉCLAIR", "éclair", "don't", "x1yabcde", "over-lapping"]
    rows = [(k, " ".join(draw.choices(base, k=60)) if k % 17 else None) for k in range(300)] + [(7, "garten garten"), (7, "garten garten"), (None, "Garten ocean"), (900, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if key is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    wanted = plain_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == wanted and sum(r[1] is not None for r in wanted) > 5


def test_empty_null_and_long(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).collect() == []
    docs = spark.createDataFrame([(1, None, "w"), (2, "", "w"), (3, "lettre " * 50_000, "w"), (4, "lettres " * 3, None)], "doc_id long, text string, word string")
    got = spelling.variants(spelling.vocabulary(spelling.occurrences(docs)))
    assert sorted(map(tuple, got.collect())) == [("lettre", None, "lettre", 50_000, 1, None), ("lettres", "lettre", "lettre", 3, 1, 50_000)]
    nulls = spark.createDataFrame([(None, 5), ("fünfe", None)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(nulls).collect()] == [("fünfe", None, "fünfe", None, 0, None)]
