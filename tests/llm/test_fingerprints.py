"""Winnowing against a plain per-text version, and the neighbour query against a plain loop."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from knowlattice.llm import fingerprints as fp
from knowlattice.llm.common import code_points, text_bytes


def plain(text):
    points = [ord(c) for c in text]
    if not points:
        return []
    if len(points) < fp.K:
        return None
    grams = fp.gram_hashes(np.array(points, np.uint32))
    kept = []
    for i in range(max(1, len(grams) - fp.W + 1)):
        window = list(grams[i : i + fp.W])
        low = min(window)
        j = i + max(k for k, h in enumerate(window) if h == low)
        if not kept or kept[-1][1] != j:
            kept.append((int(low), j))
    return kept


TEXTS = ["", "a", "short text", "x" * 200, "The same words again. " * 30, "Éa ñü " * 25, "0123456789abcdef", "".join(chr(97 + i * i % 23) for i in range(400))]


def test_matches_plain_version():
    hashes, positions, first = fp.winnow(*code_points(*text_bytes(pa.array(TEXTS))))
    for k, t in enumerate(TEXTS):
        got = [(int(h), int(p)) for h, p in zip(hashes[first[k] : first[k + 1]], positions[first[k] : first[k + 1]])]
        want = plain(t)
        if want is None:
            assert len(got) == 1 and got[0][1] == 0
        else:
            assert got == want


def test_shared_passage_is_found():
    passage = "".join(chr(97 + i * 7 % 26) for i in range(fp.GUARANTEE))
    sets = [{int(h) for h, _ in [(a, b) for a, b in zip(*found)]} for found in fp._each(["first words " + passage + " end", "quite other beginning: " + passage + "!"])]
    assert sets[0] & sets[1]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


@pytest.mark.parametrize("rows", [[], [(5, "only one", "x")], [(None, "n" * 90, "x"), (3, None, "x"), (1, "", "x"), (2, "Some words " * 40, "x"), (2, "Some words " * 40, "x"), (9, "é" * 75, "x")] + [(20 + i, f"text {i} " * (i % 9 + 1), "x") for i in range(60)]])
def test_neighbours(spark, rows):
    got = fp.compare_neighbours(_rows(spark, rows)).collect()
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (k, t) in enumerate(ordered):
        nxt = ordered[(i + 1) % len(ordered)][1]
        e = fp.edited(t, nxt)
        f, g, h = (np.unique(x) for x, _ in fp._each([t, e, nxt]))
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), round(fp.likeness(f, g), 9), round(fp.likeness(f, h), 9)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got], key=key) == sorted(want, key=key)


def test_equal_texts_and_clashing_column(spark):
    rows = fp.fingerprint(_rows(spark, [(1, "the very same text", "old"), (2, "the very same text", "old"), (3, None, "old")])).collect()
    assert rows[0].fingerprint == rows[1].fingerprint != "" and rows[2].fingerprint == "" and rows[0].fingerprint != "old"


def test_hot_id_is_split(spark):
    """Most rows share one id: their ranges follow the hash of the text, and each row still meets the next in that order."""
    rows = [(1 if i % 5 else i, f"text number {i} " * 6) for i in range(600)] + [(None, f"no id {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = docs.selectExpr("doc_id", "text", "xxhash64(text) h").orderBy("doc_id", "h", "text").collect()
    want = sorted(hashlib.sha256(fp.edited(a.text, b.text).encode()).hexdigest() for a, b in zip(ordered, ordered[1:] + ordered[:1]))
    assert sorted(r.edited_sha256 for r in fp.compare_neighbours(docs).collect()) == want
