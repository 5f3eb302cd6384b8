"""Scores against a plain dictionary version over the same corpus."""

import math
import re
from collections import Counter

import pytest

from knowlattice.llm import lm


def plain(texts, order=3):
    counts = Counter()
    split = [re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    for w in split:
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, split))
    out = []
    for w in split:
        score, backs = 0.0, 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log(counts[g] / total)
                elif counts[g] >= lm.LEAST_COUNT:
                    score += math.log(counts[g] / counts[g[:-1]])
                    break
                else:
                    score += math.log(lm.BACKOFF)
                    backs += 1
        out.append((len(w), score, backs))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_documents(spark, order, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 250").select("doc_id", "text").collect()]
    rows += [(1001, None), (1002, ""), (1003, " \t"), (None, "Some words some words"), (1004, "é ü É"), rows[3]]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int")
    got = sorted((str(r.doc_id), r.n_tokens, r.backed_off, r.log_score) for r in lm.score(docs, order=order).collect())
    want = sorted((str(i), n, b, s) for (i, _), (n, s, b) in zip(rows, plain([t for _, t in rows], order)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
