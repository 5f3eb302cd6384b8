"""Held-out behaviour on the labelled documents, graded severity, and edge cases."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from knowlattice.llm import toxicity

BAD = "disgusting trash loser worthless moron idiot pathetic stupid clown scum".split()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0")
    return toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))


def test_held_out(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 1")
    got = {r.doc_id: r.rejected for r in toxicity.score(docs, model, keep_text=False).select("doc_id", "rejected").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["doc_id"] in got}
    caught = sum(got[i] for i, t in labels.items() if t) / sum(labels.values())
    wrong = sum(got[i] for i, t in labels.items() if not t) / sum(not t for t in labels.values())
    assert caught > 0.9 and wrong < 0.005
    texts = {r["doc_id"]: r["text"].lower() for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist()}
    assert all(got[i] for i in got if sum(w in texts[i] for w in BAD) >= 3)


def test_severity_grows(spark, model):
    plain = "the and of that with for this was are is ".split()
    rows = [(k, " ".join(plain * 5 + BAD[:k])) for k in range(8)] + [(20, None), (21, "")]
    got = {r.doc_id: r.severity for r in toxicity.score(spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, severity double"), model).collect()}
    assert all(got[k] <= got[k + 1] for k in range(7)) and got[0] < 0.3 and got[7] > 1.5 and got[20] == got[21] == got[0]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (None, "x")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (None, 1), (2, None)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.rejected for r in toxicity.score(docs, m).collect()] == [False] * 3


def test_driver_gets_the_model_only(spark, model, monkeypatch):
    """The fit runs in a task: what is put in its place here, in the driver's Python, is never called."""
    monkeypatch.setattr(toxicity, "fit_rows", None)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 2 = 0").repartition(3)
    again = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    assert len(again.features) and (again.features == model.features).all()
    assert (again.weights == model.weights).all() and (again.thresholds == model.thresholds).all()


def test_gradient_reaches_the_odds():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 2))
    logit = x @ [3.0, -2.0]
    u = rng.random(4000)
    grade = sum((u < 1 / (1 + np.exp(t - logit))).astype(int) for t in (0.5, 1.5, 2.5))
    row, at = np.nonzero(x)
    sparse = toxicity.Sparse(x.shape, row, at, x[row, at])
    w, t = toxicity._proportional_odds(sparse, grade, ridge=0.0)
    assert np.abs(w - [3, -2]).max() < 0.5 and np.abs(t - [0.5, 1.5, 2.5]).max() < 0.4
