"""Recall by language where labels are few, on the rows the model is fitted on."""

from collections import Counter

import pytest

from knowlattice.llm import toxicity


@pytest.mark.parametrize("sf, least", [("sf0.001", {"en": 7}), ("sf0.01", {"en": 33, "de": 6})])
def test_few_labels(spark, sf, least):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, labels), keep_text=False).join(labels, "doc_id").select("lang", "toxic", "rejected").collect()
    caught = Counter(r.lang for r in rows if r.toxic and r.rejected)
    assert all(caught[lang] >= n for lang, n in least.items())
    assert sum(r.rejected for r in rows if not r.toxic) == 0
