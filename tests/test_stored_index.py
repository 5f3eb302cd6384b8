"""A stored index: built, brought up to date part by part, and searched; each state equals a rebuild."""

import os

from pyspark.sql import functions as F

from knowlattice.functions import text as X
from knowlattice.operators import keyword
from knowlattice.sources import tables


def rows(spark, path):
    return sorted((str(r.key), r.len, tuple(r.terms), r.mark) for r in keyword.read_index(spark, path).collect())


def names(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_projection_equals_a_rebuild(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"words of document {k}") for k in range(60)] + [(7, "again"), (None, "no key"), (70, None)], "doc_id long, text string")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    assert keyword.build_index(docs, one) == {"rows": 63, "terms": 4 * 60 + 1 + 2}
    before = names(one)
    changed = spark.createDataFrame([(7, "only one row now"), (None, "still no key"), (99, "new")], "doc_id long, text string")
    gone = spark.createDataFrame([(8,), (12345,)], "doc_id long")
    touched = keyword.project(one, changed, gone)
    after = docs.where("doc_id not in (7, 8)").unionByName(changed)
    keyword.build_index(after, two)
    assert rows(spark, one) == rows(spark, two)
    kept = set(before) & set(names(one))
    parts = {p for (p,) in docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(keyword.PARTS))).distinct().collect()}
    assert 0 < len(touched) <= 5 and len(kept) >= len(parts - set(touched)) and all(before[f] == names(one)[f] for f in kept)
    assert keyword.project(one, changed.limit(0)) == [] and rows(spark, one) == rows(spark, two)


def test_emptied_part_and_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "gamma")], "doc_id long, text string")
    path = str(tmp_path / "index")
    keyword.build_index(docs, path, parts=64)
    keyword.project(path, docs.limit(0), docs.where("doc_id = 3"))
    assert sorted(r.key for r in keyword.read_index(spark, path).collect()) == [1, 2]
    queries = spark.createDataFrame([(0, "alpha gamma")], "item_id long, text string").withColumn("terms", X.query_terms(F.col("text")))
    stored = keyword.bm25(keyword.read_index(spark, path), queries).collect()
    fresh = keyword.bm25(keyword.index(docs.where("doc_id != 3")), queries).collect()
    assert sorted((r.key, round(r.score, 9), r.matched) for r in stored) == sorted((r.key, round(r.score, 9), r.matched) for r in fresh)


def test_stored_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    first = tables.version(spark, str(tmp_path), "t")
    done = []
    write = lambda p: (done.append(p), spark.range(1).write.parquet(p))
    assert tables.stored_once(spark, f"once-{first}", write) == tables.stored_once(spark, f"once-{first}", write) and len(done) == 1
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert tables.version(spark, str(tmp_path), "t") != first
