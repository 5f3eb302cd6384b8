"""Judgments on small tables: whole, and counted whole."""

from knowlattice.plans import catalog


def tables(spark, folder):
    spark.createDataFrame([(97, "nil"), (5, "x one two three y"), (199, "x")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, "no such words here"), (97, "one two three"), (194, "some other words"), (5, "one")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stated_negatives_are_all_pairs_of_equal_ids_modulo_97(spark, tmp_path):
    got = sorted(tuple(r) for r in catalog.QUERIES["qrels_build"](spark, tables(spark, tmp_path)).select("item_id", "doc_id", "grade").collect())
    assert got == [(0, 97, 0), (5, 5, 2), (5, 199, 0), (97, 5, 2), (97, 97, 0), (194, 97, 0)]


def test_all_of_them_are_counted(spark, tmp_path):
    assert [tuple(r) for r in catalog.QUERIES["qrel_counts"](spark, tables(spark, tmp_path)).select("queries", "judgments", "relevant").collect()] == [(4, 6, 2)]
