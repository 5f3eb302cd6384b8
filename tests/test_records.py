"""Readers, snapshots, redaction, plan trees and layout pages by hand."""

import json

from pyspark.sql import functions as F

from knowlattice.functions import text as X
from knowlattice.operators import graph
from knowlattice.operators import lifecycle as L
from knowlattice.sources import records


def test_first_success(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, None, "E1", "b"), (3, "", "E1", None), (4, "x", "E2", "")], "id int, a string, ea string, b string")
    got = {r.id: r for r in L.first_success(rows, [("one", F.col("a"), F.col("ea")), ("two", F.col("b"), F.lit(None).cast("string"))]).collect()}
    assert [(got[i].reader, got[i].text) for i in (1, 2, 3, 4)] == [("one", "a"), ("two", "b"), (None, None), (None, None)]
    assert [[(a.reader, a.succeeded, a.error) for a in got[i].attempts] for i in (1, 2, 4)] == [[("one", True, None)], [("one", False, "E1"), ("two", True, None)], [("one", False, "E2"), ("two", False, "EMPTY_RESULT")]]


def test_written_once_and_public(spark):
    rows = spark.createDataFrame([("k", 2, "t2", 1, None), ("k", 1, "t1", 1, None), ("k", 3, "t3", 2, None), ("n", 1, "t", None, "x")], "key string, at int, time string, a int, b string")
    assert sorted(map(tuple, L.written_once(rows, ["key"], ["at"], ["time"]).collect())) == [("k", 3, 1), ("n", 1, 0)]
    assert L.public(rows.withColumn("_x", F.lit(1)), "b").columns == ["key", "at", "time", "a"]


def test_redacted_json(spark):
    values = {'{"Password": {"a": 1}, "x": ["Bearer abcdefghi", 3, null, true]}': '{"Password":"[REDACTED]","x":["[REDACTED]",3,null,true]}', "no json sk-123456789 here": "no json [REDACTED] here", "5": "5", '{"prompt": "p", "promptly": "é"}': '{"prompt":"p","promptly":"é"}'}
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "t string").select("t", X.redacted_json(F.col("t")).alias("r"), X.redacted_json(F.col("t"), audit=True).alias("a")).collect()
    assert {r.t: r.r for r in rows} == values | {None: None}
    assert json.loads(next(r.a for r in rows if r.t and "promptly" in r.t)) == {"prompt": "[OMITTED]", "promptly": "é"}


def test_plan_trees(spark):
    schema = "plan int, node int, parent int, title string, kind string, role string"
    good = [(1, 1, None, "R", "synthesis", None), (1, 2, 1, "A", "concept", "category"), (1, 3, 2, "B", "entity", None)]
    bad = [(2, 1, None, "R", "synthesis", "page"), (2, 2, 3, "A", "concept", None), (2, 3, 2, "B", "entity", None), (2, 4, 1, "C", "other", None), (2, 5, 1, "c", "other", "own"), (2, 6, 9, "D", "entity", "source")]
    got = sorted(map(tuple, graph.tree_rules(spark.createDataFrame(good + bad, schema)).collect()))
    assert got == [(2, r) for r in sorted(["role_mismatch", "role_missing", "sibling_title", "cycle", "unreachable", "missing_parent"])]


def test_layout_pages(spark, tmp_path):
    layout = lambda *texts: json.dumps({"result": {"layoutParsingResults": [{"markdown": t} for t in texts]}})
    (tmp_path / "a.jsonl").write_text("\n".join([layout({"text": "one"}, "two"), "", "{", layout("x", " "), '{"result": {}}', layout("three"), layout({"text": 5})]) + "\n")
    pages, problems = records.layout_pages(spark, str(tmp_path))
    assert sorted((r.page, r.line, r.text) for r in pages.collect() if r.line != 7) == [(1, 1, "one"), (2, 1, "two"), (3, 6, "three")]
    assert {(r.line, r.problem) for r in problems.collect()} >= {(3, "invalid_json"), (4, "empty_page"), (5, "no_layouts")}
