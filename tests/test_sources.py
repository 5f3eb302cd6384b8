"""Files and records by hand: line numbers over many splits, damaged bytes, headers, bundles and their rules."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from knowlattice.operators import bundles as B
from knowlattice.sources import files, records


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = {"a.txt": [f"line {k} " + "x" * (k % 90) for k in range(3000)], "b.txt": ["", "second\r", ""], "c.txt": []}
    for name, text in lines.items():
        (tmp_path / "in" / name).write_text("".join(t + "\n" for t in text), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = records.numbered_lines(spark, str(tmp_path / "in"))
        assert found.select(F.spark_partition_id()).distinct().count() >= 1
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in found.collect())
    finally:
        for key, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(key, value)
    assert got == sorted((n, k + 1, t.removesuffix("\r")) for n, text in lines.items() for k, t in enumerate(text))


def test_json_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('\n{"_id": "1", "n": 2, "x": 1.5}\r\n\n{"_id": "2", "n": 3}\n{"_id": 5, "n": 1}\n{"_id": null, "n": 1}\n{"_id": "3", "n": "4"}\n{"_id": "4", "n": 1.5}\n{oops\n7\n')
    (tmp_path / "blank.jsonl").write_text("\n \n")
    (tmp_path / "none.jsonl").write_text("")
    got = records.json_lines(spark, str(tmp_path), {"_id": "string", "n": "bigint", "x": "double?"}).collect()
    seen = sorted((r.file.rsplit("/", 1)[1], r.line or 0, r.problem, r["_id"], r.n, r.x) for r in got)
    assert [s[:2] + s[3:] for s in seen if s[2] is None] == [("good.jsonl", 2, "1", 2, 1.5), ("good.jsonl", 4, "2", 3, None)]
    assert [s[:3] for s in seen if s[2]] == [("blank.jsonl", 0, "empty_file"), ("good.jsonl", 5, "type:_id"), ("good.jsonl", 6, "missing:_id"), ("good.jsonl", 7, "type:n"), ("good.jsonl", 8, "type:n"), ("good.jsonl", 9, "invalid_json"), ("good.jsonl", 10, "not_an_object")]


def test_judgments(spark, tmp_path):
    head = "query-id\tcorpus-id\tscore\n"
    (tmp_path / "a.tsv").write_text("\n" + head + "q1\td1\t2\nq1\td1\t1\n q2 \td1\t0\nq1\td2\t5\nq1\td2\t1\nq1\td3\nq1\td3\t\n")
    (tmp_path / "b.tsv").write_text("query-id\tcorpus-id\tgrade\nq\td\t1\n")
    (tmp_path / "c.tsv").write_text(head)
    got = sorted((r.file.rsplit("/", 1)[1], r.line or 0, r.problem, r.query_id, r.doc_id, r.grade) for r in records.judgments(spark, str(tmp_path)).collect())
    assert got == [
        ("a.tsv", 3, None, "q1", "d1", 2), ("a.tsv", 4, "duplicate", None, None, None), ("a.tsv", 5, None, "q2", "d1", 0), ("a.tsv", 6, "grade", None, None, None), ("a.tsv", 7, None, "q1", "d2", 1),
        ("a.tsv", 8, "fields", None, None, None), ("a.tsv", 9, "fields", None, None, None), ("b.tsv", 1, "header", None, None, None), ("b.tsv", 2, None, "q", "d", 1), ("c.tsv", 0, "no_judgments", None, None, None),
    ]


def test_text_files_and_blobs(spark, tmp_path):
    root = tmp_path / "in here"
    (root / "sub").mkdir(parents=True)
    contents = {"a.md": "﻿wörter".encode(), "sub/b.TXT": b"\xc3\x28", "c.pdf": b"%PDF", "d.exe": b"x", "e.txt": b"e", "f.tmp": b"half"}
    for name, raw in contents.items():
        (root / name).write_bytes(raw)
    declared = spark.createDataFrame([("a.md", "text/markdown"), ("e.txt", "text/markdown")], "name string, type string")
    got = {r.name: (r.problem, r.text, r.size) for r in files.text_files(spark, str(root), declared).collect()}
    assert got == {"a.md": (None, "wörter", 10), "sub/b.TXT": ("invalid_utf8", None, 2), "c.pdf": ("not_text", None, 4), "d.exe": ("type_unknown", None, 1), "e.txt": ("type_differs", None, 1)}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    stated = spark.createDataFrame([("a.md", 10, sha(contents["a.md"])), ("c.pdf", 5, sha(b"%PDF")), ("d.exe", 1, sha(b"y")), ("gone", 1, ""), ("e.txt", None, None)], "name string, size long, sha256 string")
    found = files.listing(spark, str(root), content=True).withColumn("sha256", F.sha2("content", 256))
    assert {r.name: r.state for r in files.verified(stated, found).collect()} == {"a.md": "ok", "c.pdf": "size_differs", "d.exe": "hash_differs", "gone": "missing", "e.txt": "size_differs"}
    assert [r.name for r in files.orphans(files.listing(spark, str(root)), stated).collect()] == ["sub/b.TXT"]
    assert {r.name: r.action for r in files.publication(stated, found).collect()} == {"a.md": "skip", "c.pdf": "skip", "d.exe": "refuse", "gone": "write", "e.txt": "refuse"}
    assert spark.range(1).select(files.blob_key(F.lit("abcd"))).first()[0] == "blobs/ab/abcd"


def chunk(**more):
    return {"chunkId": "c1", "resourceId": "r", "resourceVersionId": "v", "processingRunId": "x", "content": "words"} | more


@pytest.mark.parametrize(
    "chunks, wanted",
    [
        ([chunk()], []),
        ([chunk(content="  ")], ["content_empty"]),
        ([chunk(chunkId="a/b"), chunk(chunkId=None)], ["chunkId_not_stable"] * 2),
        ([chunk(title="t" * 513, resourceName="n" * 121)], ["resourceName_too_long", "title_too_long"]),
        ([chunk(title="")], ["title_empty"]),
        ([chunk(), chunk()], ["chunkId_repeated"]),
        ([chunk(parentChunkId="c1", parentContent="p")], ["own_parent", "parent_is_child"]),
        ([chunk(parentChunkId="p"), chunk(chunkId="c2", parentContent="p")], ["content_without_parent", "parent_without_content"]),
        ([chunk(parentChunkId="p", parentContent="1"), chunk(chunkId="c2", parentChunkId="p", parentContent="2")], ["parent_content_differs"]),
        ([chunk(), chunk(chunkId="c2", processingRunId="y")], ["resource_differs"]),
        ([chunk(resourceName="Evaluation resource r"), chunk(chunkId="c2")], []),
        ([chunk(parentChunkId="", contextHeader="h" * 100_001)], ["contextHeader_too_long"]),
    ],
)
def test_corpus_rules(spark, tmp_path, chunks, wanted):
    (tmp_path / "corpus.json").write_text(json.dumps({"schemaVersion": "v1", "chunks": chunks}, indent=2))
    rows, problems = records.bundles(spark, str(tmp_path), "chunks", B.CHUNK, "v1")
    assert problems.count() == 0 and sorted(r.rule for r in B.corpus_violations(rows).collect()) == wanted


def test_bundle_files(spark, tmp_path):
    for name, body in {"a": "{", "b": "[]", "c": '{"schemaVersion": "v2", "chunks": [{}]}', "d": '{"schemaVersion": "v1", "chunks": []}', "e": '{"schemaVersion": "v1"}'}.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows, problems = records.bundles(spark, str(tmp_path), "chunks", B.CHUNK, "v1")
    assert rows.count() == 0 and {r.file[-6]: r.problem for r in problems.collect()} == {"a": "invalid_json", "b": "not_an_object", "c": "schema_version", "d": "missing:chunks", "e": "missing:chunks"}


def test_query_and_judgment_rules(spark):
    queries = spark.createDataFrame([("f", "q1", "words", ["a"]), ("f", "q2", "🙂" * 257, [" "]), ("f", "q2", "", None), ("f", "q 3", "x", None)], f"file string, {B.QUERY.replace(': ', ' ')}")
    got = sorted((r.id, r.rule) for r in B.query_violations(queries).collect())
    assert got == [("q 3", "id_not_stable"), ("q2", "id_repeated"), ("q2", "query_empty"), ("q2", "query_too_long"), ("q2", "tag_empty")]
    chunks = spark.createDataFrame([("f", "c1"), ("f", "c2")], "file string, chunkId string")
    judged = [("q1", [("c1", 2.0), ("c9", 0.0)]), ("q2", [("c1", 0.0), ("c1", 3.0)]), ("q2", []), ("q9", [("c2", 1.5)])]
    found = B.qrel_violations(spark.createDataFrame(judged, "queryId string, relevant array<struct<chunkId: string, grade: double>>"), queries, chunks).collect()
    assert sorted((r.id, r.rule) for r in found) == sorted([
        ("q1", "chunk_unknown"), ("q2", "chunk_twice"), ("q2", "grade_out_of_range"), ("q2", "nothing_relevant"), ("q2", "query_twice"), ("q9", "grade_out_of_range"), ("q9", "query_unknown"), ("q 3", "query_not_judged"),
    ])
