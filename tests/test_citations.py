"""Citation states in order of their reasons, and the policy ladder of plans."""

import pytest
from pyspark.sql import functions as F

from knowlattice.operators import citations as C


def test_states_in_order(spark):
    frame = spark.createDataFrame
    versions = frame([(1, 10, "a", 3, "s", "text/plain", 100, None, False), (2, 10, "b", 3, "s", C.PDF, 100, 2, True), (3, 11, "c", 3, "s", C.PDF, None, None, False), (4, 11, "d", 4, "s", "text/plain", 1, 1, False)], "version_id int, resource_id int, name string, size int, sha256 string, mime string, length int, page_count int, canonical boolean")
    files = frame([("a", 3, "s"), ("b", 3, "s"), ("c", 3, "s"), ("d", 3, "s")], "name string, size int, sha256 string")
    cases = [
        (9, '{"page": 1}', None, None, "broken", "version_missing"),
        (4, "nonsense", None, None, "broken", "integrity_failed"),
        (1, "nonsense", None, None, "broken", "locator:not_an_object"),
        (2, '{"page": 3}', None, None, "broken", "locator:beyond_pages"),
        (3, '{"startOffset": 0, "endOffset": 900}', None, None, "broken", "canonical_missing"),
        (3, '{"pages": [1]}', None, None, "broken", "page_count_unavailable"),
        (2, '{"chunkId": "gone"}', None, None, "broken", "chunk_missing"),
        (2, '{"chunkId": "there"}', 5, "no", "broken", "block_missing"),
        (2, '{"chunkId": "there"}', 5, "yes", "active", None),
        (1, '{"lineStart": 4}', 5, "", "needs_review", "newer_version"),
    ]
    cited = frame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, version_id int, locator string, page_version_id int, block_key string")
    got = C.citation_states(cited, versions, files, frame([("there", 2)], "chunk_id string, version_id int"), frame([(5, "yes")], "page_version_id int, block_key string"), frame([(10, 2), (11, 3)], "resource_id int, current_version_id int"))
    assert {r.k: (r.status, r.reason) for r in got.collect()} == {k: c[4:] for k, c in enumerate(cases)}
    assert got.columns == ["k", "version_id", "locator", "page_version_id", "block_key", "status", "reason"]


@pytest.mark.parametrize(
    "item, wanted",
    [
        (("warn", "page_create", 1, 1), ("unverified", 1, "ready_with_warnings")), (("warn", "page_create", 0, 0), ("unverified", 1, "ready_with_warnings")), (("required", "page_update", 0, 1), ("error", 0, "error")),
        (("required", "page_update", 0, 0), ("needs_evidence", 0, "draft")), (("warn", "tag_add", 0, 0), ("not_applicable", 0, "ready")), (("warn", "page_update", 2, 0), ("used", 0, "ready")), (("none", "page_create", 1, 0), ("used", 0, "ready")),
    ],
)
def test_policy_ladder(spark, item, wanted):
    given = [F.col(c) for c in ("policy", "item_type", "valid", "invalid")]
    rows = spark.createDataFrame([(1, *item)], "plan_id int, policy string, item_type string, valid int, invalid int").select("plan_id", C.evidence(*given).alias("evidence"), C.warnings(*given).alias("warnings"), C.risk(F.col("item_type")).alias("risk"))
    row, plan = rows.first(), C.plan_states(rows).first()
    assert (row.evidence, row.warnings, plan.status) == wanted and row.risk == {"tag_add": "low", "page_create": "medium", "page_update": "high"}[item[1]]


def test_vector_status(spark):
    rows = [(True, None, 3), (True, None, 0), (True, None, None), (False, None, 3), (True, "EMBEDDING_DISABLED", 3), (True, "EMBEDDING_EGRESS_BLOCKED", 3), (True, "TIMEOUT", 3)]
    got = spark.createDataFrame(rows, "e boolean, error string, hits int").select(C.vector_status(F.col("e"), F.col("error"), F.col("hits"))).collect()
    assert [r[0] for r in got] == ["used", "no_embeddings", "no_embeddings", "disabled", "disabled", "blocked", "degraded"]
