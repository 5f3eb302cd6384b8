"""What citations meet: facts put together beforehand, so that few columns of the largest table are moved, and seldom."""

import re

from knowlattice.plans import catalog


def joins(df):
    """(columns, condition) of the joins of the largest side, top down."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [(len(re.match(r"[ :+-]*", x).group()), x) for x in lines if "Join " in x]


def test_owner_is_met_by_versions(spark):
    found = joins(catalog.QUERIES["citation_health"](spark, "/root/testdata/sf0.001"))
    depth = {k: max(d for d, x in found if k in x) for k in ("l_partkey", "l_orderkey", "o_custkey")}
    assert depth["l_partkey"] < depth["l_orderkey"] < depth["o_custkey"] and len(found) == 3


def test_files_are_met_by_versions(spark):
    found = joins(catalog.QUERIES["citation_states"](spark, "/root/testdata/sf0.001"))
    version = min(d for d, x in found if "version_id" in x and "_chunk" not in x)
    assert all(d > version for d, x in found if "_name" in x or "resource_id" in x) and len(found) == 5
