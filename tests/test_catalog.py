"""Every query of the catalogue against its SQL, on the same files; those without SQL must run and keep a stable schema."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from knowlattice.plans import catalog

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    if name not in catalog.SQL:
        assert found.columns
        return
    relation = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in relation.description]
    wanted = rows_of(columns, relation.fetchall())
    assert sorted(found.columns) == sorted(columns)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert a == b and [type(x) for x in a] == [type(x) for x in b]
