"""Every registered query but the training-data ones, against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillmere.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool) or not (isinstance(v, (int, float)) or hasattr(v, "as_tuple")):
        return str(v).removesuffix(" 00:00:00")
    return f"{float(v):.6f}".replace("-0.000000", "0.000000")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    if name not in ORACLES:
        assert rows
        return
    found = oracle.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    places = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())
