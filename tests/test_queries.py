"""Every query of the library against its SQL in DuckDB, on the smallest tables; queries without SQL run and give rows."""

import math
import os

import duckdb
import pytest

from waymark.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    if name not in SQL:
        return
    r = con.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(x[i]) for i in order) for x in r.fetchall()]
    rows, want = sorted(rows, key=repr), sorted(want, key=repr)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-4)) for x, y in zip(a, b)), (a, b)
