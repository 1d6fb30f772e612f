"""Every core query that has SQL gives the rows of the SQL, on the smallest tables."""

import glob
import os

import pytest

from cordonlake import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_same_rows(spark, con, name):
    df = queries.all_queries()[name](spark, DATA)
    rel = con.sql(queries.all_oracles()[name])
    order = sorted(df.columns)
    assert sorted(rel.columns) == order
    got = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(norm(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())

