"""Each query of the library's own operators against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from siltstone.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None:
        return "null"
    return "%.9g" % v if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in ORACLES:
        got = db.sql(ORACLES[name])
        names = list(got.columns)
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())
