"""Every registered engine query against its SQL oracle on a small scale."""

import duckdb
import pytest

from annulus.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "events", "orders"):
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(map(repr, (tuple(r[i] for i in at) for r in rel.fetchall())))
    assert got == want
