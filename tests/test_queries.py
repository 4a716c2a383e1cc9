"""Every query of the archive operators against its SQL on the smallest tables."""

import duckdb
import pytest

from tidewrack import bindings

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(bindings.queries()))
def test_query(spark, db, name):
    df = bindings.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = bindings.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
