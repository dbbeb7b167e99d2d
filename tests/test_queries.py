"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from demeframe import queries as Q

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "part", "orders", "supplier"):
        c.sql(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in Q.ORACLE_SQL:
        assert got
        return
    want = db.sql(Q.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
