"""Every query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from engrava.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return repr(round(v, 12) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(got.columns)
    rows = want.project(", ".join(got.columns)).fetchall()
    assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in rows)


def test_every_query_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
