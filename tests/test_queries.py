"""Every query against its SQL on the smallest tables; queries without SQL run and have rows."""

import os

import duckdb
import pytest

from tempora.plans import guards, oracle, queries
from tempora.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


QUERIES, ORACLE_SQL = queries.QUERIES | guards.QUERIES, oracle.ORACLE_SQL | guards.ORACLE_SQL


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    rows = normal([tuple(r) for r in got.collect()], got.columns)
    assert rows[1]
    if name not in ORACLE_SQL:
        return
    want = db.sql(ORACLE_SQL[name])
    assert rows == normal(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
