"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from scholarlake.plans.oracle import ORACLES
from scholarlake.plans.queries import QUERIES
from scholarlake.plans.views import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def plain(rows):
    cell = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [[r[c] for c in columns] for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert plain(rows) == plain([[r[names.index(c)] for c in columns] for r in want.fetchall()])


def test_entry_without_training_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
