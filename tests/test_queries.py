"""Every registered query of the library's own operators against its SQL twin."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corpusloom import plans


def _rows(frame, columns):
    return sorted(repr(tuple(None if x != x else x for x in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, db, name):
    found = plans.QUERIES[name](spark, sf).toPandas()
    if name not in plans.ORACLES:
        assert len(found.columns) > 0
        return
    want = db.sql(plans.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    assert _rows(found, columns) == _rows(want, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
