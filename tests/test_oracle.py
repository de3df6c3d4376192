"""Every query with checking SQL, compared with DuckDB on the driver's tables."""

import duckdb
import pytest
from conftest import SF_DIR, TABLES

from quillmark.plans import catalog


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    yield con
    con.close()


def _key(row):
    return tuple((v is not None, "" if v is None else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    expected = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    index = [expected.columns.index(c) for c in columns]
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=_key)
    theirs = sorted((tuple(r[i] for i in index) for r in expected.fetchall()), key=_key)
    assert len(ours) == len(theirs) and len(ours) > 0
    assert ours == theirs


def test_catalog_is_consistent():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
