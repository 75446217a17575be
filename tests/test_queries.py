"""Every query of the catalogue against its SQL on the smallest tables, and the entry points."""

import datetime
import decimal
import math

import duckdb
import pytest

from tallyloom.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)) and not (isinstance(v, float) and not math.isfinite(v)):
        return f"{v + 0.0:.6f}" if abs(v) < 1e9 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in ORACLE_SQL:
        cursor = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})")
        assert rows == sorted(tuple(map(plain, r)) for r in cursor.fetchall())
    else:
        assert rows


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
