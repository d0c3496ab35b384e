"""Every query with SQL gives the SQL's rows."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

from stridewell.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("orders", "events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    cur = db.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == names
    assert rows == Counter(tuple(plain(r[columns.index(n)]) for n in names) for r in cur.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
