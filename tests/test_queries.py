"""Every registered query of the reference's operators against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tabsmith.queries import core, matrices, publication, relational, storage  # noqa: F401

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    got = duck.execute(core.SQL[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0
