"""Queries against their SQL on the smallest tables."""

import datetime
import math
import numbers
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, numbers.Number):
        return round(float(v), 4)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return str(list(v)) if isinstance(v, (list, tuple)) else v


NAMES = sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op_"))


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
