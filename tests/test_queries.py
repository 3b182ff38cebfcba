"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from geocairn.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, float):
        return float(f"{v:.9g}") if math.isfinite(v) else str(v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name not in ORACLES:
        assert got.columns
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert rows(got.columns, values) == rows(names, want.fetchall())
    assert values or name in {"point_lookup"}
