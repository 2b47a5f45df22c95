import os
from decimal import Decimal

import duckdb
import pytest

from tallyforge.plans.catalogue import CATALOGUE

SF = os.environ.get("TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return ("decimal", str(v.normalize()))
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_equals_sql(spark, duck, name):
    query, sql = CATALOGUE[name]
    got = query(spark, SF)
    order = sorted(got.columns)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    cur = duck.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert len(a) == len(b)
    assert a == b
