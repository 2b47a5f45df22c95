import os

import duckdb
import pytest

from tallyforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    got = queries.QUERIES[name](spark, small)
    order = sorted(got.columns)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == order
    want = sorted((tuple(r[names.index(c)] for c in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == want
