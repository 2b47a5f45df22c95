import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import sharding


def cost_of(flow):
    return sum(n for (i, j), n in flow.items() if i != j)


def test_flow_moves_fewest_units():
    rng = random.Random(1)
    for _ in range(200):
        k, m = rng.randint(1, 5), rng.randint(1, 6)
        supply = {i: rng.randint(0, 30) for i in range(k)}
        total = sum(supply.values())
        capacity = dict(enumerate(sharding.near_equal(total, m)))
        flow = sharding.min_cost_flow(supply, capacity)
        for i in supply:
            assert sum(n for (a, _), n in flow.items() if a == i) == supply[i]
        for j in capacity:
            assert sum(n for (_, b), n in flow.items() if b == j) == capacity[j]
        stays = sum(min(n, capacity.get(i, 0)) for i, n in supply.items())
        assert cost_of(flow) == total - stays


def test_flow_with_other_costs_against_enumeration():
    rng = random.Random(2)
    for _ in range(60):
        supply = {0: rng.randint(0, 4), 1: rng.randint(0, 4)}
        total = sum(supply.values())
        a = rng.randint(0, total)
        b = rng.randint(0, total - a)
        capacity = {0: a, 1: b, 2: total - a - b}
        cost = {(i, j): rng.randint(0, 9) for i in range(2) for j in range(3)}
        flow = sharding.min_cost_flow(supply, capacity, cost)
        best = min(
            sum(cost[0, j] * x[j] + cost[1, j] * (capacity[j] - x[j]) for j in range(3))
            for x in product(*(range(capacity[j] + 1) for j in range(3)))
            if sum(x) == supply[0]
        )
        assert sum(cost[k] * n for k, n in flow.items()) == best
    with pytest.raises(ValueError):
        sharding.min_cost_flow({0: 1}, {0: 2})


def verify(df, old, n):
    got = sharding.reshard_documents(df, old, n).collect()
    assert len(got) == df.count()
    sizes, slots = [0] * n, [[] for _ in range(n)]
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r.doc_id) for r in df.collect())
    return got, sizes


def test_documents_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got, sizes = verify(docs, F.pmod(F.crc32("source"), F.lit(16)), 24)
    assert max(sizes) - min(sizes) <= max(r.size for r in got)
    assert max(sizes) <= 1.02 * sum(sizes) / 24


def test_odd_rows(odd, none):
    verify(odd, F.pmod(F.crc32("source"), F.lit(3)), 2)
    verify(odd, F.lit(None), 3)
    assert sharding.reshard_documents(none, F.lit(0), 4).count() == 0


def test_rows_of_one_doc_id_are_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BYTES", 1000)
    rows = [(7 if i % 3 else None, f"text {i}" * (i % 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    r = sharding.Resharding(df, F.lit(0), 5)
    assert r.blocks > 20 and max(x["count"] for x in r._blocked(r.keyed).groupBy("block").count().collect()) < 150
    got, sizes = verify(df, F.lit(0), 5)
    assert max(sizes) - min(sizes) <= max(x.size for x in got)


def test_unaffected_files_stay(spark):
    rows = [(i, "x" * 92, i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = sharding.reshard(df, F.col("at"), 4).collect()
    assert all(r.shard == r.old_shard for r in got)
    got = sharding.reshard(df, F.col("at"), 5).collect()
    assert sum(r.shard != r.old_shard for r in got) == 80


def test_crc(spark):
    assert spark.sql("select crc32(encode('é', 'UTF-8'))").first()[0] == zlib.crc32("é".encode())
