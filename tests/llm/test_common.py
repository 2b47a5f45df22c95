import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import common, decontamination, repeats, sharding, simhash


def test_hash_bound_keeps_the_share_at_any_size():
    assert common.hash_bound(2000, 0) is None and common.hash_bound(2000, 2000) is None
    for total in (2001, 10**6, 10**9, 22 * 10**8, 10**12):
        share = (common.hash_bound(2000, total) + (1 << 63)) / (1 << 64)
        assert 0 < share and abs(share * total - 2000) < 1


def test_sample_follows_the_bound(spark):
    n = spark.range(200_000).where(F.xxhash64("id") < common.hash_bound(2000, 200_000)).count()
    assert 1800 < n < 2200


@pytest.fixture()
def clashing(spark):
    """Columns named like those that operators make on the way."""
    rows = [(i, text, "s%d" % (i % 3), i, "x", "y", 1, 2, 3, 4, 5, 6) for i, text in enumerate([" ".join(f"w{k}" for k in range(j, j + 30)) for j in (1, 1, 40, 80, 120)] + [None, ""])]
    names = ["doc_id", "text", "source", "a.b", "_leaked", "leaked", "_old", "old", "hash", "c0", "_key", "row"]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, x long, a string, b string, c long, d long, e long, f long, g long, h long").toDF(*names)


def test_clashing_names(spark, clashing):
    whole = {r[0]: tuple(r) for r in clashing.collect()}
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and {r[0]: tuple(r) for r in kept.collect()} == {k: whole[k] for k in (0, 2, 3, 4, 5)}
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(82, 100)))], "item_id long, text string")
    clean = decontamination.decontaminate(clashing, items)
    assert clean.columns == clashing.columns and {r[0]: tuple(r) for r in clean.collect()} == {k: whole[k] for k in (0, 1, 2, 4, 5, 6)}
    placed = sharding.reshard_documents(clashing, F.pmod(F.crc32("source"), F.lit(2)), 3)
    assert placed.columns == [*clashing.columns, "old_shard", "size", "shard", "slot"]
    assert {r[0]: tuple(r)[: len(clashing.columns)] for r in placed.collect()} == whole


def test_texts_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(common, "text_hash", lambda c: F.length(c).cast("long"))
    a, b = "the first of two passages that are as long, " * 8, "another one of these passages that are as l" * 8
    b = b[: len(a)].ljust(len(a), "x")
    rows = [(0, a), (1, b), (2, a), (3, "p" * len(a)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", common.text_key(docs).alias("key")).collect()
    keys = {r.doc_id: r.key for r in keyed}
    assert keys[0] == keys[2] and len({keys[k] for k in (0, 1, 3, 4)}) == 4 and keys[4] == keys[5]
    out = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    monkeypatch.undo()
    assert out == {r.doc_id: (r.n_removed, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert out[0][1] == b"" and out[3][0] > 0
    monkeypatch.setattr(common, "text_hash", lambda c: F.length(c).cast("long"))
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [0, 1, 3, 4]


def test_window_hashes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 4, 3000).astype(np.uint8)
    thue = np.array([bin(k).count("1") & 1 for k in range(1 << 11)], np.uint8)
    data = np.concatenate([data, thue, 1 - thue, data])
    start = rng.integers(0, len(data) - 300, 4000)
    end = start + rng.integers(1, 4, 4000)
    for kind in (common.Windows, common.PrimeWindows):
        h = kind(data)(start, end)
        by = {}
        for a, b, x in zip(start, end, h, strict=True):
            by.setdefault(data[a:b].tobytes(), set()).add(int(x))
        assert all(len(x) == 1 for x in by.values()) and len({x.pop() for x in by.values()}) == len(by)
    a, b = np.array([3000]), np.array([3000 + (1 << 11)])
    size = 1 << 11
    assert common.Windows(data)(a, a + size) == common.Windows(data)(b, b + size)  # what such hashes can't tell apart
    assert common.PrimeWindows(data)(a, a + size) != common.PrimeWindows(data)(b, b + size)
