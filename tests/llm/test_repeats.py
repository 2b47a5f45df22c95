import hashlib
import random
from collections import Counter

import numpy as np

from tallyforge.llm import repeats
from tallyforge.llm.suffix_order import suffix_order


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        a = [*rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)).tolist(), 0]
        assert suffix_order(np.array(a)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    assert suffix_order(np.array([3] * 5000 + [0])).tolist() == list(range(5000, -1, -1))


def brute(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if t else 0
        kept = bytes(b for b, g in zip(t, gone) if not g)  # noqa: B905
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, least=200):
    rows = df.select("doc_id", "text").collect()
    want = brute([(r.text or "").encode() for r in rows], least)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in repeats.remove_repeats(df, least=least).collect()]
    assert sorted(got, key=str) == sorted(((r.doc_id, *w) for r, w in zip(rows, want, strict=True)), key=str)


def test_documents(both):
    check(both)


def test_shared_passages_with_every_kind_of_edge(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 30) : len(p) - rng.randint(0, 30)] if rng.random() < 0.7 else " ".join(word() for _ in range(rng.randint(5, 60))))
        texts.append(rng.choice([" ", "", "\n"]).join(parts))
    texts += ["x" * n for n in (199, 200, 201, 450)] + ["ab" * 300, "ab" * 100, texts[0], texts[0], "\0" * 230, "\0" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(df)
    check(df, 90)
    monkeypatch.setattr(repeats, "STEP", 1000)
    monkeypatch.setattr(repeats, "TOGETHER", 4)
    check(df)


def test_hot_keys_are_opened(spark, monkeypatch):
    rows = [(i, f"{i * 7919} some start " + "shared passage of many documents, " * 9 + f" {i * 104729} end {i % 5} " + "x" * (i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # the limits are read in the workers: call the streaming function itself
    texts = [r[1].encode() for r in rows]
    keys, sides, at = [], [], []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        _, first, windows, anchor, key, _ = repeats._anchors_of(data, np.array([0, len(t)]), 200)
        for f, w, a, k in zip(first.tolist(), windows.tolist(), anchor.tolist(), key.tolist(), strict=True):
            keys.append(k)
            at.append(f << 16 | (a - f) << 8 | w)
            sides.append(t[f:a].rjust(64, b"\0") + t[a + 136 : f + w - 1 + 200].ljust(64, b"\0"))
    import pyarrow as pa

    order = np.argsort(np.array(keys, np.uint64).view(np.int64), kind="stable")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.array(keys, np.uint64).view(np.int64)[order]), pa.array(order), pa.array(np.array(at)[order]), pa.array(np.ones(len(order), np.int32)), pa.array([sides[k] for k in order], pa.binary())],
        ["key", "doc", "at", "kind", "sides"],
    )

    def covered(most):
        monkeypatch.setattr(repeats, "MOST_EDGES", most)
        parts = [batch.slice(k, 7) for k in range(0, batch.num_rows, 7)]
        spans = pa.Table.from_batches(list(repeats._ordered(200)(iter(parts)))).sort_by([("first", "ascending"), ("second", "ascending"), ("open", "ascending")])
        out = pa.Table.from_batches(list(repeats._closed(iter(spans.to_batches(max_chunksize=5))))).to_pylist()
        return {(r["doc"], k) for r in out for k in range(r["start"], r["stop"])}, any(spans.column("open").to_pylist())

    plain, hot = covered(10**6), covered(5)
    assert plain[0] == hot[0] and plain[0] and hot[1] and not plain[1]
    check(df)


def test_hot_copies_and_passages(spark, monkeypatch):
    passage = "a passage that stands in very many of the documents, word for word, and that is long enough to be an anchor of its own, " * 3
    rows = [(i, "the same text " * 20) for i in range(60)] + [(100 + i, f"{i * 7919} before " + passage + f" after {i * 104729}") for i in range(80)] + [(300 + i, "short") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(repeats, "HOT", 10)
    check(df)
    anchors = df.selectExpr("xxhash64(text) as doc", "text").mapInArrow(repeats._anchors(200), "key long, whole long, doc long, at long, known boolean")
    most = anchors.groupBy("key", "whole").count().agg({"count": "max"}).first()[0]
    assert most <= 2 * df.rdd.getNumPartitions()
    assert len(repeats._hot_texts(df.selectExpr("xxhash64(text) as doc"))) == 2


def test_whole_characters(spark):
    rows = [(1, "é" * 150 + "a"), (2, "z" + "é" * 150), (3, None), (4, "ok")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: bytes(r.kept).decode() for r in repeats.remove_repeats(df, whole_characters=True).collect()}
    assert out[1] == "a" and out[2] == "z" and out[3] == "" and out[4] == "ok"


def test_empty_table(none):
    assert repeats.remove_repeats(none).count() == 0
