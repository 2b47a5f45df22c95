import random
import re
from itertools import combinations

import duckdb

from tallyforge.llm import decontamination as D


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        w = tokens(text)
        for item_id, item in items:
            v = tokens(item)
            n, win = len(v), min(13, len(v))
            if n < 5:
                continue
            for diagonal in range(-n, len(w)):
                eq = [0 <= k + diagonal < len(w) and w[k + diagonal] == v[k] for k in range(n)]
                if sum(eq) < win - (2 if n >= 13 else 0):
                    continue
                starts = [k for k in range(n - win + 1) if 0 <= k + diagonal and k + diagonal + win <= len(w) and sum(eq[k : k + win]) >= win - (2 if n >= 13 else 0)]
                if starts:
                    a, b, c = out.get((doc_id, item_id), (10**9, 0, n))
                    out[doc_id, item_id] = (min(a, starts[0] + diagonal), max(b, sum(eq)), max(c, n))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def test_masks_lose_nothing():
    for a, b in combinations(range(13), 2):
        assert any(all(not (0 <= e - o < len(m) and m[e - o] == "1") for e in (a, b)) for m in D.MASKS for o in range(13 - len(m) + 1))


def test_planted_leaks_with_substitutions(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") * rng.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 7, 9, 12, 13, 14, 20, 40])))) for i in range(25)] + [(90, None), (91, ""), (None, "one two three four five six"), (92, "Same words, same words; same words! same words: same WORDS same words same words")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            v = tokens(rng.choice(items)[1])
            v = v[rng.randint(0, 3) :]
            for k in range(len(v)):
                if rng.random() < 0.12:
                    v[k] = word()
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    docs += [(500, None), (501, ""), (502, "--"), (None, "ONE two-three four five six"), (503, "same words " * 9), (503, "one two three four five six")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as w", "3 as hash")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as at")
    want = brute(docs, items)
    assert len(want) > 20
    for limit in (10**6, 0):
        got = sorted((tuple(r) for r in D.find_leaks(a, b, limit).select("doc_id", "item_id", "first_word", "n_equal", "item_words").collect()), key=str)
        assert got == want
    left = {(r.doc_id, r.text) for r in D.decontaminate(a, b).collect()}
    assert left == {x for x in docs if x[0] not in {w[0] for w in want}}


def test_documents_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(con.execute(D.SQL).fetchall())
    got = sorted(tuple(r) for r in D.find_leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")).collect())
    assert got == want and got


def test_empty_tables(spark, none, odd):
    empty = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox the quick brown fox")], "item_id long, text string")
    assert D.find_leaks(odd, empty).count() == 0 and D.find_leaks(none, items).count() == 0
    assert [r.doc_id for r in D.find_leaks(odd, items).collect()] == [1]
    assert D.decontaminate(odd, items).count() == odd.count() - 2
