import re

import numpy as np
import xxhash

from tallyforge.llm import components, simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(fps, most):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_documents(both):
    got = simhash.near_duplicates(both).collect()
    assert len(got) == both.count()
    want = sorted((str(r.doc_id), brute_fp(r.text)) for r in both.collect())
    assert sorted((str(r.doc_id), r.fp % (1 << 64)) for r in got) == want
    label = brute_groups([r.fp % (1 << 64) for r in got], 3)
    for k, r in enumerate(got):
        ids = [g.doc_id for g, x in zip(got, label, strict=True) if x == label[k] and g.doc_id is not None]
        assert r.component_id == min(ids)


def clusters(n, seed, bits):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n // 10, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = []
    for _ in range(n):
        x = int(base[rng.integers(len(base))])
        for b in rng.integers(0, 64, rng.integers(0, bits + 1)):
            x ^= 1 << int(b)
        out.append(x)
    return out


def same(spark, fps, most):
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.groups(df, simhash.links(df, most)).collect()}
    label = brute_groups(fps, most)
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    assert got == {i: first[x] for i, x in enumerate(label)}


def test_links_of_planted_clusters(spark):
    same(spark, clusters(1500, 1, 5), 3)
    same(spark, clusters(1500, 2, 9), 7)


def test_hot_anchors_are_split(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = [0x0123456789ABCDEF ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 4))) for _ in range(800)]
    monkeypatch.setattr(simhash, "HOT", 5)
    monkeypatch.setattr(simhash, "GATHERED", 16)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    same(spark, fps, 3)


def test_anchors_are_all_within_radius_plus_one():
    rng = np.random.default_rng(4)
    for bits, (length, _, radius) in simhash._CODES.items():
        part = rng.integers(0, 1 << bits, 200)
        home = simhash.nearest(part, bits)
        assert (np.bitwise_count(home ^ part) <= radius).all()
        assert (simhash.nearest(home, bits) == home).all()
        words = np.unique(simhash.nearest(np.arange(1 << length), bits))
        assert len(words) == (1 << length) // sum(np.prod(np.arange(length - k + 1, length + 1)) // np.prod(np.arange(1, k + 1)) for k in range(radius + 1))
        fp = part.astype(np.uint64)
        row, anchor, _ = simhash.anchors(fp, bits)
        for k in range(20):
            low, rest = int(part[k]) & ((1 << length) - 1), int(part[k]) >> length << length
            near = {int(w) | rest for w in words[np.bitwise_count(words ^ low) <= radius + 1]}
            free = {int(home[k]) ^ 1 << b for b in range(length, bits)}
            assert {int(a) for a in anchor[(row == k) & (anchor >> 56 == 0)]} == near | free


def test_components(spark):
    links = [(5, 4), (4, 9), (9, 1), (7, 7), (20, 30), (30, 40), (40, 50), (50, 60), (60, 20), (2, 3), (3, 2), *[(100 + i, 101 + i) for i in range(40)], *[(500, 501 + i) for i in range(50)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {5: 1, 4: 1, 9: 1, 1: 1, 2: 2, 3: 2, **dict.fromkeys(range(20, 61, 10), 20), **dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(500, 551), 500)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_of_each_group(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    rows = docs.collect()

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [shingles(r.text) for r in rows]
    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {(a, b) for ids in where.values() if 1 < len(ids) for a in ids for b in ids if a < b}
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r.doc_id)
    best = {min(g) for g in groups.values()}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert best == kept and len(groups) < 0.97 * len(rows)


def test_keep_one_of_odd_rows(odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 8, 9, 10, 11, 13]
    assert simhash.keep_one(none).count() == 0


def kept(spark, texts):
    return sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def invented(rng, n):
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(n)]


def test_keep_one_links_variants_through_their_base(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(3):
        base = invented(rng, 120)
        texts.append(" ".join(base))
        for k in range(30):  # 8 of 116 shingles go: 108 of 124 are in common with the base, 100 of 132 with another variant
            at = 5 + int(rng.integers(0, 100))
            texts.append(" ".join([*base[:at], *base[at + 4 :], *invented(rng, 4)] if k % 2 else [*base[:at], *invented(rng, 4), *base[at + 4 :]]))
    assert kept(spark, texts) == [0, 31, 62]
    monkeypatch.setattr(simhash, "HOT", 3)
    assert kept(spark, texts) == [0, 31, 62]


def test_keep_one_compares_all_texts_of_a_fingerprint(spark):
    rng = np.random.default_rng(6)
    words, texts = invented(rng, 100), []
    for _ in range(5):  # other orders of the same words: one fingerprint, no shingle in common
        order = [words[k] for k in rng.permutation(100)]
        texts += [" ".join(order), " ".join([*order[:50], order[51], order[50], *order[52:]])]
    assert len({simhash.fingerprint(t, 1, distinct=True) for t in texts}) == 1
    assert kept(spark, texts) == [0, 2, 4, 6, 8]


def test_keep_one_finds_copies_beyond_seven_bits(spark):
    rng = np.random.default_rng(7)
    texts = []
    while len(texts) < 20:
        own = invented(rng, 60)
        two = [" ".join(own), " ".join([*own, *invented(rng, 12)])]  # 56 of 68 shingles
        a, b = (simhash.fingerprint(t, 1, distinct=True) for t in two)
        if (a ^ b).bit_count() > 7:
            texts += two
    assert kept(spark, texts) == list(range(0, 20, 2))
