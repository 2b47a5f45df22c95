import re
from collections import Counter

from tallyforge.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] >= 2:
            hit |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


def test_base_rules(both):
    got = quality.score(both, None, columns=("doc_id", "text")).collect()
    assert len(got) == both.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert r.kept == (not r.base_failed)


def test_model_separates_and_is_calibrated(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels, rows=2000)
    train = labels.where("pmod(xxhash64(doc_id), 1 << 20) >= (1 << 20) * 0.55").join(docs, "doc_id")
    got = quality.score(train.select("doc_id", "text", "quality"), model, columns=("doc_id", "quality")).where("not base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(bad) > 50
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_no_labels_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, labels) is None
    one_kind = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, one_kind) is None
    assert quality.score(none, None).count() == 0
    assert quality.score(odd, None, columns=("doc_id",)).count() == odd.count()
