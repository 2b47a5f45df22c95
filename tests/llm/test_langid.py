import zlib

from pyspark.sql import functions as F

from tallyforge.llm import langid


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    got = langid.predict(docs, model, ("doc_id", "held_out", "lang")).collect()
    for r in got[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    rest = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in rest) >= 0.97 * len(rest)
    assert all(0 <= r.score <= 1 for r in got)
    taken = [r for r in rest if r.accepted]
    assert taken and sum(r.lang == r.lang_pred for r in taken) >= 0.98 * len(taken)


def test_odd_rows(odd, none):
    model = langid.fit(odd.where("doc_id is not null"))
    got = langid.predict(odd, model, ("doc_id",)).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (r.doc_id in (2, 3, 4, 12, 13))
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0
