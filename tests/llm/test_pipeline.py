import hashlib

import corpus_pipeline as P


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        new = stage(spark, docs, small)
        assert new.columns == docs.columns and [f.dataType for f in new.schema] == [f.dataType for f in docs.schema], name
        docs = P.written(new, name)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] == sizes[3] and sizes[-1] > 0.4 * sizes[0]
    last = P.STAGES[-1][1](spark, docs, small)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = last.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_odd_and_empty_documents(spark, small, odd, none):
    for first in (odd, none):
        docs = first
        for _, stage in P.STAGES[1:-1]:
            new = stage(spark, docs, small)
            assert new.columns == docs.columns
            docs = P.written(new, "odd")
        assert P.STAGES[0][1](spark, docs, small).columns == docs.columns
        assert P.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_run(spark, small):
    assert P.run(spark, small).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
