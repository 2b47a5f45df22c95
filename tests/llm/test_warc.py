import hashlib
import struct

import zstandard

from tallyforge.llm import warc

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    digests = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            digests.setdefault(payload, []).append(page)
    out, used = [], set()
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min(digests.get(payload, [None]))
        response = first is None or (page == first and payload not in used)
        if page == first:
            used.add(payload)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(warc.archive_and_read(pages)) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_odd_rows_and_payloads(spark):
    a, b = "é" * 50, "b" * 99
    rows = [(5, "u", a), (3, None, a), (9, "x\r\ny", a), (3, "v", a), (1, "u", b), (2, "u", b), (4, None, None), (6, "u", ""), (None, "u", a), (7, "u", "long\r\n\r\n" * 300_000), (8, "u", "long\r\n\r\n" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as archive", "'d' as digest", "2 as bytes", "3 as nth", "4 as first")
    out = warc.archive_and_read(df)
    assert got(out) == brute(rows)
    kept = {r.page_id: bytes(r.payload) for r in out.where("record_type = 'response' and page_id is not null").collect()}
    assert kept[7] == b"long\r\n\r\n" * 300_000 and kept[3] == a.encode() and kept[4] == b""


def test_only_null_ids(spark):
    out = got(warc.archive_and_read(spark.createDataFrame([(None, "u", "x" * 100), (None, "v", "x" * 100)], SCHEMA)))
    assert [r[3] for r in out] == ["response", "revisit"] and {r[4] for r in out} == {None}


def test_dictionary_leads_and_records_stand_alone():
    records = [b"WARC/1.1 record about things that recur, number %d, and some more of it %d" % (i, i * i) for i in range(400)]
    frames = list(warc.pack(records))
    magic, size = struct.unpack_from("<II", frames[0])
    assert magic == warc.SKIPPABLE and size == len(frames[0]) - 8 > 0
    raw = zstandard.ZstdDecompressor().decompress(frames[0][8:])
    assert len(frames) == 401
    assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)).decompress(frames[200]) == records[199]
    assert list(warc.unpack(b"".join(frames))) == records
    assert sum(map(len, frames[1:])) < 0.7 * sum(len(zstandard.ZstdCompressor(warc.LEVEL).compress(r)) for r in records)


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.archive_and_read(empty).count() == 0


def test_archives_are_bounded(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    done = warc.write(pages, f"file://{tmp_path}/w", archive_bytes=100_000).collect()
    assert len(done) >= 5 and sum(r.records for r in done) == pages.count()
    assert warc.read(spark, f"file://{tmp_path}/w").count() == pages.count()


def test_record_ids_are_unique(spark, tmp_path, monkeypatch):
    a, b = "x" * 200, "y" * 200
    rows = [(1, "u", a), (1, "u", b), (1, "v", a), (None, "u", a), (None, "u", b), (None, "u", "short"), *[(2, "w", a)] * 30, *[(None, "w", b)] * 30]
    for run in (4096, 7):
        monkeypatch.setattr(warc, "RUN", run)
        warc.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/{run}", archive_bytes=2000, date="2026-01-02T03:04:05Z").collect()
        records = [r.decode() for f in (tmp_path / str(run)).glob("*.zst") for r in warc.unpack(f.read_bytes())]
        info = [r for r in records if "WARC-Type: warcinfo" in r]
        assert len(info) == len(list((tmp_path / str(run)).glob("*.zst"))) > 2
        field = lambda r, n: next((x.partition(": ")[2] for x in r.split("\r\n") if x.startswith(n + ": ")), None)
        ids = [field(r, "WARC-Record-ID") for r in records]
        assert len(set(ids)) == len(ids) == len(rows) + len(info)
        responses = {field(r, "WARC-Payload-Digest"): field(r, "WARC-Record-ID") for r in records if field(r, "WARC-Type") == "response"}
        named = [(field(r, "WARC-Payload-Digest"), field(r, "WARC-Refers-To")) for r in records if field(r, "WARC-Type") == "revisit"]
        assert len(named) == len(rows) - 3 and all(responses[d] == to for d, to in named)
        assert {field(r, "WARC-Date") for r in records} == {"2026-01-02T03:04:05Z"}
        assert got(warc.read(spark, f"file://{tmp_path}/{run}")) == brute(rows)


def test_sql_agrees(spark, tmp_path):
    import duckdb

    rows = [(5, "u", "é" * 50), (3, None, "é" * 50), (3, "v", "é" * 50), (1, "u", "b" * 99), (2, "u", "b" * 99), (4, None, None), (6, "u", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(con.execute(warc.SQL).fetchall(), key=str) == got(warc.archive_and_read(df))
