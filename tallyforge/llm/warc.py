"""WARC writer with a dictionary, and its reader.

An archive is a file of Zstandard frames. The first is skippable and holds a dictionary, built from the records of that
archive; each record is a frame of its own, compressed with the dictionary, so any record can be read alone from its
offset. Of records with equal payloads of at least LEAST_REVISIT bytes that with the smallest page_id is a response and
the others are revisits, which name it and carry no payload. Smaller ones are all responses.

Rows are first counted by digest, page_id and url, in a narrow table. It tells which payloads recur and which page_id is
the smallest of each, and which rows are repeated. Repeated rows are collapsed to one with a count before they are
shuffled, and unfolded again, in runs of RUN records. So neither a payload nor a row of a third of all rows meets in one
task. Records are dealt to archives by a hash of page_id, digest, url and run, so many that an archive has about ARCHIVE_BYTES, and each archive is written by one task, to a temporary name that is
replaced when it is whole: a task that is lost and run again writes the same file. An archive's first record is its
warcinfo. A record's id is made from page_id, digest, url and its number among equal rows, so no two have one.

Nulls: a null html is an empty payload; a null page_id is written as an empty value, is never smaller than others, and
reads back as null; a null url is empty. Empty texts are responses. Very long payloads are a frame like others. Of rows
of one page_id and payload one is the response, that with the smallest url or any of equal rows. Empty table: no archives.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, shared_dir, tidy, written

# Fixed values of the formats: magic number of a skippable frame, and line ends.
SKIPPABLE = 0x184D2A5D
END = b"\r\n"

#: Payload bytes from which a repeated payload is a revisit.
LEAST_REVISIT = 100
#: Bytes of payload in an archive, about, and bytes of a dictionary at most.
ARCHIVE_BYTES, DICTIONARY_BYTES = 16 << 20, 64 << 10
#: Recurring payloads (about 100 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Records of one page_id and payload that are dealt together.
RUN = 4096
#: Fewest records that a dictionary is built from, and bytes of records: fewer are compressed without.
FEWEST = 8
LEVEL = 6
#: Segment length and substring length that dictionary building looks at; given, it makes one pass, not a search.
SEGMENT, SUBSTRING = 200, 8


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1" + END + b"".join(f"{k}: {v}".encode() + END for k, v in lines) + END + block + END + END


def _name(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _info(archive: str, date: str) -> bytes:
    block = b"software: tallyforge" + END + b"format: WARC File Format 1.1" + END
    return _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name("archive", archive)), ("WARC-Date", date), ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")], block)


def _record(kind: str, row: dict, date: str) -> bytes:
    """A record of a row of `plan`."""
    payload = (row["html"] or "").encode() if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["bytes"]
    page, first = ("" if row[c] is None else str(row[c]) for c in ("page_id", "first_page"))
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", _name(page, row["digest"], row["nth"], row["url"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((row["url"] or "").split())),
        ("WARC-Payload-Digest", "sha256:" + row["digest"]),
        ("X-Page-ID", page),
        *([("WARC-Refers-To", _name(first, row["digest"], 0, row["first_url"])), ("X-Refers-To-Page-ID", first), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if kind == "revisit" else []),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    return _head(head, http + payload)


def parse(record: bytes) -> dict | None:
    """A record's fields, null for a warcinfo; a response's payload is held against its digest, a revisit's is only named."""
    head, _, rest = record.partition(END + END)
    lines = head.split(END)
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {k: v for k, _, v in (line.decode().partition(": ") for line in lines[1:])}
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(END + END)
    number = lambda x: int(x) if x else None
    out = {"page_id": number(fields["X-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    digest = fields["WARC-Payload-Digest"].partition(":")[2]
    if out["record_type"] == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {out['page_id']} is damaged")
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}
    said = int(http.lower().partition(b"content-length: ")[2].split(END)[0])
    return out | {"refers_to": number(fields["X-Refers-To-Page-ID"]), "payload_bytes": said, "payload_digest": digest}


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from all records; empty if they are too few or too small to build one from."""
    if len(records) < FEWEST:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, records)) // 8)), records, k=SEGMENT, d=SUBSTRING, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # nothing recurs
        return b""


def pack(records: list[bytes]) -> Iterator[bytes]:
    """The frames of an archive, dictionary first."""
    raw = build_dictionary(records)
    stored = zstandard.ZstdCompressor(LEVEL).compress(raw) if raw else b""
    yield struct.pack("<II", SKIPPABLE, len(stored)) + stored
    packer = zstandard.ZstdCompressor(LEVEL, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(LEVEL)
    for record in records:
        yield packer.compress(record)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    stored = archive[8 : 8 + size]
    raw = zstandard.ZstdDecompressor().decompress(stored) if stored else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        frame = reader.decompressobj()
        yield frame.decompress(rest)
        left = len(frame.unused_data)
        rest = rest[len(rest) - left :]


def _keyed(pages: DataFrame) -> DataFrame:
    html: Column = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast if it is small; its rows have about 100 bytes."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def plan(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records to write for pages (page_id, url, html): page_id, url, html, bytes, digest, nth (number among equal rows),
    run (of RUN of these) and, where another row has the payload, first_page and first_url of its response."""
    spark = pages.sparkSession
    keyed = _keyed(pages)
    counts = written(keyed.groupBy("digest", "page_id", "url", "bytes").agg(F.count("*").alias("n")), "rows")
    lowest = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("low")
    firsts = counts.where(F.col("bytes") >= least).groupBy("digest").agg(lowest, F.sum("n").alias("copies")).where("copies > 1")
    firsts = written(firsts.select("digest", F.col("low.page_id").alias("first_page"), F.col("low.url").alias("first_url")), "payloads")
    repeated = written(counts.where("n > 1").select(F.col("digest").alias("r_digest"), F.col("page_id").alias("r_page"), F.col("url").alias("r_url"), "n"), "repeated")
    discard(spark, counts)
    zero = F.lit(0).cast("long")
    if repeated.isEmpty():
        records = keyed.withColumns({"nth": zero, "run": zero})
    else:
        known = _small(repeated)
        same = (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("url") == F.col("r_url"))
        single = keyed.join(known, same, "left_anti").withColumns({"nth": zero, "run": zero})
        # equal rows are collapsed where they are read, and unfolded with the payload where a record needs it
        folded = keyed.join(known, same, "left_semi").groupBy("digest", "page_id", "url", "bytes").agg(F.first("html").alias("html"), F.count("*").alias("n"))
        runs = folded.withColumn("run", F.explode(F.sequence(zero, F.expr(f"(n - 1) div {RUN}"))))
        runs = runs.withColumn("html", F.when((F.col("bytes") < least) | (F.col("run") == 0), F.col("html")))
        records = single.unionByName(runs.withColumn("nth", F.explode(F.expr(f"sequence(run * {RUN}, least(n, (run + 1) * {RUN}) - 1)"))).drop("n"))
    return records.join(_small(firsts).withColumn("copied", F.lit(True)), "digest", "left")


def _filesystem(path: str):
    return (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)) if path.startswith(("file:", "/")) else pyarrow.fs.FileSystem.from_uri(path)


def _archives(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        current, records = None, []

        def close() -> pa.RecordBatch:
            final = f"{root}/{current:08d}.warc.zst"
            partial = f"{final}.{uuid.uuid4().hex}.partial"
            size = 0
            with files.open_output_stream(partial, compression=None) as out:
                for frame in pack([_info(os.path.basename(final), date), *records]):
                    out.write(frame)
                    size += len(frame)
            files.move(partial, final)
            return pa.RecordBatch.from_arrays([pa.array([os.path.basename(final)]), pa.array([len(records)]), pa.array([size])], ["archive", "records", "bytes"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["archive"] != current:
                    if current is not None:
                        yield close()
                    current, records = row["archive"], []
                revisit = row["copied"] and ((row["page_id"], row["url"]) != (row["first_page"], row["first_url"]) or row["nth"] > 0)
                records.append(_record("revisit" if revisit else "response", row, date))
        if current is not None:
            yield close()

    return run


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) to archives in folder: archive, records, bytes.

    folder: a path that executors can write to, local or any that pyarrow knows. date: when the pages were captured, in
    the form 2026-01-31T00:00:00Z; by default the time of the call.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    spark = pages.sparkSession
    planned = plan(pages)
    total = pages.agg(F.sum(F.octet_length("html").cast("long")), F.count("*")).first()
    n = 1 + ((total[0] or 0) + 400 * total[1]) // archive_bytes
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    dealt = planned.withColumn("archive", F.pmod(F.xxhash64("page_id", "digest", "url", "run"), F.lit(n)))
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = dealt.repartition(parts, "archive").sortWithinPartitions("archive", "page_id", "digest", "url", "nth")
    done = sorted_rows.mapInArrow(tidy(_archives(folder, date)), "archive string, records long, bytes long")
    return written(done, "archives")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the archives in folder: page_id, url, record_type, refers_to, payload, payload_bytes and
    payload_digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("content"):
                rows: list[dict] = []
                for record in unpack(archive.as_py()):
                    fields = parse(record)
                    if fields is None:
                        continue
                    rows.append(fields)
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(tidy(run), "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Records of pages, written to archives in the shared folder and read back."""
    folder = shared_dir(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)


#: The same rows in DuckDB's SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
k AS (SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
n AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url) AS nth FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND nth > 1 THEN least END AS refers_to FROM n
"""
