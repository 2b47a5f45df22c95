"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

The row-wise form of the method explodes every pre-token with its position, encodes each distinct word once,
joins the ids back by word and reassembles each text by position. Here the same four steps run on packed rows,
so that what is shuffled stays well below the text itself:

1. explode: texts are cut into blocks; a block becomes its position stream (word numbers, text by text) and
   its distinct words, which leave as one packed row for each hash bucket of words;
2. encode: the words are shuffled by bucket, so all copies of a word meet in one task, which merges it once;
3. join back: the ids leave in the words' order and are shuffled to their block, where the stream waits;
4. reassemble: word numbers of a text are replaced by ids;
5. decode: the different ids of a block are joined to the token-byte table, and the bytes come back to the block.

A hot word costs one entry a block, whatever its count. No group is held: step 2 streams rows and keeps the
distinct words of its buckets, step 4 keeps one block.

Nulls: a null text counts as empty (no tokens), a null doc_id stays null. Empty text: no tokens, both hashes
are those of the empty string. Repeated rows and ties: each row gives a row. A very long text is a block of its
own; a very long word is merged by a heap in n log n. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

#: Bytes of text in a block, unless one text is longer.
BLOCK_BYTES = 8 << 20
#: Distinct words that a task remembers; beyond it, it forgets them all and goes on.
REMEMBERED = 1 << 20
#: Bytes of a word from which merging uses a heap.
LONG_WORD = 64

_PACKED = "target long, block long, bucket int, docs array<long>, counts array<long>, payload binary"
_ARROW = pa.schema(
    [
        ("target", pa.int64()),
        ("block", pa.int64()),
        ("bucket", pa.int32()),
        ("docs", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


@lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in ranks(path).items()}


def merge(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
    if word in rank:
        return [rank[word]]
    if len(word) >= LONG_WORD:
        return _merge_long(word, rank)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        if end[i] < n:
            r = rank.get(word[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[i], end[end[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, stop = heapq.heappop(heap)
        if end[i] != middle or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(rank[word[i : end[i]]])
        i = end[i]
    return ids


def _numbers(values) -> bytes:
    """32-bit numbers, byte by byte: first all lowest bytes, last all highest, which are mostly zero."""
    return np.ascontiguousarray(np.asarray(values, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _read_numbers(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view("<u4").ravel()


def _pack(sizes: list[int], data: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(struct.pack("<I", len(sizes)) + _numbers(sizes) + data)


def _unpack(payload: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    (n,) = struct.unpack_from("<I", raw)
    return _read_numbers(raw[4:], n), raw[4 + 4 * n :]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _explode(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        block = TaskContext.get().partitionId() + 1 << 32  # no bucket has such a number
        for batch in batches:
            for i, j, _, _ in slices(batch.column("text"), BLOCK_BYTES):
                number: dict[str, int] = {}
                stream: list[int] = []
                counts = []
                for text in batch.column("text")[i:j].to_pylist():
                    found = find(text or "")
                    counts.append(len(found))
                    stream += [number.setdefault(word, len(number)) for word in found]
                words = [w.encode() for w in number]
                at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(at, kind="stable")
                steps = np.diff(order, prepend=0).astype(np.int32).view(np.uint32)
                yield _rows([(block, block, -1, batch.column("doc_id")[i:j].to_pylist(), counts, _pack(steps, _numbers(stream)))])
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                out = []
                for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True):
                    own = [words[k] for k in order[a:b]]
                    bucket = int(at[order[a]])
                    out.append((bucket, block, bucket, None, None, _pack([len(w) for w in own], b"".join(own))))
                if out:
                    yield _rows(out)
                block += 1

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(path)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                if one.column("bucket")[0].as_py() < 0:
                    continue  # a stream
                sizes, data = _unpack(one.column("payload")[0].as_py())
                counts, ids, at = [], [], 0
                for size in sizes.tolist():
                    word = data[at : at + size]
                    at += size
                    got = known.get(word)
                    if got is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        got = known[word] = merge(word, rank)
                    counts.append(len(got))
                    ids += got
                block = one.column("block")[0].as_py()
                yield _rows([(block, block, one.column("bucket")[0].as_py(), None, None, _pack(counts, _numbers(ids)))])

    return run


def _used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of each block, once from each task that has a part of it."""
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            block = batch.column("target")[row].as_py()
            _, data = _unpack(batch.column("payload")[row].as_py())
            ids = np.unique(_read_numbers(data, len(data) // 4))
            new = np.setdiff1d(ids, seen[block], assume_unique=True) if block in seen else ids
            seen[block] = np.union1d(seen[block], new) if block in seen else ids
            if len(seen) > 64:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), block, np.int64)), pa.array(new.astype(np.int32))], ["target", "id"])


def _with_bytes(ids: DataFrame, path: str) -> DataFrame:
    """ids (with a column id) joined to the token-byte table, as `bytes`. It has a row for each token of a fixed
    vocabulary, so it may be broadcast."""
    tokens = ids.sparkSession.createDataFrame(pa.table({"id": pa.array(token_bytes(path).keys(), pa.int32()), "bytes": pa.array(token_bytes(path).values(), pa.binary())}))
    return ids.join(F.broadcast(tokens), "id")


def _reassemble(with_ids: bool):
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32())] * with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def finish(docs: list, doc_counts: list, stream: np.ndarray, ids_of: list[list[int]], table: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        text_of = [",".join(map(str, x)).encode() for x in ids_of]
        bytes_of = [b"".join([table[i] for i in x]) for x in ids_of]
        size_of = np.array([len(x) for x in ids_of], np.int64)
        rows, at = [], 0
        for doc_id, count in zip(docs, doc_counts, strict=True):
            own = stream[at : at + count]
            at += count
            numbers = own.tolist()
            row = [doc_id, int(size_of[own].sum()) if count else 0, hashlib.sha256(b",".join([text_of[k] for k in numbers])).hexdigest(), hashlib.sha256(b"".join([bytes_of[k] for k in numbers])).hexdigest()]
            rows.append(row + ([[i for k in numbers for i in ids_of[k]]] if with_ids else []))
        for a in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 500], strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("bucket")[row].as_py() >= 0:
                    continue  # words
                table = {x["id"]: x["bytes"] for x in batch.column("tokens")[row].as_py() or []}
                steps, raw = _unpack(batch.column("payload")[row].as_py())
                stream = _read_numbers(raw, len(raw) // 4)
                order = np.cumsum(steps.view(np.int32)).tolist()
                ids_of: list[list[int]] = [[]] * len(order)
                k = 0
                for part in sorted(batch.column("parts")[row].as_py() or [], key=lambda x: x["bucket"]):
                    counts, data = _unpack(part["payload"])
                    ids, at = _read_numbers(data, len(data) // 4).tolist(), 0
                    for n in counts.tolist():
                        ids_of[order[k]] = ids[at : at + n]
                        at += n
                        k += 1
                yield from finish(batch.column("docs")[row].as_py(), batch.column("counts")[row].as_py(), stream, ids_of, table)

    return run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the bytes that the ids decode to.
    path: a file of base64 tokens and ranks that every executor can open; pattern: what splits text before merging.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.select("doc_id", "text").mapInArrow(tidy(_explode(pattern, 4 * parts)), _PACKED).repartition(parts, "target")
    # the filter, which a join on target would put under one branch only, lets Spark reuse this exchange as well
    ids = packed.mapInArrow(tidy(_encode(path)), _PACKED).where("target is not null").select("target", "bucket", "payload").repartition(parts, "target")
    by_block = ids.groupBy("target").agg(F.collect_list(F.struct("bucket", "payload")).alias("parts"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    # streams are read from the exchange that words came through, which Spark reuses as both branches take all of it
    used = _with_bytes(ids.mapInArrow(tidy(_used), "target long, id int"), path)
    tokens = used.groupBy("target").agg(F.collect_list(F.struct("id", "bytes")).alias("tokens"))
    blocks = packed.join(by_block.hint("shuffle_hash"), "target", "left").join(tokens.hint("shuffle_hash"), "target", "left")
    return blocks.mapInArrow(tidy(_reassemble(with_ids)), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, ids) with a column `decoded` (binary): each id is joined to the token-byte table. A null list stays
    null."""
    keyed = encoded.withColumn("_row", F.monotonically_increasing_id())
    flat = _with_bytes(keyed.select("_row", F.posexplode("ids").alias("at", "id")), path)
    joined = flat.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("hex")))).alias("parts"))
    whole = joined.select("_row", F.unhex(F.array_join(F.col("parts.hex"), "")).alias("decoded"))
    empty = F.when(F.col("ids").isNotNull(), F.unhex(F.lit("")))
    return keyed.join(whole, "_row", "left").withColumn("decoded", F.coalesce("decoded", empty)).drop("_row")
