"""Helpers shared by the training-data operators: inputs, the shared folder, Arrow text buffers and hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: blank, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one numpy step works on, unless a single text is longer.
SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir). It goes with the application.

    Only where the session names none, as in tests on one machine, a local folder is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tallyforge-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _files(spark, path)[0].deleteOnExit(_files(spark, path)[1])
    return path


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, of the JVM."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it cuts the lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that `written` made. What was made from it must be written itself by then."""
    for name in df.inputFiles()[:1]:
        files, path = _files(spark, name.rpartition("/")[0])
        files.delete(path, True)


def hash_bound(rows: int, total: int) -> int | None:
    """The value below which a signed 64-bit hash falls in `rows` of `total` cases; None if it always does."""
    return None if rows >= total else (rows << 64) // total - (1 << 63)


def plain_names(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but `keep` renamed, so that none clashes with another, and the new names by the old ones."""
    names = {c: c if c in keep else f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def text_hash(text: Column) -> Column:
    """What tells texts apart at first."""
    return F.xxhash64(text)


def text_key(texts: DataFrame, text: str = "text") -> Column:
    """A long for each different text in that column of texts, nulls and empty texts being one.

    It is a 64-bit hash. Texts that differ and have one hash are told by a second one, and get a third instead. Among 2^34
    texts there are about eight such hashes, so the list of them is short.
    """
    whole = F.coalesce(text, F.lit(""))
    first = text_hash(whole)
    other = texts.select(first.alias("h"), F.xxhash64(F.lit(1), whole).alias("o")).groupBy("h").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    shared = [r["h"] for r in other.where("low <> high").select("h").collect()]
    return F.when(first.isin(shared), F.xxhash64(F.lit(2), whole)).otherwise(first) if shared else first


def give_back() -> None:
    """Gives the memory that this process has no more use for back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, which other tasks use again, gives back the memory that it has no more use for."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and len + 1 offsets; a null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows with about `most` bytes together."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """64-bit hashes of any [start, end) of a byte array, by prefix sums: linear time, whatever the windows."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


#: Primes below 2^31, and a base for each.
_PRIMES = ((2147483647, 1103515245), (2147483629, 1812433253))


def _prime_powers(n: int, prime: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k, step = 1, base % prime
    while k < n:  # step is base to the power k
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(step) % np.uint64(prime)
        k, step = 2 * k, step * step % prime
    return out


class PrimeWindows:
    """Hashes of any [start, end) of a byte array like Windows, but modulo two primes: 62 bits that have nothing to do with
    those. The array may have 2^24 bytes."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        for prime, base in _PRIMES:
            name = f"{prime}"
            if len(_powers.get(name, ())) <= len(data):
                size = max(len(data) + 1, 1 << 16)
                _powers[name], _powers["-" + name] = (_prime_powers(size, prime, b) for b in (base, pow(base, -1, prime)))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[name][: len(data)], out=sums[1:])
            self.parts.append((np.uint64(prime), sums, _powers["-" + name]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((sums[end] - sums[start]) % prime * down[start] % prime for prime, sums, down in self.parts)
        return one << np.uint64(31) | two


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that lie end to end in data, and the text it is in."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[data], out=solid[1:-1])
    first, last = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[solid[cut] & solid[cut + 1]])  # a word of one text touches the next text's
    start = np.union1d(np.flatnonzero(first), cut)
    end = np.union1d(np.flatnonzero(last), cut)
    return start, end, np.searchsorted(at, start, "right") - 1


def per_text(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks each text has."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def long(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's long, bit by bit."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
