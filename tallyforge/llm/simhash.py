"""SimHash near-dedup by anchor-point covering.

A fingerprint of 64 bits stands for a text. Two fingerprints that differ in at most t bits are linked, and a group is
what links connect. To find links without comparing all pairs, the 64 bits are cut into equal parts, so many that one
of them differs in at most one bit (two parts for t = 3, four for t = 7). On a part, the words of a covering code are
the anchors: the perfect Golay code on 23 of 32 bits, or the perfect Hamming code on 15 of 16, with the bits left over
taken as they are. Every fingerprint is at home at its nearest anchor and is replicated to every anchor within the
covering radius plus one, so a link's ends meet at the home of either. Per anchor those at home are compared with all.

Equal fingerprints are one before anything is compared. An anchor with more than HOT at home is split: its homes are
dealt to several tasks and those within reach are sent to each, as blocks of a query set against the rest. A task holds
the homes of an anchor and streams the rest. What is emitted are spanning forests of links, not pairs.

Nulls: a null text has no words and the fingerprint zero, like an empty one; a null doc_id is never the smallest of a
group unless all are null. Repeated rows have equal fingerprints. Very long texts are summed up in steps. Ties: a bit
set in just half of the hashes is zero. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_names, text_key, tidy, written
from .components import components

#: Homes of an anchor beyond which it is split, and rows that a task gathers before it compares.
HOT, GATHERED = 4096, 1 << 16
#: Hashes summed up at once.
STEP = 1 << 13
#: Pairs compared at once.
BLOCK = 1 << 21
#: First shingles that are packed at once, and the share of a text's shingles that are looked at besides those that a
#: similar text may lack. Any share gives the same links; a larger one deals out more and tells common passages apart better.
PACKED, SEEN = 1 << 20, 0.2
#: Parts that a text's shingles are counted in.
SKETCH = 128
#: Keys (8 bytes each) up to which they are broadcast, so that texts aren't shuffled.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str, width: int, distinct: bool = False) -> int:
    """Of all shingles of `width` words, or of the different ones; of all words together if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width))))) if len(words) >= width else [b" ".join(words)]  # noqa: B905
    if distinct:
        shingles = list(set(shingles))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(shingles), STEP):
        hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles[a : a + STEP]]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int, distinct: bool = False, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, which has `text`, with the fingerprint as a long, bit by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text or "", width, distinct) for text in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prints.view(np.int64))], [*names, "fp"])

    names = [f"_{k}" for k in range(len(columns))]
    kept = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(columns, names, strict=True))
    own = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), "text")
    out = own.mapInArrow(tidy(run), f"{kept}, fp long")
    return out.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), "fp")


@lru_cache(2)
def _code(length: int, generator: int, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a perfect cyclic code: syndromes of the low and of the high bits, and the error of each syndrome."""
    check = generator.bit_length() - 1

    def remainder(word: int) -> int:
        while word.bit_length() > check:
            word ^= generator << (word.bit_length() - 1 - check)
        return word

    single = [remainder(1 << k) for k in range(length)]
    low = length // 2
    tables = []
    for bits in (single[:low], single[low:]):
        syndromes = np.zeros(1, np.int64)
        for s in bits:
            syndromes = np.concatenate([syndromes, syndromes ^ s])
        tables.append(syndromes)
    error = np.full(1 << check, -1, np.int64)
    error[0] = 0
    layer = {0: 0}
    for _ in range(radius):
        layer = {s ^ single[k]: e | 1 << k for s, e in layer.items() for k in range(length) if not e >> k & 1}
        for s, e in layer.items():
            if error[s] < 0:
                error[s] = e
    assert (error >= 0).all()  # perfect: every word is within the radius of one code word
    return tables[0], tables[1], error


#: Bits of a part: bits in the code, its generator polynomial and its radius.
_CODES = {32: (23, 0b101011100011, 3), 16: (15, 0b10011, 1)}


def nearest(part: np.ndarray, bits: int) -> np.ndarray:
    """The anchor that a part is at home at: the code word next to its low bits, and its other bits."""
    length, generator, radius = _CODES[bits]
    low, high, error = _code(length, generator, radius)
    word = part & ((1 << length) - 1)
    return part ^ error[low[word & (len(low) - 1)] ^ high[word >> (length // 2)]]


def anchors(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is home, for each part and each anchor within covering radius plus one."""
    rows, found, home = [], [], []
    for k in range(64 // bits):
        part = (fp >> np.uint64(k * bits)).astype(np.int64) & ((1 << bits) - 1)
        near = np.stack([nearest(part, bits), *(nearest(part ^ (1 << b), bits) for b in range(bits))], axis=1)
        first = near[:, :1].copy()
        near.sort(axis=1)
        new = np.ones(near.shape, bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        found.append(near[row, col] | k << 56)
        home.append(near[row, col] == first[row, 0])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicate(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fp), STEP):
                row, anchor, home = anchors(fp[a : a + STEP], bits)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(fp[a : a + STEP][row].view(np.int64))], ["anchor", "home", "fp"])

    return run


class _Forest:
    """Union-find over fingerprints that yields the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        root = x
        while (up := self.up.get(root, root)) != root:
            root = up
        while (up := self.up.get(x, x)) != root:
            self.up[x] = root
            x = up
        return root

    def join(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        order = np.argsort(distance, kind="stable")  # closest first, so the forest is a shortest one
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self.up[p] = q
                self.links.append((x, y))

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in self.links], pa.int64()) for k in (0, 1)], ["a", "b"])
        self.links = []
        return out


def _compare(homes: np.ndarray, others: np.ndarray, most: int, forest: _Forest) -> None:
    step = max(1, BLOCK // max(1, len(homes)))
    for a in range(0, len(others), step):
        distance = np.bitwise_count(homes.view(np.uint64)[None, :] ^ others[a : a + step].view(np.uint64)[:, None])
        row, col = np.nonzero((distance <= most) & (distance > 0))
        forest.join(others[a + row], homes[col], distance[row, col])


def _linked(most: int):
    """Rows sorted by anchor, block and left (homes of the block first): a spanning forest of the links per set of rows."""

    def compare(group: np.ndarray, left: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        forest = _Forest()
        cuts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(np.append(cuts, len(group)))
        homes = np.add.reduceat(left.astype(np.int64), cuts)
        small = homes * size <= 4096
        own = np.flatnonzero(small & (homes > 0) & (size > 1))
        pairs = np.cumsum(homes[own] * size[own])
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + BLOCK, "right")))
            g = own[a:b]
            n = homes[g] * size[g]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            base, wide = np.repeat(cuts[g], n), np.repeat(size[g], n)
            x, y = fp[base + nth // wide], fp[base + nth % wide]
            distance = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64))
            hit = (distance <= most) & (distance > 0)
            forest.join(x[hit], y[hit], distance[hit])
            a = b
        for g in np.flatnonzero(~small):
            rows = slice(cuts[g], cuts[g] + size[g])
            _compare(fp[rows][: homes[g]], fp[rows], most, forest)
        return forest.take()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            group = np.cumsum(np.append(True, (np.diff(batch.column("anchor").to_numpy()) != 0) | (np.diff(batch.column("block").to_numpy()) != 0)))
            cols = [group, batch.column("left").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy()]
            name = batch.column("anchor")[0].as_py(), batch.column("block")[0].as_py()
            if held is not None:
                cols[0] = cols[0] + (held[0][-1] - 1 if name == last else held[0][-1])
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = batch.column("anchor")[-1].as_py(), batch.column("block")[-1].as_py()
            held = cols
            if len(cols[0]) >= GATHERED:
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                if cut:
                    yield compare(*(c[:cut] for c in cols))
                held = [c[cut:] for c in cols]
                if len(held[0]) >= GATHERED:  # one group: its homes stay, what came is compared and goes
                    yield compare(*held)
                    held = [c[held[1]] for c in held]
        if held is not None and len(held[0]):
            yield compare(*held)

    return run


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """a, b: links between different values of `fp` that differ in at most `most` bits, up to 7.

    Not all of them: enough that all fingerprints that links connect stay connected, closest ones first.
    """
    bits = 32 if most <= 3 else 16
    if not 0 <= most <= 7:
        raise ValueError("most must be 0 to 7")
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = prints.select("fp").distinct().mapInArrow(tidy(_replicate(bits)), "anchor long, home boolean, fp long")
    hot = near.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    blocks = hot.select("anchor", F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    dealt = near.join(blocks, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = dealt.select("anchor", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks", "home", "fp")
    each = each.select("anchor", "block", (F.col("home") & (F.pmod(F.xxhash64("fp"), F.col("blocks")) == F.col("block"))).alias("left"), "fp")
    by = each.repartition(parts, "anchor", "block").sortWithinPartitions("anchor", "block", F.desc("left"))
    return by.mapInArrow(tidy(_linked(most)), "a long, b long")


def groups(prints: DataFrame, found: DataFrame) -> DataFrame:
    """prints (doc_id, fp) with component_id, the smallest doc_id that links reach, itself included."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    nodes = components(found).select(F.col("node").alias("fp"), "component")
    labelled = least.join(nodes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    return prints.join(labelled.join(smallest, "component").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of docs (doc_id, text)."""
    prints = written(fingerprints(docs, width), "fingerprints")
    return groups(prints, written(links(prints, most), "near"))


def _shingles(text: str, width: int) -> np.ndarray:
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = list(map(b" ".join, zip(*(words[k:] for k in range(width))))) if len(words) >= width else [b" ".join(words)]  # noqa: B905
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s) for s in parts]), ">u8").astype(np.uint64))


def _small(keys: DataFrame) -> DataFrame:
    """keys, a written table, to be broadcast if it is small."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def similar(pairs: DataFrame, rows: DataFrame, width: int, least: float) -> DataFrame:
    """Those pairs (a, b, different) of keys of rows (key, text; equal keys have equal texts) whose sets of shingles have a
    Jaccard similarity of `least` or more. Two texts without words are alike. A text is read once for all its pairs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, (None, None)  # the first text of a pair until the second comes; the first text that was read last
        for batch in batches:
            found = []
            for a, b, key, text in zip(*(batch.column(c) for c in ("a", "b", "key", "text")), strict=True):
                a, b, key = a.as_py(), b.as_py(), key.as_py()
                if key == a:
                    last = last if last[0] == a else (a, _shingles(text.as_py() or "", width))
                    held = (a, b)
                elif held == (a, b):
                    x, y = last[1], _shingles(text.as_py() or "", width)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both >= least * (len(x) + len(y) - both):
                        found.append((a, b))
                    held = None
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if one.isEmpty():
        return one
    # a key in very many pairs has several rows
    ends = one.withColumn("key", F.explode(F.array("a", "b"))).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(64)))
    needed = written(ends.select("key").distinct(), "needed")
    texts = rows.select("key", "text").join(_small(needed), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    lists = ends.groupBy("key", "salt").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    met = lists.join(texts, "key").select("key", "text", F.explode("pairs").alias("p")).select("p.a", "p.b", "key", "text")
    by = met.repartition(parts, "a", "b").sortWithinPartitions("a", "b", F.col("key") != F.col("a"))
    return by.mapInArrow(tidy(compare), "a long, b long")


def _fewest(n: np.ndarray, least: float) -> np.ndarray:
    """Of a set of n, how many a set of that Jaccard similarity shares at least."""
    return np.maximum(1, np.ceil(least * n - 1e-9)).astype(np.int64)


def _depth(n: np.ndarray, least: float) -> np.ndarray:
    """How many of its first shingles a text of n shares with one of its size that is similar, among those looked at."""
    return np.minimum(_fewest(n, least), (SEEN * n).astype(np.int64) + 1)


def _packed(width: int, least: float, buckets: int):
    """The first shingles of each text, by hash: rows of a bucket of hashes. A row has 48 bits of each hash, whether it is
    of another text than the one before, and the texts' keys, sizes and components."""

    def pack(held: list[tuple[np.ndarray, int, int, int]]) -> pa.RecordBatch:
        h = np.concatenate([x[0] for x in held])
        text = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        key, n, component = (np.array([x[k] for x in held], t) for k, t in ((1, np.int64), (2, np.int32), (3, np.int64)))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, text, bucket = h[order] >> np.uint64(16), text[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])
        rows = []
        for a, b in zip(cuts, np.append(cuts[1:], len(h)), strict=True):
            own = text[a:b][new[a:b]]
            parts = (h[a:b].astype("<u4"), (h[a:b] >> np.uint64(32)).astype("<u2"), np.packbits(new[a:b]), key[own], n[own], np.where(component[own] == key[own], 0, component[own]))
            rows.append((int(bucket[a]), *(x.tobytes() for x in parts)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), *[pa.binary()] * 6], strict=True)], _PACKED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        seen: set[int] = set()
        for batch in batches:
            for key, component, text in zip(batch.column("key").to_pylist(), batch.column("component").to_pylist(), batch.column("text"), strict=True):
                if key in seen:  # a task passes on one of equal texts
                    continue
                seen.add(key)
                own = _shingles(text.as_py() or "", width)
                own = own if len(own) else np.zeros(1, np.uint64)  # texts without words are alike
                n = np.array(len(own))
                own = own[: int(n - _fewest(n, least) + _depth(n, least))]
                held.append((own, key, int(n), component))
                size += len(own)
                if size >= PACKED:
                    yield pack(held)
                    held, size = [], 0
            if len(seen) > PACKED:
                seen.clear()
        if held:
            yield pack(held)

    return run


_PACKED_NAMES = ["bucket", "low", "high", "new", "keys", "sizes", "components"]


def _mixed(least: float):
    """Of rows by bucket, the shingles that texts of several components have: key, h, how many have it, size of the text,
    and how many of the text's most frequent ones need not be looked at."""

    def find(bucket: int, rows: list[list[bytes]]) -> pa.RecordBatch:
        read = [[np.frombuffer(x, t) for x, t in zip(r, ("<u4", "<u2", np.uint8, np.int64, np.int32, np.int64), strict=True)] for r in rows]
        h = np.concatenate([r[0].astype(np.uint64) | r[1].astype(np.uint64) << np.uint64(32) for r in read])
        at, text = 0, []
        for r in read:
            text.append(at - 1 + np.cumsum(np.unpackbits(r[2], count=len(r[0])), dtype=np.int64))
            at += len(r[3])
        text = np.concatenate(text)
        keys, sizes, components = (np.concatenate([r[k] for r in read]) for k in (3, 4, 5))
        components = np.where(components == 0, keys, components)
        order = np.lexsort((keys[text], h))
        h, text = h[order], text[order]
        key = keys[text]
        one = np.ones(len(h), bool)  # a text that several tasks passed on is one
        one[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
        h, text, key = h[one], text[one], key[one]
        cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        have = np.diff(np.append(cuts, len(h)))
        component = components[text]
        many = np.repeat(np.minimum.reduceat(component, cuts) != np.maximum.reduceat(component, cuts), have)
        n = sizes[text][many]
        spared = _depth(_fewest(n, least), least) - 1
        name = (h[many] << np.uint64(15) | np.uint64(bucket & 0x7FFF)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(name), pa.array(np.repeat(have, have)[many]), pa.array(n), pa.array(spared)], ["key", "h", "have", "n", "spared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, last = [], None
        for batch in batches:
            for bucket, *row in zip(*(batch.column(c).to_pylist() for c in _PACKED_NAMES), strict=True):
                if rows and bucket != last:
                    yield find(last, rows)
                    rows = []
                last = bucket
                rows.append(row)
        if rows:
            yield find(last, rows)

    return run


def _sketched(width: int):
    """key and sketch: how many shingles of the text fall to each of SKETCH parts, up to 255. The sum of differences of two
    sketches is at most the number of shingles that only one of the two has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = []
            for text in batch.column("text"):
                counts = np.bincount((_shingles(text.as_py() or "", width) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                sketches.append(np.minimum(counts, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sketches, pa.binary())], ["key", "sketch"])

    return run


def _couples(least: float, nearest: bool):
    """Rows sorted by h, block and left (homes of the block first): pairs of a home and another of its h that are of
    different components and whose sizes allow that they are similar. For each home the one whose fingerprint is nearest, or
    all of them whose sketches allow it as well."""

    def compare(h: np.ndarray, block: np.ndarray, left: np.ndarray, key: np.ndarray, n: np.ndarray, component: np.ndarray, about: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(cuts, len(h)))
        first, wide = np.repeat(cuts, size), np.repeat(size, size)
        home = np.flatnonzero(left & (wide > 1))
        pairs = np.cumsum(wide[home])
        a = 0
        while a < len(home):
            b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + BLOCK // 8, "right")))
            w = wide[home[a:b]]
            i = np.repeat(home[a:b], w)
            j = np.repeat(first[home[a:b]], w) + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
            a = b
            hit = component[i] != component[j]
            if not nearest:
                hit &= key[i] < key[j]
            i, j = i[hit], j[hit]
            hit = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[hit], j[hit]
            if nearest:
                order = np.lexsort((np.bitwise_count(about[i] ^ about[j]), i))
                i, j = i[order], j[order]
                hit = np.append(True, i[1:] != i[:-1])[: len(i)]
            else:
                hit = np.zeros(len(i), bool)
                for k in range(0, len(i), STEP):
                    p, q = i[k : k + STEP], j[k : k + STEP]
                    x, y = about[p], about[q]
                    apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
                    hit[k : k + STEP] = apart * (1 + least) <= (1 - least) * (n[p].astype(np.int64) + n[q]) + 1e-6
            i, j = i[hit], j[hit]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[j])), pa.array(np.maximum(key[i], key[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "block", "left", "key", "n", "component")]
            about = batch.column("about")
            cols.append(about.to_numpy().view(np.uint64) if nearest else np.frombuffer(b"".join(about.to_pylist()), np.uint8).reshape(-1, SKETCH))
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if len(held[0]) >= GATHERED:
                before = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(before):
                    cut = int(before[-1]) + 1
                    yield from compare(*(c[:cut] for c in held))
                    held = [c[cut:] for c in held]
                if len(held[0]) >= GATHERED:  # one group: its homes stay, what came is compared and goes
                    yield from compare(*held)
                    held = [c[held[2]] for c in held]
        if held is not None and len(held[0]):
            yield from compare(*held)

    return run


def shared(rows: DataFrame, nodes: DataFrame, width: int, least: float) -> DataFrame:
    """h, key and n: shingles at which all pairs of rows (key, text; equal keys have equal texts) with a Jaccard similarity
    of `least` or more meet that are of different components in nodes (key, component; a key that is missing is its own), with
    n, how many shingles the text has.

    Prefix filtering, exact. Of two such texts each has at least ceil(least * n) of its n shingles in common with the
    other. So by any order that all texts share, they have d in common of their first n - ceil(least * n) + d. The first
    order is by hash; those first ones are dealt out, and what is of one component only is left out. The second is by how
    many texts have a shingle, rarest first: all but the last d - 1 are looked at."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = rows.select("key", "text").join(_small(nodes), "key", "left").select("key", F.coalesce("component", "key").alias("component"), "text")
    packed = known.mapInArrow(tidy(_packed(width, least, 2 * parts)), "bucket int, low binary, high binary, new binary, keys binary, sizes binary, components binary")
    met = packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_mixed(least)), "key long, h long, have long, n int, spared long")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("have"), "h"))
    return written(met.withColumn("rank", rank).where("rank > spared").select("h", "key", "n"), "rare")


def couples(rare: DataFrame, nodes: DataFrame, least: float, prints: DataFrame | None = None, rows: DataFrame | None = None, width: int = 0) -> DataFrame:
    """a, b: pairs of keys of `shared` that meet at a shingle, may be similar, and are of different components in nodes.

    With prints (key, fp) those with the nearest of each; else all, told by sketches of rows (key, text)."""
    parts = int(rare.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rare = rare.join(nodes, "key", "left").withColumn("component", F.coalesce("component", "key"))
    counts = rare.groupBy("h").agg(F.count("*").alias("n_h"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rare = written(rare.join(counts.select("h", F.ceil(F.col("n_h") / HOT).cast("int").alias("blocks")), "h"), "mixed")
    if rare.isEmpty():
        return rare.select(F.col("key").alias("a"), F.col("key").alias("b"))
    if prints is None:
        needed = written(rare.select("key").distinct(), "needed")
        texts = rows.select("key", "text").join(_small(needed), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
        about = texts.mapInArrow(tidy(_sketched(width)), "key long, sketch binary").withColumnRenamed("sketch", "about")
    else:
        about = prints.select("key", F.col("fp").alias("about")).distinct()
    each = rare.join(about, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("h", "block", (F.pmod(F.xxhash64("key"), F.col("blocks")) == F.col("block")).alias("left"), "key", "n", "component", "about")
    by = each.repartition(parts, "h", "block").sortWithinPartitions("h", "block", F.desc("left"))
    return by.mapInArrow(tidy(_couples(least, prints is not None)), "a long, b long").distinct()


def merged(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (key, component) with what more links, a written table (a, b), connect: components are made of those of known
    that a link meets, not of keys again."""
    if found.isEmpty():
        return known
    side = lambda c: known.select(F.col("key").alias(c), F.col("component").alias(f"of_{c}"))
    met = found.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    new = written(components(met).select("node", F.col("component").alias("whole")), "merged")
    old = known.join(new, known["component"] == new["node"], "left").select("key", F.coalesce("whole", "component").alias("component"))
    others = new.join(known.select(F.col("key").alias("node")), "node", "left_anti").select(F.col("node").alias("key"), F.col("whole").alias("component"))
    return written(old.unionByName(others), "nodes")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, most: int = 3) -> DataFrame:
    """docs without near copies: of each group that similar texts connect, the row with the smallest doc_id stays.

    A pair is linked if its sets of `width`-word shingles have that similarity or more. Fingerprints of the texts'
    different words tell which pairs to look at first: those within `most` bits, along a spanning forest with the closest
    first, and texts of one fingerprint with one of them. That links most copies. Then all pairs that are not connected yet
    and share enough shingles to be similar are looked at, whatever their fingerprints (`shared`), so no link that
    connects is missed: of each text first the one with the nearest fingerprint, for what that connects needs no other link,
    and then all that are left. A null doc_id stays only where there is no other. Of rows with equal doc_id and text, one
    stays.
    """

    plain, names = plain_names(docs)
    key = text_key(plain, names["text"])
    slim = plain.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"), key.alias("key"))
    prints = written(fingerprints(slim, 1, distinct=True, columns=("doc_id", "key")), "fingerprints")
    first = prints.groupBy("fp").agg(F.min("key").alias("first"))
    within = prints.select("key", "fp").distinct().join(first, "fp").where("key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))
    near = links(prints, most)
    across = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    linked = written(similar(within.unionByName(across), slim, width, similarity), "similar")
    known = written(components(linked).select(F.col("node").alias("key"), "component"), "nodes")
    rare = shared(slim, known, width, similarity)
    known = merged(known, written(similar(couples(rare, known, similarity, prints), slim, width, similarity), "similar"))
    known = merged(known, written(similar(couples(rare, known, similarity, None, slim, width), slim, width, similarity), "similar"))
    least = prints.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("doc"))
    labelled = least.join(known, "key", "left").withColumn("component", F.coalesce("component", "key"))
    kept = labelled.groupBy("component").agg(F.min(F.struct("doc", "key")).alias("one")).select(F.col("one.doc.doc_id").alias("_doc"), F.col("one.key").alias("_key"))
    rows = plain.select(F.struct(*plain.columns).alias("row"), F.col(names["doc_id"]).alias("_doc"), key.alias("_key"))
    match = (rows["_key"] == kept["_key"]) & rows["_doc"].eqNullSafe(kept["_doc"])
    one = rows.join(kept, match, "left_semi").groupBy("_doc", "_key").agg(F.first("row").alias("row"))
    return one.select("row.*").toDF(*docs.columns)
