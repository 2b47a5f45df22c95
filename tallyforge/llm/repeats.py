"""Suffix-array dedup: every byte covered by a string of LEAST bytes that also starts anywhere else is removed.

A suffix array over all texts would be one task's work, so suffixes are first brought together by content, and one
suffix array is built over each bounded set of them, by linear grouping (suffix_order.py):

1. Anchors. In every LEAST-byte window the 8-byte string of smallest hash among the first WIDE positions is its
   anchor. Equal windows have the same anchor at the same offset, so the windows of an anchor, which start side by
   side, can only equal windows of an anchor that is followed by the same LEAST - WIDE bytes: its key.
2. Anchors are shuffled and sorted by key and by the hash of all bytes their windows cover, and read as a stream. An
   anchor alone with its key is dropped. Two with all bytes equal repeat each other in all windows. Before the shuffle a
   task passes on two of equal texts and two of equal anchors; of the other anchors it is known already that they repeat, and
   they are dealt out by their place. So neither a text nor a passage of a third of all rows meets in one task. What is left are
   edges: the same key, other bytes around it. Copies of a passage, however many, end here.
3. For edges, and one of each class of equal anchors beside them, the bytes around the key are fetched from the texts
   and shuffled by key. The suffixes are ordered over symbols: the bytes before the key, one symbol for the key, and
   the bytes after it, eight to a symbol (their ranks keep the order of bytes). Windows that repeat are neighbours
   in this order, and neighbours are compared byte by byte.
4. A key with more than MOST_EDGES different surroundings is not held in one task: each window of its anchors becomes a
   row, and the rows are shuffled and sorted by the window's hash, which splits the group as finely as it has
   different windows.
5. The spans come together by text; each text is cut once. Rows of a text that very many rows have are dealt to all
   partitions.

A text goes by a 64-bit number that no other text has (`text_key`). Anchors are one class if two hashes agree that have
nothing to do with each other: one of the key, modulo 2^64, and one of all bytes that their windows cover, modulo two primes.

Nulls: a null text counts as empty. Texts of fewer than LEAST bytes stay. Repeated rows repeat each other, and so go if
long enough. A very long text is worked through in steps. Ties don't arise: all places of a repeated string go. Empty
table: no rows. Columns that are not asked for are ignored, and those asked for may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrimeWindows, Windows, long, mix, slices, text_key, tidy
from .suffix_order import suffix_order

#: Bytes of a repeated string, and positions among which its anchor is chosen.
LEAST, WIDE = 200, 64
#: Anchors among which a task looks for equal ones, about.
GATHERED = 1 << 18
#: Texts that a task remembers to have seen; beyond it, it forgets them all and goes on.
REMEMBERED = 1 << 20
#: Bytes of a long text that are worked on at once.
STEP = 1 << 19
#: Rows of one text from which they are dealt to all partitions, and how many such texts there may be.
HOT, MOST_HOT = 1000, 2000
#: Surroundings that are ordered together, about, and most of one key.
TOGETHER, MOST_EDGES = 2048, 4096

_COVERED, _EDGE, _WITNESS = 0, 1, 2


def _anchors_of(data: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of texts end to end: text, first window, windows, anchor (both from the text's start), hash of the key and hash
    of all bytes of each anchor."""
    n = len(data) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,))
    low = (mix(eight[: n + WIDE - 1].astype(np.uint64)) & ~np.uint64(0xFFFFFFF)) | np.arange(n + WIDE - 1, dtype=np.uint64)
    span = 1
    while span < WIDE:  # minima of ever wider windows; of equal ones the first
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    anchor = (low & np.uint64(0xFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(n) + least <= at[1:][text]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    windows = np.diff(np.append(sums[first], sums[-1]))
    anchor = anchor[first]
    hashed = Windows(data)
    text, begin = text[first], at[text[first]]
    return text, first - begin, windows, anchor - begin, mix(hashed(anchor, anchor + least - WIDE)), mix(PrimeWindows(data)(first, first + windows - 1 + least))


def _anchors(least: int):
    def rows(parts: list[tuple]) -> pa.RecordBatch:
        doc, first, windows, anchor, key, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = first << 16 | (anchor - first) << 8 | windows
        # of equal anchors two tell all that more would: the others are known to repeat, and are dealt out by place
        both = mix(key) ^ whole
        order = np.argsort(both, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = both[order][1:] != both[order][:-1]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        known = np.zeros(len(order), bool)
        known[order] = nth >= 2
        key = np.where(known, mix(doc.view(np.uint64) ^ mix(at.view(np.uint64))), key)
        return pa.RecordBatch.from_arrays([long(key), long(whole), pa.array(doc), pa.array(at), pa.array(known)], ["key", "whole", "doc", "at", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            # two copies of a text tell all that more would: a task passes on no third one
            docs, take = batch.column("doc").to_numpy(), []
            for doc in docs.tolist():
                seen[doc] = seen.get(doc, 0) + 1
                take.append(seen[doc] <= 2)
            if len(seen) > REMEMBERED:
                seen.clear()
            batch = batch.filter(pa.array(take, pa.bool_()))
            docs = batch.column("doc").to_numpy()
            parts: list[tuple] = []
            waiting = 0
            for i, _, data, at in slices(batch.column("text"), STEP):
                if len(at) > 2 or len(data) <= STEP:
                    text, *rest = _anchors_of(data, at, least)
                    parts.append((docs[i + text], *rest))
                    waiting += len(text)
                for a in range(0, len(data), STEP) if len(at) == 2 and len(data) > STEP else ():  # one long text
                    part = data[a : a + STEP + least - 1]
                    text, first, windows, anchor, *rest = _anchors_of(part, np.array([0, len(part)]), least)
                    parts.append((docs[i + text], first + a, windows, anchor + a, *rest))
                    waiting += len(text)
                if waiting > GATHERED:
                    yield rows(parts)
                    parts, waiting = [], 0
            if parts:
                yield rows(parts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors sorted by key, whole, doc and at: those that repeat, or may, with their kind.

    One row is held back, to know what follows it; of the row before, the class is known and whether its key had
    another class before.
    """
    held: list[np.ndarray] | None = None
    before: tuple[int, int, int, int] | None = None
    had = False

    def judge(cols: list[np.ndarray], after: tuple[int, int] | None) -> pa.RecordBatch:
        nonlocal before, had
        key, whole, doc, at = cols
        n = len(key)
        same_key, same_whole, same_row = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n, bool)
        same_key[1:n] = key[1:] == key[:-1]
        same_whole[1:n] = same_key[1:n] & (whole[1:] == whole[:-1])
        same_row[1:] = same_whole[1:n] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
        if before is not None:
            same_key[0] = key[0] == before[0]
            same_whole[0] = same_key[0] and whole[0] == before[1]
            same_row[0] = same_whole[0] and (doc[0], at[0]) == before[2:]
        if after is not None:
            same_key[n] = key[-1] == after[0]
            same_whole[n] = same_key[n] and whole[-1] == after[1]
        start = np.maximum.accumulate(np.where(same_whole[:-1], -1, np.arange(n)))
        other = np.where(start < 0, had, same_key[:-1][np.maximum(start, 0)])
        covered = same_whole[:-1] | same_whole[1:]
        edge = ~covered & (same_key[:-1] | same_key[1:])
        witness = covered & ~same_whole[1:] & (same_key[1:] | other)
        before, had = (key[-1], whole[-1], doc[-1], at[-1]), bool(other[-1])
        take = edge | witness | (covered & ~same_row)
        kind = np.where(edge, _EDGE, np.where(witness, _WITNESS, _COVERED))[take].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(at[take]), pa.array(np.where(kind > 0, key[take], 0)), pa.array(kind)], ["doc", "at", "key", "kind"])

    for batch in batches:
        known = batch.column("known")
        if known.true_count:
            own = batch.filter(known)
            yield pa.RecordBatch.from_arrays([own.column("doc"), own.column("at"), pa.array(np.zeros(own.num_rows, np.int64)), pa.array(np.full(own.num_rows, _COVERED, np.int32))], ["doc", "at", "key", "kind"])
            batch = batch.filter(pc.invert(known))
        cols = [batch.column(c).to_numpy() for c in ("key", "whole", "doc", "at")]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(cols[0]) > 1:
            yield judge([c[:-1] for c in cols], (cols[0][-1], cols[1][-1]))
        held = [c[-1:] for c in cols] if len(cols[0]) else held
    if held is not None:
        yield judge(held, None)


def _surroundings(least: int):
    """Texts with their edges and witnesses: WIDE bytes before each key and WIDE after it, zeros where no window is.

    Copies of a text follow each other, and only witnesses stand in them; the first copy in a task tells all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("doc")[row].as_py() == last:
                    continue
                last = batch.column("doc")[row].as_py()
                text = batch.column("text")[row].as_py().encode()
                wanted = batch.column("wanted")[row].as_py()
                sides = []
                for x in wanted:
                    first, off, windows = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                    after = first + off + least - WIDE
                    sides.append(text[first : first + off].rjust(WIDE, b"\0") + text[after : first + windows - 1 + least].ljust(WIDE, b"\0"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["key"] for x in wanted]), pa.array([last] * len(wanted)), pa.array([x["at"] for x in wanted]), pa.array([x["kind"] for x in wanted], pa.int32()), pa.array(sides, pa.binary())],
                    ["key", "doc", "at", "kind", "sides"],
                )

    return run


def _windows_of(sides: np.ndarray) -> np.ndarray:
    """Eight columns of eight bytes: of the window of k bytes before the key in row r, at index 2 * WIDE * r + WIDE - k."""
    flat = np.concatenate([np.ascontiguousarray(sides).ravel(), np.zeros(WIDE, np.uint8)])
    eight = np.ndarray((len(flat) - 7,), "<u8", flat, 0, (1,))
    return np.lib.stride_tricks.as_strided(eight, (len(flat) - WIDE + 1, WIDE // 8), (1, 8))


def repeated_windows(key: np.ndarray, at: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of bytes before the key of each window that another row, of the same key, has as well.

    sides: rows of 2 * WIDE bytes. A suffix array over all rows' symbols, by linear grouping, brings equal windows
    together; they are equal if key, bytes before it and bytes after it are.
    """
    n = len(key)
    off, fewest = at >> 8 & 255, (at >> 8 & 255) - (at & 255) + 1
    after = np.ascontiguousarray(sides[:, WIDE:]).view(">u8").astype(np.uint64)
    values, rank = np.unique(after, return_inverse=True)
    _, group = np.unique(key, return_inverse=True)
    symbols = np.full((n, WIDE + 1 + WIDE // 8 + 1), 1, np.int64)  # 1 ends a row
    symbols[:, :WIDE] = sides[:, :WIDE].astype(np.int64) + 2
    symbols[:, WIDE] = group + 258 + len(values)
    symbols[:, WIDE + 1 : -1] = rank.reshape(after.shape) + 258
    column = np.arange(symbols.shape[1])
    used = (column >= WIDE - off[:, None]) & ((column <= WIDE + (WIDE - fewest[:, None] + 7) // 8) | (column == symbols.shape[1] - 1))
    row, col = np.nonzero(used)
    order = suffix_order(np.append(symbols[used], 0))[1:]
    row, before = row[order], WIDE - col[order]
    asked = (before >= fewest[row]) & (before >= 0)
    row, before = row[asked], before[asked]
    window = _windows_of(sides)[2 * WIDE * row + WIDE - before]
    same = np.zeros(len(row) + 1, bool)
    same[1:-1] = (group[row][1:] == group[row][:-1]) & (before[1:] == before[:-1]) & (window[1:] == window[:-1]).all(axis=1)
    hit = same[1:] | same[:-1]
    return row[hit], before[hit]


_SPANS = "first long, second long, doc long, start long, stop long, open boolean"
_SPAN_NAMES = ["first", "second", "doc", "start", "stop", "open"]


def _ordered(least: int):
    """Surroundings sorted by key, in bounded sets of whole keys: spans that repeat, or open windows of a hot key."""

    def spans(key, doc, at, kind, sides) -> pa.RecordBatch:
        row, before = repeated_windows(key, at, sides)
        own = kind[row] == _EDGE
        row, before = row[own], before[own]
        start = (at[row] >> 16) + (at[row] >> 8 & 255) - before
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
        stop = start[np.append(head[1:], len(row)) - 1] + least if len(row) else start
        docs, start = doc[row[head]], start[head]
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start), pa.array(docs), pa.array(start), pa.array(stop), pa.array(np.zeros(len(docs), bool))], _SPAN_NAMES)

    def opened(key, doc, at, kind, sides) -> pa.RecordBatch:
        windows = at & 255
        row = np.repeat(np.arange(len(key)), windows)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        before = (at[row] >> 8 & 255) - nth
        window = _windows_of(sides)[2 * WIDE * row + WIDE - before]
        first, second = key.view(np.uint64)[row] + before.astype(np.uint64), mix(before.astype(np.uint64))
        for k in range(WIDE // 8):
            first, second = mix(first ^ window[:, k]), mix(second + np.uint64(0x9E3779B97F4A7C15) * window[:, k])
        start = (at[row] >> 16) + nth
        return pa.RecordBatch.from_arrays([long(first), long(second), pa.array(doc[row]), pa.array(start), pa.array(start + least), pa.array(np.ones(len(row), bool))], _SPAN_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "doc", "at", "kind")]
            cols.append(np.frombuffer(b"".join(batch.column("sides").to_pylist()), np.uint8).reshape(-1, 2 * WIDE))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if hot is not None:
                n = int(np.searchsorted(cols[0] != hot, True))
                if n:
                    yield opened(*(c[:n] for c in cols))
                    cols = [c[n:] for c in cols]
                if len(cols[0]):
                    hot = None
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            a = 0
            while len(cuts) and a < cuts[-1]:  # whole keys, about TOGETHER rows at once
                b = int(cuts[min(len(cuts) - 1, np.searchsorted(cuts, a + TOGETHER))])
                part = [c[a:b] for c in cols]
                sizes = np.diff(np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1], [True]])))
                large = np.repeat(sizes > MOST_EDGES, sizes)
                if large.any():
                    yield opened(*(c[large] for c in part))
                if not large.all():
                    yield spans(*(c[~large] for c in part))
                a = b
            held = [c[a:] for c in cols]
            if len(held[0]) > MOST_EDGES:
                hot = held[0][0]
                yield opened(*held)
                held = None
        if held is not None and len(held[0]):
            yield spans(*held)

    return run


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they are; of open windows, sorted by their hash, those with an equal one beside them."""
    held: pa.RecordBatch | None = None
    before = None

    def judge(batch: pa.RecordBatch, after) -> pa.RecordBatch:
        nonlocal before
        first, second, opened = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "open"))
        same = np.zeros(len(first) + 1, bool)
        same[1:-1] = (first[1:] == first[:-1]) & (second[1:] == second[:-1]) & opened[1:] & opened[:-1]
        if before is not None:
            same[0] = before == (first[0], second[0], opened[0])
        if after is not None:
            same[-1] = after == (first[-1], second[-1], opened[-1])
        before = (first[-1], second[-1], opened[-1])
        take = pa.array(~opened | same[1:] | same[:-1])
        return batch.filter(take).select(["doc", "start", "stop"])

    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows - 1
        if n > 0:
            yield judge(batch.slice(0, n), tuple(batch.column(c)[n].as_py() for c in ("first", "second", "open")))
        held = batch.slice(n, 1) if n >= 0 else None
    if held is not None:
        yield judge(held, None)


def _cut(least: int, names: list[str], whole_characters: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for row in range(batch.num_rows):
                text = (batch.column("text")[row].as_py() or "").encode()
                at = np.array(batch.column("covered")[row].as_py() or [], np.int64)
                more = np.array(batch.column("more")[row].as_py() or [], np.int64).reshape(-1, 2)
                start = np.concatenate([at >> 16, more[:, 0]])
                stop = np.concatenate([(at >> 16) + (at & 255) - 1 + least, more[:, 1]])
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
                head = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(start) else np.zeros(0, np.int64)
                spans = list(zip(start[head].tolist(), stop[np.append(head[1:], len(start)) - 1].tolist(), strict=True)) if len(start) else []
                if whole_characters:  # a span gives back the bytes of characters that are not all in it
                    inner = lambda k: k < len(text) and text[k] & 0xC0 == 0x80
                    for s, (a, b) in enumerate(spans):
                        while inner(a):
                            a += 1
                        while inner(b):
                            b -= 1
                        spans[s] = (a, b)
                pieces, last = [], 0
                for a, b in spans:
                    pieces.append(text[last:a])
                    last = b
                pieces.append(text[last:])
                size.append(len(text))
                removed.append(sum(b - a for a, b in spans))
                runs.append(len(spans))
                kept.append(b"".join(pieces))
            numbers = [pa.array(x, pa.int64()) for x in (size, removed, runs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *numbers, pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _hot_texts(texts: DataFrame) -> list[int]:
    """Hashes of texts that at least HOT rows and one of MOST_HOT rows have: at most MOST_HOT of them."""
    counts = texts.groupBy("doc").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(HOT, -(-total // MOST_HOT))
    return [r["doc"] for r in counts.where(F.col("n") >= least).select("doc").collect()]


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), least: int = LEAST, whole_characters: bool = False) -> DataFrame:
    """The named columns of docs, which has `text`, with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the
    remaining bytes). With whole_characters, no character is cut in two: what remains is valid UTF-8.

    But for the count of copies it is one lazy plan. Texts are shuffled once, by their hash; Spark reuses that exchange for
    both joins.
    """
    if least < WIDE + 8:
        raise ValueError(f"least must be {WIDE + 8} at least")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_{k}" for k in range(len(columns))]
    texts = docs.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("doc", text_key(texts))
    hot = _hot_texts(texts)
    salted = F.col("doc").isin(hot) if hot else F.lit(False)
    anchors = texts.select("doc", "text").mapInArrow(tidy(_anchors(least)), "key long, whole long, doc long, at long, known boolean")
    sorted_anchors = anchors.repartition(parts, "key").sortWithinPartitions("key", "whole", "doc", "at")
    marked = sorted_anchors.mapInArrow(tidy(_repeated), "doc long, at long, key long, kind int")
    lists = marked.repartition(parts, "doc").groupBy("doc").agg(F.collect_list(F.struct("at", "key", "kind")).alias("all"))
    lists = lists.select("doc", F.expr("transform(filter(all, x -> x.kind != 1), x -> x.at)").alias("covered"), F.expr("filter(all, x -> x.kind > 0)").alias("wanted"))
    # rows of a text that very many rows have are dealt to all partitions, and its spans to each of these
    # (never null: a filter against nulls in one join only would keep Spark from sharing the exchange)
    salt = F.coalesce(F.when(salted, F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int")), F.lit(0))
    dealt = texts.withColumn("salt", salt)
    # both joins take all columns of the dealt texts, so that Spark deals them once and reuses the exchange
    salts = F.when(salted, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    edges = dealt.join(lists.where("size(wanted) > 0").select("doc", "wanted", F.explode(salts).alias("salt")), ["doc", "salt"])
    around = edges.mapInArrow(tidy(_surroundings(least)), "key long, doc long, at long, kind int, sides binary")
    spans = around.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_ordered(least)), _SPANS)
    closed = spans.repartition(parts, "first", "second").sortWithinPartitions("first", "second", "open").mapInArrow(tidy(_closed), "doc long, start long, stop long")
    more = closed.groupBy("doc").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("more"))
    found = lists.select("doc", "covered").join(more, "doc", "left").select("doc", "covered", "more", F.explode(salts).alias("salt"))
    whole = dealt.join(found, ["doc", "salt"], "left")
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(columns, names, strict=True))
    cut = whole.select(*names, "text", "covered", "more").mapInArrow(tidy(_cut(least, names, whole_characters)), f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(*(F.col(n).alias(c) for c, n in zip(columns, names, strict=True)), "n_bytes", "n_removed", "n_spans", "kept")
