"""Language ID: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's subwords are its byte 3-grams and 4-grams with A-Z lower-cased, hashed to BUCKETS embeddings of SIZE
numbers. Their average goes through a linear layer to a softmax over the languages. Embeddings and layer are trained
by stochastic gradient descent in numpy on a bounded, documented sample of rows, PER_LANGUAGE of each of at most
MOST_LANGUAGES languages in expectation, chosen by a hash of text and language; equal rows count once. Since averaging is linear, scoring needs only the product of embeddings and
layer: one row of a small table for each subword of the whole text.

Calibration: on a fifth of the sample that training does not see, a temperature is fitted to the log-likelihood, and
the score below which an answer is rejected is set so that the accepted answers there are right in at least
ACCEPT of the cases. `lang_pred` names the likeliest language either way; `accepted` tells whether it is above.

Nulls: a null text or one without a letter is `und`, score 0, not accepted. Rows with null lang or doc_id are not
learned from. With nothing to learn from every text is `und`. Ties go to the first language in alphabetical order.
Very long texts are scored whole. Repeated rows give a row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, hash_bound, slices, tidy

BUCKETS, SIZE = 1 << 14, 16
#: Rows of each language to fit on, in expectation, and most languages, those with most rows.
PER_LANGUAGE, MOST_LANGUAGES = 600, 500
#: Share of right answers among the accepted ones.
ACCEPT = 0.99
EPOCHS, RATE = 4, 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _subwords(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 3-grams and 4-grams: the bucket at each byte position, and first and last + 1 position of each text."""
    d = _LOWER[data].astype(np.uint32)
    for n, salt in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        if len(d) < n:
            yield np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1, np.int64)
            continue
        h = sum(d[k : len(d) - n + 1 + k] << np.uint32(8 * k) for k in range(n)) + np.uint32(n)
        first = np.minimum(at[:-1], len(h))
        yield (h * np.uint32(salt) >> np.uint32(18)).astype(np.int64), first, np.maximum(first, np.minimum(at[1:] - n + 1, len(h)))


def _has_letter(batch: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LETTER[data], out=seen[1:])
    out = seen[at[1:]] > seen[at[:-1]]
    for k in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[k] = any(c.isalpha() for c in batch[int(k)].as_py() or "")
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket by language: embeddings times layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1)
        for bucket, first, last in _subwords(data, at):
            for k in range(len(self.languages)):
                sums = np.zeros(len(bucket) + 1)
                np.cumsum(self.table[bucket, k], out=sums[1:])
                total[:, k] += sums[last] - sums[first]
            n += last - first
        return softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: those whose crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in slices(batch.column("text")):
            grams, ids, values = list(_subwords(data, at)), [], []
            for k in range(j - i):
                own, n = np.unique(np.concatenate([b[f[k] : e[k]] for b, f, e in grams]), return_counts=True)
                ids.append(own)
                values.append((n / max(1, n.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("key")[i:j], batch.column("lang")[i:j], batch.column("part")[i:j].cast(pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["key", "lang", "part", "ids", "values"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from about `per_language` rows (doc_id, text, lang) of each language; None if there are none.

    The languages are counted first; the sample is then a filter on a hash.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").select("text", "lang", F.xxhash64("text", "lang").alias("key"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    taken = F.lit(False)
    for r in counts:
        bound = hash_bound(per_language, r["n"])
        taken = F.when(F.col("lang") == r["lang"], F.lit(True) if bound is None else F.col("key") < bound).otherwise(taken)
    # rows that are equal are one, however many they are
    chosen = usable.where(taken).groupBy("key", "lang").agg(F.first("text").alias("text")).withColumn("part", F.pmod(F.hash("key"), F.lit(5)))
    got = chosen.mapInArrow(tidy(_vectors), "key long, lang string, part int, ids array<int>, values array<float>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return None
    place = {lang: k for k, lang in enumerate(languages)}
    y = np.array([place[x] for x in got.column("lang").to_pylist()])
    train = got.column("part").to_numpy() != 0
    train = train if train.any() else ~train
    lists = [got.column(c).combine_chunks() for c in ("ids", "values")]
    stops = lists[0].offsets.to_numpy()
    ids, values = (x.values.to_numpy(zero_copy_only=False) for x in lists)
    rows = [(ids[a:b].astype(np.int64), values[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
    embed, layer, bias = _descend([r for r, t in zip(rows, train, strict=True) if t], y[train], len(languages))
    model = Model(languages, (embed @ layer).astype(np.float32), bias)
    rest = np.flatnonzero(~train)
    if len(rest):
        _calibrate(model, [rows[k] for k in rest], y[rest])
    del got, lists, ids, values, rows
    give_back()
    return model


def _descend(rows: list, y: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
    layer = rng.normal(0, 0.1, (SIZE, kinds)).astype(np.float32)
    bias = np.zeros(kinds, np.float32)
    order, step, steps = np.arange(len(rows)), 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for k in order:
            ids, values = rows[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = values @ embed[ids]
            z = hidden @ layer + bias
            slope = np.exp(z - z.max())
            slope /= slope.sum()
            slope[y[k]] -= 1
            back = layer @ slope
            layer -= rate * np.outer(hidden, slope)
            bias -= 0.1 * rate * slope
            embed[ids] -= (rate * len(ids) ** 0.5) * values[:, None] * back
    return embed, layer, bias


def _calibrate(model: Model, rows: list, y: np.ndarray) -> None:
    z = np.stack([values @ model.table[ids] + model.bias if len(ids) else model.bias for ids, values in rows])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right, score = p.argmax(axis=1) == y, p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(share >= ACCEPT)
    model.reject_below = float(score[order[good[-1]]]) if len(good) else 1.0


def _predicted(model: Model | None, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column("text")):
                text = batch.column("text")[i:j]
                known = _has_letter(text, data, at) if model else np.zeros(j - i, bool)
                p = model.probabilities(data, at) if model else np.zeros((j - i, 1))
                best = p.argmax(axis=1)
                score = np.where(known, p.max(axis=1), 0.0)
                named = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                taken = known & (score >= (model.reject_below if model else 1))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in names), pa.array(named, pa.string()), pa.array(score), pa.array(taken)], [*names, "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, which has `text`, with lang_pred, score (its probability) and accepted."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    needed = docs.select(*dict.fromkeys([*columns, "text"]))
    return needed.mapInArrow(tidy(_predicted(model, list(columns))), f"{kept}, lang_pred string, score double, accepted boolean")
