"""Quality rules: a logistic regression over hashed word and character n-grams, with a calibrated threshold.

Base rules are counted for every whole text. What passes them is judged by a model: word 1-grams, word 2-grams and
4-byte character n-grams are hashed to BUCKETS weights each, a text's features are their relative frequencies, and
logistic regression gives a margin. Platt scaling on labelled rows that training did not see turns margins into
probabilities, which are held against a fixed threshold.

The model is fitted on a bounded sample of the labelled rows: TRAIN_ROWS in expectation, chosen by a hash of
doc_id, whole texts. Each row of the sample comes to the driver as a sparse vector of at most 3 * BUCKETS numbers.
Scoring is over all documents, whole texts, in Arrow batches.

Nulls: a null text has no words and fails the base rules; labels with null quality or doc_id are not used; of
several labels of a doc_id the lowest counts, and of several texts of one the model learns from one. With no labels, or of one kind only, the model keeps what the base
rules keep (probability 1). Empty texts fail the base rules. Very long texts are counted whole. Repeated rows give a
row each. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Windows, give_back, hash_bound, mix, per_text, slices, tidy, words

#: Weights for each kind of n-gram.
BUCKETS = 1 << 14
#: Labelled rows to fit on, in expectation.
TRAIN_ROWS = 2000
#: Probability of good quality from which a text is kept.
KEEP = 0.4
#: Base rules: fewest words, and largest share of words in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_KINDS = 3
#: Character n-grams that are hashed at once.
STEP = 1 << 20


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


class _Texts:
    """Words and hashes of some texts that lie end to end."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at, self.n = data, at, len(at) - 1
        self.hash = Windows(data)
        self.start, self.end, self.text = words(data, at)
        self.word = mix(self.hash(self.start, self.end) ^ (self.end - self.start).astype(np.uint64))
        self.n_words = np.bincount(self.text, minlength=self.n)

    def base(self) -> dict[str, np.ndarray]:
        solid = ~SPACE[self.data]
        chars = per_text(solid & ((self.data & 0xC0) != 0x80), self.at)
        out = {"n_words": self.n_words, "word_chars": chars, "n_symbols": per_text(_SYMBOL[self.data], self.at)}
        return out | {"n_dup_lines": self._dup_lines(solid), "n_repeat_words": self._repeat_words()}

    def _dup_lines(self, solid: np.ndarray) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 0x0A)
        first = np.union1d(breaks + 1, self.at[:-1])
        first = first[first < len(self.data)]
        last = np.append(first[1:], len(self.data))
        last = last - (self.data[last - 1] == 0x0A) if len(last) else last
        seen = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(solid, out=seen[1:])
        full = seen[last] > seen[first]
        first, last = first[full], last[full]
        text = np.searchsorted(self.at, first, "right") - 1
        line = mix(self.hash(first, last) ^ mix((last - first).astype(np.uint64)) ^ mix(text.astype(np.uint64) + np.uint64(1)))
        _, one = np.unique(line, return_index=True)
        return np.bincount(text, minlength=self.n) - np.bincount(text[one], minlength=self.n)

    def _repeat_words(self) -> np.ndarray:
        w, t = self.word, self.text
        if len(w) < 3:
            return np.zeros(self.n, np.int64)
        one = mix(w[:-2] + np.uint64(3) * mix(w[1:-1] + np.uint64(5) * mix(w[2:] ^ mix(t[2:].astype(np.uint64)))))
        at = np.flatnonzero(t[:-2] == t[2:])
        at = at[_repeats(one[at])]
        hit = np.zeros(len(w), bool)
        for k in range(3):
            hit[at + k] = True
        return np.bincount(t[hit], minlength=self.n)

    def grams(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, and bucket and text of each n-gram of the kind; character n-grams come in steps."""
        w, t = self.word, self.text
        inner = t[:-1] == t[1:]
        bucket = lambda h: (h >> np.uint64(50)).astype(np.int64)  # noqa: E731  14 bits
        yield 0, bucket(w), t
        yield 1, bucket(mix(w[:-1] + np.uint64(7) * w[1:])[inner]) + BUCKETS, t[:-1][inner]
        for a in range(0, max(0, len(self.data) - 3), STEP):
            d = self.data[a : a + STEP + 3].astype(np.uint32)
            four = d[:-3] | d[1:-2] << np.uint32(8) | d[2:-1] << np.uint32(16) | d[3:] << np.uint32(24)
            place = np.arange(a, a + len(four))
            text = np.searchsorted(self.at, place, "right") - 1
            whole = place + 4 <= self.at[text + 1]
            yield 2, (four * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)[whole] + 2 * BUCKETS, text[whole]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: _Texts) -> np.ndarray:
        total, n = np.zeros((_KINDS, texts.n)), np.zeros((_KINDS, texts.n))
        for kind, bucket, text in texts.grams():
            n[kind] += np.bincount(text, minlength=texts.n)
            total[kind] += np.bincount(text, self.weights[bucket], minlength=texts.n)
        return self.bias + (total / np.maximum(n, 1)).sum(axis=0)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: its features' buckets and relative frequencies."""
    for batch in batches:
        for i, j, data, at in slices(batch.column("text")):
            texts = _Texts(data, at)
            keys, n = [], np.zeros((_KINDS, texts.n))
            for kind, bucket, text in texts.grams():
                keys.append(text * (_KINDS * BUCKETS) + bucket)
                n[kind] += np.bincount(text, minlength=texts.n)
            key, count = np.unique(np.concatenate(keys), return_counts=True)
            own, cut = np.divmod(key, _KINDS * BUCKETS)
            share = (count / n[cut // BUCKETS, own]).astype(np.float32)
            stops = np.searchsorted(own, np.arange(texts.n + 1))
            ids, counts = ([x[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)] for x in (cut, share))
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality")[i:j].cast(pa.int32()), batch.column("part")[i:j].cast(pa.int32()), pa.array(list(ids), pa.list_(pa.int32())), pa.array(list(counts), pa.list_(pa.float32()))],
                ["quality", "part", "ids", "values"],
            )


def _descend(y: np.ndarray, ids: np.ndarray, values: np.ndarray, row: np.ndarray, size: int, steps: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam over all rows; both classes weigh the same, weights decay a little."""
    weigh = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        margin = np.bincount(row, w[ids] * values, minlength=len(y)) + b
        slope = weigh * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grad = np.append(np.bincount(ids, slope[row] * values, minlength=size) + 1e-6 * w, slope.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with targets pulled in a little."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-6, float(np.std(margin)))
    x = np.stack([margin / scale, np.ones(len(margin))])
    p = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(p @ x, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))) @ x.T + 1e-4 * np.eye(2), x @ (q - target) + 1e-4 * p)
        p = p - step
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0] / scale), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model from about `rows` labelled rows, three quarters to train on and one to calibrate with.

    None if there are not both kinds of label.
    """
    try:
        return _fitted(_sample(docs, labels, rows))
    finally:
        give_back()


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> pa.Table:
    """quality, part, ids and values of the sampled rows."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    bound = hash_bound(rows, one.count())
    chosen = (one if bound is None else one.where(F.xxhash64("doc_id") < bound)).withColumn("part", F.pmod(F.hash("doc_id"), F.lit(4)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about `rows` ids
    texts = texts.groupBy("doc_id", "quality", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id may have very many rows
    return texts.select("text", "quality", "part").mapInArrow(tidy(_vectors), "quality int, part int, ids array<int>, values array<float>").toArrow()


def _fitted(got: pa.Table) -> Model | None:
    if got.num_rows == 0:
        return None
    y, part = got.column("quality").to_numpy(), got.column("part").to_numpy()
    flat = [got.column(c).combine_chunks() for c in ("ids", "values")]
    sizes = np.diff(flat[0].offsets.to_numpy())
    ids, values = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
    row = np.repeat(np.arange(len(y)), sizes)
    y = (y > 0).astype(np.int64)
    train = part != 0
    if len(np.unique(y[train])) < 2:
        return None
    number = np.cumsum(train) - 1
    own = train[row]
    w, b = _descend(y[train], ids[own], values[own], number[row[own]], _KINDS * BUCKETS)
    model = Model(w, float(b))
    margin = np.bincount(row, w[ids] * values, minlength=len(y)) + b
    if len(np.unique(y[~train])) == 2:
        model.slope, model.shift = _platt(margin[~train], y[~train])
    return model


_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(model: Model | None, keep: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column("text")):
                texts = _Texts(data, at)
                base = texts.base()
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                good = np.ones(texts.n) if model is None else model.probabilities(model.margins(texts))
                own = [batch.column(c)[i:j] for c in names]
                more = [pa.array(base[f].astype(np.int64)) for f in _FIELDS]
                yield pa.RecordBatch.from_arrays([*own, *more, pa.array(failed), pa.array(good), pa.array(~failed & (good >= keep))], [*names, *_FIELDS, "base_failed", "p_good", "kept"])

    return run


def score(docs: DataFrame, model: Model | None, keep: float = KEEP, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of docs, which has `text`, with the base counts, base_failed, p_good and kept."""
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    counts = ", ".join(f"{f} long" for f in _FIELDS)
    needed = docs.select(*dict.fromkeys([*columns, "text"]))
    return needed.mapInArrow(tidy(_scored(model, keep, list(columns))), f"{kept}, {counts}, base_failed boolean, p_good double, kept boolean")


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and base_failed, without a model."""
    return score(docs, None).select("doc_id", *_FIELDS, "base_failed")


#: The base rules in DuckDB's SQL, for tables without repeated doc_ids.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS i, array_to_string(w[i:i + 2], ' ') AS three FROM n),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS found FROM t),
p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM r WHERE found > 1) GROUP BY doc_id),
c AS (SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM n LEFT JOIN p USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
