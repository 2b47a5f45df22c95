"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are the maximal runs of letters and digits, lower-cased. A benchmark item of WINDOW words or more leaks into a
document where WINDOW consecutive words of it stand with at most SUBSTITUTED of them replaced by others. A shorter item of
at least LEAST words leaks where all its words stand. Items of fewer words never leak.

Seeds find where to look. A mask lays a few fixed positions over consecutive words and ignores the others; the words at
the fixed positions are hashed, in items and in every place of every document, and the hashes are joined. The two masks are
such that any WINDOW words with SUBSTITUTED replaced leave one of them whole somewhere, so no leak is missed. Around a hit
the words of item and document are compared side by side, over the whole item; of hits that follow each other side by side
only the first is looked at.

Seeds are broadcast if they are at most BROADCAST_SEEDS rows, which is counted first; the documents' words then flow through
one stage, and only hits leave it. With more seeds, places are shuffled by hash, hits are brought back to their document,
and skew-join handling splits hashes that very many documents have.

Nulls: a null text (of document or item) has no words and is in no row; a null doc_id or item_id stays null, and rows of
equal doc_id are reported together. Empty texts: no rows. Very long texts are compared whole. Repeated rows and ties: one
row for each doc_id and item_id. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names, written

#: Words that are compared at once, how many may be replaced, and fewest words of an item.
WINDOW, SUBSTITUTED, LEAST = 13, 2, 5
#: Fixed positions of the masks; of any 13 words with 2 replaced, one of the two stands whole somewhere.
MASKS = ("11101011", "110100111")
#: Rows of seeds (a hash, an item, a place: about 64 bytes) up to which they are broadcast.
BROADCAST_SEEDS = 1_000_000

#: Ids of documents with a leak up to which they are broadcast, so that documents aren't shuffled.
BROADCAST_LEAKED = 1_000_000

_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def _by_mask(masks: list[str], value) -> Column:
    """value(mask) of the row's mask, by its number."""
    out = value(masks[-1])
    for k, m in enumerate(masks[:-1]):
        out = F.when(F.col("mask") == k, value(m)).otherwise(out)
    return out


def _places(rows: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """keep, w, at, mask and hash for each place of each row's words `w` that a mask fits, and each mask.

    The mask itself is hashed as well. A hash is never null, so it is computed once, in the projection that the join reads.
    """
    n = len(masks)
    every = F.when(F.size("w") >= LEAST, F.sequence(F.lit(0), F.size("w") * n - 1))  # outer: else Spark would split twice
    each = rows.select(*keep, "w", F.explode_outer(every).alias("k"))
    each = each.select(*keep, "w", F.expr(f"cast(k div {n} as int)").alias("at"), F.expr(f"cast(k % {n} as int)").alias("mask"))
    fits = each.where(F.col("at") + _by_mask(masks, lambda m: F.lit(len(m))) <= F.size("w"))
    fixed = lambda m: [F.get("w", F.col("at") + o) for o, bit in enumerate(m) if bit == "1"]
    return fits.withColumn("hash", _by_mask(masks, lambda m: F.xxhash64(F.lit(m), *fixed(m))))


def _first_of_run(masks: list[str]) -> Column:
    """Not the next hit of a run: the mask doesn't fit one word before as well."""
    fixed = lambda m: [o for o, bit in enumerate(m) if bit == "1"]
    same = lambda m: reduce(and_, (F.get("w", F.col("at") - 1 + o) == F.get("item_w", F.col("item_at") - 1 + o) for o in fixed(m)))
    out = F.coalesce(_by_mask(masks, same), F.lit(False))
    return ~((F.col("at") > 0) & (F.col("item_at") > 0) & out)


def _compared(hits: DataFrame, keep: list[str]) -> DataFrame:
    """hits (w, item_w and diagonal) that are leaks, with first_word (of the leak in the document) and n_equal."""
    n, window = "size(item_w)", f"least({WINDOW}, size(item_w))"
    equal = hits.withColumn("equal", F.expr(f"transform(sequence(0, {n} - 1), i -> if(coalesce(get(w, i + diagonal) = get(item_w, i), false), 1, 0))"))
    enough = f"{window} - if({n} >= {WINDOW}, {SUBSTITUTED}, 0)"
    inside = f"i + diagonal >= 0 and i + diagonal + {window} <= size(w)"
    starts = F.expr(f"filter(sequence(0, {n} - {window}), i -> {inside} and aggregate(slice(equal, i + 1, {window}), 0, (a, x) -> a + x) >= {enough})")
    leaks = equal.withColumn("starts", starts).where("size(starts) > 0")
    return leaks.select(*keep, F.expr("cast(starts[0] + diagonal as long)").alias("first_word"), F.expr("cast(aggregate(equal, 0, (a, x) -> a + x) as long)").alias("n_equal"), F.expr(f"cast({n} as long)").alias("item_words"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """doc_id, item_id, first_word (the first word, from 0, of the first leak), n_equal (equal words along the item, at its
    best place) and item_words, for each document (doc_id, text) that an item (item_id, text) leaks into."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= LEAST).distinct()
    items = items.withColumn("item", F.xxhash64("item_id", "w"))
    short = sorted(r["n"] for r in items.select(F.size("w").alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # at most WINDOW numbers
    masks = [*MASKS, *("1" * n for n in short)]
    seeds = _places(items.select("item", "w"), masks, ["item"]).where((F.col("mask") >= len(MASKS)) == (F.size("w") < WINDOW))
    seeds = seeds.where((F.col("mask") < len(MASKS)) | (F.col("at") == 0)).select("hash", "item", F.col("at").alias("item_at"))
    targets = items.select("item", "item_id", F.col("w").alias("item_w"))
    read = docs.select("doc_id", words(F.col("text")).alias("w"))
    if seeds.count() <= broadcast_seeds:
        hits = _places(read, masks, ["doc_id"]).join(F.broadcast(seeds), "hash").join(F.broadcast(targets), "item")
        hits = hits.where(_first_of_run(masks)).select("doc_id", "item_id", "w", "item_w", (F.col("at") - F.col("item_at")).alias("diagonal"))
        leaks = _compared(hits, ["doc_id", "item_id"])
    else:
        keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), words(F.col("text")).alias("w"))
        places = _places(keyed, masks, ["doc"]).select("doc", "hash", "at")
        found = places.join(seeds, "hash").select("doc", "item", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
        leaks = _compared(found.join(keyed, "doc").join(targets, "item"), ["doc_id", "item_id"])
    return leaks.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("n_equal").alias("n_equal"), F.max("item_words").alias("item_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id has a leak; null doc_ids are compared like others."""
    leaked = written(find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    if leaked.count() <= BROADCAST_LEAKED:
        leaked = F.broadcast(leaked)
    rows, names = plain_names(docs)
    return rows.join(leaked, F.col(names["doc_id"]).eqNullSafe(F.col("leaked")), "left_anti").toDF(*docs.columns)


#: The same in DuckDB's SQL, without seeds: all places where a word of an item and of a document are equal, by diagonal.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, len(w) AS n, least(13, len(w)) AS win, len(w) AS item_words, unnest(w) AS word, unnest(range(len(w))) AS q FROM b WHERE len(w) >= 5),
p AS (SELECT doc_id, len(w) AS n_doc, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
e AS (SELECT doc_id, item_id, n, win, n_doc, p - q AS diagonal, q FROM p JOIN i USING (word)),
g AS (SELECT doc_id, item_id, n, win, n_doc, diagonal, list(q) AS qs FROM e GROUP BY ALL
      HAVING count(*) >= win - CASE WHEN n >= 13 THEN 2 ELSE 0 END),
s AS (SELECT doc_id, item_id, n, diagonal, len(qs) AS n_equal,
        list_filter(range(n - win + 1), lambda k: k + diagonal >= 0 AND k + diagonal + win <= n_doc
          AND len(list_filter(qs, lambda x: x >= k AND x < k + win)) >= win - CASE WHEN n >= 13 THEN 2 ELSE 0 END) AS starts FROM g)
SELECT doc_id, item_id, CAST(min(starts[1] + diagonal) AS BIGINT) AS first_word, CAST(max(n_equal) AS BIGINT) AS n_equal, CAST(max(n) AS BIGINT) AS item_words
FROM s WHERE len(starts) > 0 GROUP BY doc_id, item_id
"""
