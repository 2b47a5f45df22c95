"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Texts are encoded in Arrow batches and counted by length; the rows of a length are summed before they are
shuffled, so the histogram has at most one row for each distinct length, however many documents there are. Suffix
sums over the lengths then answer, for a context limit L, how many documents exceed it, how many tokens are left
if each is cut at L (the tokens of shorter ones plus L for each longer one), and which share of documents fits.

The suffix sums are taken in two levels, within runs of RUN lengths and over the runs, so that no task sorts all
lengths.

Nulls: a null text counts as an empty one, of length 0. Repeated rows all count. Very long texts are encoded whole.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ranks
from .common import slices

#: Lengths in a run of the two-level suffix sums.
RUN = 4096


@lru_cache(4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            for i, j, _, _ in slices(batch.column("text")):
                sizes = np.array([len(encode(text or "")) for text in batch.column("text")[i:j].to_pylist()], np.int64)
                length, n = np.unique(sizes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], ["length", "docs"])

    return run


def histogram(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """length, docs: how many documents have each encoded length."""
    counted = docs.select("text").mapInArrow(_lengths(path, pattern), "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: docs and tokens of just that length, docs_over and tokens_over (longer
    ones), tokens_kept (each text cut at the limit), tokens_total, docs_total and fits (share of docs within it)."""
    runs = hist.withColumn("run", F.floor(F.col("length") / RUN).cast("long")).withColumn("tokens", F.col("length") * F.col("docs"))
    over = Window.orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = runs.groupBy("run").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = sums.select(
        "run",
        *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")),
        *(F.sum(c).over(every).alias(f"{c}_all") for c in ("d", "t")),
    )
    longer = Window.partitionBy("run").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    both = runs.join(above, "run").select(
        "length",
        "docs",
        "tokens",
        (F.coalesce(F.sum("docs").over(longer), F.lit(0)) + F.col("d_above")).alias("docs_over"),
        (F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_above")).alias("tokens_over"),
        F.col("d_all").alias("docs_total"),
        F.col("t_all").alias("tokens_total"),
    )
    return both.withColumn("tokens_kept", F.col("tokens_total") - F.col("tokens_over") + F.col("length") * F.col("docs_over")).withColumn(
        "fits", (F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """One row for each of a few limits, which need not be lengths themselves: docs_over and tokens_kept.

    The longest length within a limit answers it: what is longer than that length is longer than the limit as well.
    Below the shortest length, every document is cut.
    """
    state = F.struct("docs_over", "tokens_over")
    asked = sums.agg(
        F.max("docs_total").alias("d"),
        F.max("tokens_total").alias("t"),
        *(F.max_by(F.when(F.col("length") <= n, state), F.when(F.col("length") <= n, F.col("length"))).alias(f"s{i}") for i, n in enumerate(limits)),
    )
    rows = F.array(*(F.struct(F.lit(n).cast("long").alias("limit"), F.col(f"s{i}").alias("s")) for i, n in enumerate(limits)))
    one = asked.select("d", "t", F.inline(rows))
    over = F.coalesce("s.docs_over", "d", F.lit(0))
    return one.select("limit", over.alias("docs_over"), F.coalesce(F.col("t") - F.coalesce("s.tokens_over", "t") + F.col("limit") * over, F.lit(0)).alias("tokens_kept"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """One row for each of a few shares (0 to 1): the smallest length that at least so many documents fit into."""
    asked = sums.agg(*(F.min(F.when(F.col("fits") >= q, F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)))
    return asked.select(F.inline(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)))))
