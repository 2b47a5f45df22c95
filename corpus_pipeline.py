"""A corpus pipeline of five stages over `documents`: quality rules, SimHash near-dedup, suffix-array dedup, benchmark
decontamination, and byte-level BPE encoding.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; run() writes
it as Parquet in the shared folder and gives it to the next. All but the last return the columns of docs, whatever they
are called, extra ones included.

Nulls in any column but text mean nothing to a stage and are kept. A null text fails the quality rules; to the stages after
them it is an empty text, it stays null, and it has no tokens. Repeated rows: the second stage keeps one of rows with equal
doc_id and text. A null doc_id goes in the second stage where its group has another, and is compared like other ids in the
fourth. Empty texts are copies of each other. Very long texts are worked on whole. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, decontamination, quality, repeats, simhash
from tallyforge.llm.common import table, written
from tallyforge.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and model keep. The model learns from the labelled rows among docs."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = [f"_{k}" for k in range(len(docs.columns))]  # whatever docs' columns are called
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]))
    kept = quality.score(plain, model, columns=tuple(names)).where("kept")
    return kept.select(*names).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id.

    Copies are linked if their shingles of five words have a similarity of 0.8 or more; fingerprints of the different words
    of a text that differ in at most three bits tell which pairs to look at first, and shared shingles which ones after them.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their passages of 200 bytes or more that stand elsewhere as well; characters stay whole."""
    names = [f"_{k}" for k in range(len(docs.columns))]  # whatever docs' columns are called
    text, size = (names[docs.columns.index(c)] for c in ("text", "n_chars"))
    plain = docs.toDF(*names).withColumn("text", F.col(text)).withColumn("had_text", F.col(text).isNotNull())
    others = [n for n in names if n != text]
    cut = repeats.remove_repeats(plain, (*others, "had_text"), whole_characters=True)
    left = F.col("kept").cast("string")
    new = {
        text: F.when(F.col("had_text"), left).alias(text),
        size: F.when(F.col("n_removed") > 0, F.length(left).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(size)).alias(size),
    }
    return cut.select(*(new.get(n, F.col(n)) for n in names)).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens: doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", encode),
]

#: SQL can't express the model of the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
