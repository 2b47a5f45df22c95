"""The queries op1 to op10 over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, langid, licenses, quality, repeats, sharding, simhash, token_counts, warc
from .common import table

#: The ranks that op4, op9 and the pipeline use.
RANKS = "byte_bpe_multi_50k.tiktoken"


#: op1: shards before, by source, and after.
OLD_SHARDS, SHARDS = 16, 24


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    placed = sharding.reshard_documents(docs, F.pmod(F.crc32("source"), F.lit(OLD_SHARDS)), SHARDS)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return placed.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = token_counts.histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return token_counts.suffix_sums(hist)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model, ("doc_id", "held_out"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.base_rules(table(spark, sf_dir, "documents"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.base_phrases(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_resharding, op2_decontamination, op3_warc, op4_token_counts, op5_quality, op6_simhash, op7_suffix_dedup, op8_language, op9_bpe, op10_licenses, quality_base_rules, license_base_phrases)}
#: The last two are the parts of op5 and op10 that SQL can express.
ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontamination.SQL, "op3_warc": warc.SQL, "quality_base_rules": quality.SQL, "license_base_phrases": licenses.SQL}
