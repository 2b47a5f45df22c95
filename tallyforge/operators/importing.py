"""Idempotent import: what of a batch is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_KEY = ("adapter", "source_sha256", "account_id")


def new_batches(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Batches whose file wasn't imported to that account by that layout; a second one changes nothing."""
    return incoming.join(known.select(*BATCH_KEY), list(BATCH_KEY), "left_anti")


def first_of_each(transactions: DataFrame) -> DataFrame:
    """Of transactions with one id the first by row number, if there is one, else any: they are equal but for the batch."""
    order = F.col("row_number") if "row_number" in transactions.columns else F.lit(0)
    columns = transactions.columns
    return transactions.groupBy("id").agg(F.min_by(F.struct(*columns), order).alias("t")).select("t.*")


def new_transactions(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return first_of_each(incoming).join(known.select("id"), "id", "left_anti").select(*incoming.columns)


def skipped(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Incoming transactions that are there already."""
    return incoming.join(known.select("id"), "id", "left_semi")


def new_accounts(incoming: DataFrame, known: DataFrame) -> DataFrame:
    return incoming.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
