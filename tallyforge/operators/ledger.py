"""Balances, invariants and hashes of a ledger of transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import AMOUNT


def postings(transactions: DataFrame) -> DataFrame:
    """One row for each posting, with its place (ordinal, from 0) and what it takes from the transaction."""
    rows = transactions.select(F.col("id").alias("transaction_id"), "date", "payee", "duplicate_of", F.posexplode("postings").alias("ordinal", "p"))
    return rows.select("transaction_id", "date", "payee", "duplicate_of", "ordinal", F.col("p.account").alias("account_id"), "p.amount", "p.amount_text", "p.commodity", "p.memo")


def with_postings(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """Transactions put together again from heads and posting rows, in the postings' order."""
    one = F.struct(F.col("ordinal"), F.struct(F.col("account_id").alias("account"), "amount", "amount_text", "commodity", "memo").alias("p"))
    grouped = rows.groupBy(F.col("transaction_id").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("_all"))
    return heads.join(grouped, "id", "left").withColumn("postings", F.transform("_all", lambda x: x["p"])).drop("_all")


def active(transactions: DataFrame) -> DataFrame:
    return transactions.where("duplicate_of is null")


def balances(transactions: DataFrame) -> DataFrame:
    """The balance of each account and commodity; duplicates don't count. Overflow is an error."""
    return postings(active(transactions)).groupBy("account_id", "commodity").agg(F.sum("amount").cast(AMOUNT).alias("balance"))


def balance(transactions: DataFrame, account: str, commodity: str) -> DataFrame:
    """One row: the balance of an account in a commodity, 0 if nothing was posted to it."""
    own = postings(active(transactions)).where((F.col("account_id") == account) & (F.col("commodity") == commodity))
    return own.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(AMOUNT).alias("balance")).select(F.lit(account).alias("account_id"), F.lit(commodity).alias("commodity"), "balance")


def residuals(transactions: DataFrame) -> DataFrame:
    """What the postings of a transaction add up to in a commodity, where that isn't zero."""
    sums = postings(transactions).groupBy("transaction_id", "commodity").agg(F.sum("amount").cast(AMOUNT).alias("residual"))
    return sums.where("residual <> 0")


def unbalanced(transactions: DataFrame) -> DataFrame:
    """transaction_id and message of each transaction that breaks an invariant. Balance is looked at before the count."""
    parts = residuals(transactions).groupBy("transaction_id").agg(F.sort_array(F.collect_list(F.struct("commodity", "residual"))).alias("r"))
    detail = F.array_join(F.transform("r", lambda x: F.concat(x["commodity"], F.lit(" residual="), S.decimal_text(x["residual"]))), "; ")
    wrong = parts.select("transaction_id", detail.alias("detail"))
    few = transactions.where(F.size(F.coalesce("postings", F.array())) < 2).select(F.col("id").alias("transaction_id"))
    few = few.join(wrong, "transaction_id", "left_anti").withColumn("detail", F.lit("transaction requires at least two postings"))
    both = wrong.unionByName(few)
    return both.select("transaction_id", F.concat(F.lit("transaction "), F.col("transaction_id"), F.lit(" does not balance: "), F.col("detail")).alias("message"))


def _row_hash() -> Column:
    fields = ("id", "date", "payee", "narration", "import_batch_id", "duplicate_of", "tags", "row_fingerprint", "postings")
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def ledger_hash(transactions: DataFrame, portable: bool = False) -> DataFrame:
    """One row: a hash that is equal for equal ledgers, duplicates included. Portable: without batch ids.

    Rows are hashed where they lie. Their hashes are folded in three levels: by date and the first four digits of the id, in
    order of id, then by date, then over the dates. So one task holds a 65,536th of a day's rows, not a day or the ledger.
    """
    rows = transactions.withColumn("import_batch_id", F.lit(None).cast("string")) if portable else transactions
    hashed = rows.select("date", F.substring("id", 1, 4).alias("head"), "id", _row_hash().alias("h"))
    folded = lambda order: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), ""), 256)
    heads = hashed.groupBy("date", "head").agg(folded("id").alias("h"))
    days = heads.groupBy("date").agg(folded("head").alias("h"))
    return days.agg(folded("date").alias("ledger_hash"))


def verify(transactions: DataFrame) -> DataFrame:
    """One row: counts of transactions, postings and broken transactions, and the ledger's hash."""
    counts = transactions.agg(F.count("*").alias("transaction_count"), F.coalesce(F.sum(F.size(F.coalesce("postings", F.array()))), F.lit(0)).cast("long").alias("posting_count"))
    broken = unbalanced(transactions).agg(F.count("*").alias("unbalanced_count"))
    three = counts.unionByName(broken, allowMissingColumns=True).unionByName(ledger_hash(transactions), allowMissingColumns=True)  # rows of one each
    names = ("transaction_count", "posting_count", "unbalanced_count", "ledger_hash")
    return three.agg(*(F.max(n).alias(n) for n in names))


def canonical_order(transactions: DataFrame) -> DataFrame:
    return transactions.orderBy("date", "id")
