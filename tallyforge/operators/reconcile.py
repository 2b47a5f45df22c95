"""Proofs: an account's ending balance, and the coverage of statement rows."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import AMOUNT
from .ledger import postings

MATCHED, SKIPPED, AFTER = "matched", "skipped_duplicate", "after_as_of"


def lines(transactions: DataFrame, account: str, commodity: str, as_of: date | str) -> DataFrame:
    """What each transaction adds to an account in a commodity, with its bucket. It is a line even if that is zero.

    The date is looked at first: a late duplicate is after_as_of.
    """
    own = postings(transactions).where((F.col("account_id") == account) & (F.col("commodity") == commodity))
    hits = own.groupBy("transaction_id").agg(F.first("date").alias("date"), F.first("payee").alias("payee"), F.first("duplicate_of").alias("duplicate_of"), F.sum("amount").cast(AMOUNT).alias("amount"))
    bucket = F.when(F.col("date") > F.lit(str(as_of)).cast("date"), AFTER).when(F.col("duplicate_of").isNotNull(), SKIPPED).otherwise(MATCHED)
    return hits.select(bucket.alias("bucket"), "date", "transaction_id", "payee", "amount")


def summary(proof_lines: DataFrame, stated: Decimal | str, starting: Decimal | str = "0") -> DataFrame:
    """One row: computed ending balance, its difference from the stated one, and the number of lines by bucket."""
    start, end = F.lit(str(starting)).cast(AMOUNT), F.lit(str(stated)).cast(AMOUNT)
    activity = F.coalesce(F.sum(F.when(F.col("bucket") == MATCHED, F.col("amount"))), F.lit(0)).cast(AMOUNT)
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in (MATCHED, SKIPPED, AFTER)]
    sums = proof_lines.agg(activity.alias("activity"), *counts)
    ending = (start + F.col("activity")).cast(AMOUNT)
    return sums.select(start.alias("starting"), ending.alias("computed_ending"), end.alias("stated_ending"), (ending - end).cast(AMOUNT).alias("unexplained_delta"), MATCHED, SKIPPED, AFTER)


def proof_name(account: str, as_of: date | str) -> str:
    return f"reconcile-{account.replace(':', '_')}-{as_of}.md"


def _plain(amount: Decimal) -> str:
    text = format(amount, "f")
    return (text.rstrip("0").rstrip(".") or "0") if "." in text else text


def proof_parts(account: str, commodity: str, as_of: date | str, proof_lines: DataFrame, totals: DataFrame) -> list[str | DataFrame]:
    """The proof as pieces of text, in order: texts, and frames whose rows are lines in order. Lines stay where they lie."""
    t = totals.first()
    status = "BALANCED" if t.unexplained_delta == 0 else "UNEXPLAINED_DELTA"
    head = [
        "# Reconciliation proof\n",
        f"- account: `{account}`",
        f"- commodity: `{commodity}`",
        f"- as_of: {as_of}",
        f"- starting: {_plain(t.starting)}",
        f"- computed_ending: {_plain(t.computed_ending)}",
        f"- stated_ending: {_plain(t.stated_ending)}",
        f"- unexplained_delta: {_plain(t.unexplained_delta)}",
        f"- status: {status}",
        f"- matched: {t[MATCHED]}",
        f"- unmatched: {t[SKIPPED] + t[AFTER]}",
    ]
    out: list[str | DataFrame] = ["\n".join(head) + "\n"]
    line = F.concat(F.lit("| "), F.col("date").cast("string"), F.lit(" | `"), F.col("transaction_id"), F.lit("` | "), F.coalesce("payee", F.lit("None")), F.lit(" | "), S.decimal_text(F.col("amount")), F.lit(" |"))
    for title, bucket in (("Included postings (skip duplicates)", MATCHED), ("Skipped duplicates", SKIPPED), ("After as_of (excluded)", AFTER)):
        out.append(f"\n## {title}\n\n" + ("| date | tx | payee | amount |\n|---|---|---|---|\n" if t[bucket] else "_none_\n"))
        if t[bucket]:
            out.append(proof_lines.where(F.col("bucket") == bucket).orderBy("date", "transaction_id").select(line.alias("value")))
    return out


def row_buckets(statement_rows: DataFrame, account: str) -> DataFrame:
    """The account's statement rows with a bucket: matched, convert_error, parse_error or unmatched_row."""
    status = F.col("parse_status")
    bucket = F.when((status == "ok") & F.col("transaction_id").isNotNull(), "matched").when(status.isin("convert_error", "parse_error"), status).otherwise("unmatched_row")
    return statement_rows.where(F.col("account_id") == account).withColumn("bucket", bucket)


def bucket_counts(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("bucket").agg(F.count("*").alias("rows"))


def uncovered(transactions: DataFrame, statement_rows: DataFrame, account: str) -> DataFrame:
    """Imported transactions that touch the account and that no statement row names."""
    named = row_buckets(statement_rows, account).where("bucket = 'matched'").select(F.col("transaction_id").alias("id")).distinct()
    touching = transactions.where(F.col("import_batch_id").isNotNull() & F.exists("postings", lambda p: p["account"] == account))
    return touching.join(named, "id", "left_anti").select("id")


def rows_markdown(account: str, buckets: DataFrame, missing: DataFrame) -> tuple[str, bool]:
    """The coverage of statement rows as text, and whether there are no gaps."""
    n = {r.bucket: r.rows for r in bucket_counts(buckets).collect()}
    left = missing.count()
    ok = not (left or n.get("unmatched_row") or n.get("convert_error") or n.get("parse_error"))
    text = [
        "# Statement-row reconciliation\n",
        f"- account: `{account}`",
        f"- matched: {n.get('matched', 0)}",
        f"- unmatched_rows: {n.get('unmatched_row', 0)}",
        f"- convert_errors: {n.get('convert_error', 0)}",
        f"- parse_errors: {n.get('parse_error', 0)}",
        f"- unmatched_imported_txns: {left}",
        f"- status: {'ROWS_MATCHED' if ok else 'ROW_GAPS'}",
    ]
    return "\n".join(text) + "\n", ok


