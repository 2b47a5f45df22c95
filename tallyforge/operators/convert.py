"""Raw statement rows to balanced transactions, and to statement rows that account for each of them.

One projection does all: each row carries either its transaction or the first check that it fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Options:
    bank: str
    expense: str = "expenses:uncategorized"
    income: str = "income:uncategorized"
    commodity: str = "INR"
    batch_id: str | None = None


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def convert(raw: DataFrame, adapter: str, options: Options) -> DataFrame:
    """raw rows with error (null if all checks pass) and the transaction's columns.

    The checks are made in order: date, amount, zero, commodity. A row with a parse error isn't checked.
    """
    given = S.trim_all(F.col("currency_raw"))
    parsed = S.staged(S.with_merchant(S.staged(S.with_date(raw, "date_raw", "date")), "description_raw", "narration"))
    parsed = parsed.withColumns({"_digits": S.amount_digits(F.col("amount_raw")), "_given": given})
    code = F.when(F.coalesce("_given", F.lit("")) == "", F.lit(options.commodity)).otherwise(S.commodity(F.col("_given")))
    parsed = parsed.withColumns({"amount": S.amount_of(F.col("_digits")), "amount_text": S.text_of_digits(F.col("_digits")), "commodity": code}).drop("_digits", "_given")
    error = F.when(
        F.col("parse_error").isNull(),
        F.coalesce(
            F.when(F.col("date").isNull(), F.concat(F.lit("unparseable date "), _quoted(F.col("date_raw")))),
            F.when(F.col("amount").isNull(), F.concat(F.lit("invalid money amount: "), F.col("amount_raw"), F.lit(": not a decimal"))),
            F.when(F.col("amount") == 0, F.lit("amount is zero")),
            F.when(F.col("commodity").isNull(), F.concat(F.lit("invalid commodity: "), F.col("currency_raw"))),
        ),
    )
    checked = S.staged(parsed.withColumn("error", error))
    good = F.col("error").isNull() & F.col("parse_error").isNull()
    mark = S.fingerprint(F.lit(adapter), F.lit(options.bank), F.col("date"), F.col("amount_text"), F.col("commodity"), F.col("source_refs"), F.col("narration"))
    offset = F.when(F.col("amount") < 0, F.lit(options.expense)).otherwise(F.lit(options.income))
    legs = F.array(
        S.posting(F.lit(options.bank), F.col("amount"), F.col("amount_text"), F.col("commodity"), F.array_join("source_refs", ",")),
        S.posting(offset, -F.col("amount"), S.negated_text(F.col("amount_text")), F.col("commodity")),
    )
    done = S.staged(checked.withColumn("row_fingerprint", F.when(good, mark)).withColumn("_hash", F.sha2("row_fingerprint", 256)))
    return done.withColumns(
        {
            "id": S.uuid8_of(F.col("_hash")),
            "payee": S.trim_all(F.col("description_raw")),
            "import_batch_id": F.lit(options.batch_id).cast("string"),
            "duplicate_of": F.lit(None).cast("string"),
            "tags": F.array().cast("array<string>"),
            "postings": F.when(good, legs),
        }
    ).drop("_hash")


_TRANSACTION = ("id", "date", "payee", "narration", "import_batch_id", "duplicate_of", "tags", "row_fingerprint", "postings")


def transactions(converted: DataFrame) -> DataFrame:
    """The transactions of the rows that pass all checks."""
    return converted.where("parse_error is null and error is null").select(*_TRANSACTION)


def statement_rows(converted: DataFrame, adapter: str, options: Options) -> DataFrame:
    """One row for each raw row: ok, convert_error or parse_error, in that order of precedence for a row number.

    A parse error whose text names no row has the number -1, -2 and so on, by text.
    """
    none = F.lit(None).cast("string")
    batch = F.lit(options.batch_id).cast("string").alias("batch_id")

    def project(part: DataFrame, number: Column, status: Column, mark: Column, message: Column, tx: Column) -> DataFrame:
        raw = ("date_raw", "amount_raw", "currency_raw", "description_raw", "balance_raw", "source_refs")
        return part.select(batch, F.lit(adapter).alias("adapter"), F.lit(options.bank).alias("account_id"), number.cast("long").alias("row_number"), *raw, mark.alias("fingerprint"), status.alias("parse_status"), message.alias("error"), tx.alias("transaction_id"))

    # what a parse error hasn't got is not named, so that nothing is converted to find the errors
    status = F.when(F.col("error").isNotNull(), "convert_error").otherwise("ok")
    taken = project(converted.where("parse_error is null"), F.col("row_number"), status, F.col("row_fingerprint"), F.col("error"), F.col("id"))
    number = F.coalesce(F.col("row_number").cast("long"), S.error_row(F.col("parse_error")))
    failed = project(converted.where("parse_error is not null"), number, F.lit("parse_error"), none, F.col("parse_error"), none)
    numbers = converted.where("parse_error is null").select(batch, F.col("row_number").cast("long").alias("row_number")).distinct()
    return taken.unionByName(first_per_row(numbered(failed), numbers))


def numbered(errors: DataFrame) -> DataFrame:
    """errors, of which those without a row number get -1, -2 and so on in their batch, by text."""
    order = Window.partitionBy("batch_id").orderBy("error")
    rest = errors.where("row_number is null").withColumn("row_number", -F.row_number().over(order).cast("long"))
    return errors.where("row_number is not null").unionByName(rest)


def first_per_row(errors: DataFrame, taken: DataFrame) -> DataFrame:
    """Parse errors without those for a row number that is taken; of several for one, the first by text stays."""
    left = errors.join(taken, [errors["batch_id"].eqNullSafe(taken["batch_id"]), errors["row_number"] == taken["row_number"]], "left_anti")
    order = Window.partitionBy("batch_id", "row_number").orderBy("error")
    return left.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
