"""Exports of a ledger: CSV of postings, JSON and Beancount. Duplicates are left out; transactions go by date and id.

Each line or entry is one text column of a DataFrame with its place in the file, so the text is made where the rows are, and
a file is written in order by a range-partitioned sort. Only the small heads (currencies, accounts) are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ledger import active, postings

CSV_HEAD = "date,tx_id,payee,account,amount,commodity,memo"
BANNER = "; Generated by tallyforge (deterministic)"


def csv_lines(transactions: DataFrame) -> DataFrame:
    """date, transaction_id, ordinal and line of each posting."""
    p = postings(active(transactions))
    fields = [F.col("date").cast("string"), "transaction_id", "payee", "account_id", "amount_text", "commodity", "memo"]
    line = F.concat_ws(",", *(S.csv_field(F.col(c) if isinstance(c, str) else c) for c in fields))
    return p.select("date", "transaction_id", "ordinal", line.alias("line"))


def json_lines(transactions: DataFrame) -> DataFrame:
    """date, transaction_id and JSON of each transaction, nulls written."""
    legs = F.transform("postings", lambda p: F.struct(p["account"].alias("account"), p["amount_text"].alias("amount"), p["commodity"].alias("commodity"), p["memo"].alias("memo")))
    body = F.struct("id", F.col("date").cast("string").alias("date"), "payee", "narration", legs.alias("postings"), "import_batch_id", "duplicate_of", "tags", "row_fingerprint")
    return active(transactions).select("date", F.col("id").alias("transaction_id"), F.to_json(body, {"ignoreNullFields": "false"}).alias("line"))


def json_entries(transactions: DataFrame) -> DataFrame:
    """date, transaction_id and entry: each transaction as it stands in the indented document, with the fields of
    json_lines."""
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    field = lambda n, c: F.concat(F.lit(f'"{n}": '), quoted(c))
    block = lambda items, margin, a, b: F.when(F.size(items) == 0, F.lit(a + b)).otherwise(F.concat(F.lit(a + "\n" + margin + "  "), F.array_join(items, ",\n" + margin + "  "), F.lit("\n" + margin + b)))
    leg = lambda p: block(F.array(*(field(n, p[c]) for n, c in (("account", "account"), ("amount", "amount_text"), ("commodity", "commodity"), ("memo", "memo")))), " " * 8, "{", "}")
    plain = lambda n: field(n, F.col(n))
    listed = lambda n, items: F.concat(F.lit(f'"{n}": '), block(items, " " * 6, "[", "]"))
    fields = F.array(
        plain("id"),
        field("date", F.col("date").cast("string")),
        plain("payee"),
        plain("narration"),
        listed("postings", F.transform(F.coalesce("postings", F.array()), leg)),
        plain("import_batch_id"),
        plain("duplicate_of"),
        listed("tags", F.transform("tags", quoted)),
        plain("row_fingerprint"),
    )
    return active(transactions).select("date", F.col("id").alias("transaction_id"), F.concat(F.lit("    "), block(fields, " " * 4, "{", "}")).alias("entry"))


def commodity_uses(transactions: DataFrame) -> DataFrame:
    """Number of postings and first date of each commodity."""
    return postings(active(transactions)).groupBy("commodity").agg(F.count("*").alias("uses"), F.min("date").alias("first_date"))


def account_opens(transactions: DataFrame) -> DataFrame:
    """First date of each account, under its name in Beancount."""
    return postings(active(transactions)).groupBy(S.bean_account(F.col("account_id")).alias("account")).agg(F.min("date").alias("first_date"))


def operating_currency(transactions: DataFrame) -> DataFrame:
    """One row: the commodity with most postings; of several the one used first, then the first by code. None if empty."""
    order = F.struct((-F.col("uses")).alias("u"), "first_date", "commodity")
    return commodity_uses(transactions).agg(F.min(order).alias("o")).where("o is not null").select(F.col("o.commodity").alias("operating_currency"))


def bean_entries(transactions: DataFrame) -> DataFrame:
    """date, transaction_id and entry (several lines) of each transaction."""
    quoted = lambda c: F.concat(F.lit('"'), S.bean_string(c), F.lit('"'))
    narration = F.when(F.col("narration") != "", F.concat(F.lit(" "), quoted(F.col("narration"))))
    head = F.concat(F.col("date").cast("string"), F.lit(" * "), quoted(F.col("payee")), F.coalesce(narration, F.lit("")))
    memo = lambda p: F.coalesce(F.when(p["memo"] != "", F.concat(F.lit(" ; "), F.replace(p["memo"], F.lit("\n"), F.lit(" ")))), F.lit(""))
    leg = lambda p: F.concat(F.lit("  "), S.bean_account(p["account"]), F.lit("  "), p["amount_text"], F.lit(" "), p["commodity"], memo(p))
    lines = F.concat(
        F.array(head, F.concat(F.lit('  id: "'), F.col("id"), F.lit('"'))),
        F.array_compact(F.array(F.concat(F.lit('  import_batch: "'), F.col("import_batch_id"), F.lit('"')))),
        F.transform(S.categories(F.col("tags")), lambda c: F.concat(F.lit("  category: "), quoted(c))),
        F.transform("postings", leg),
    )
    return active(transactions).select("date", F.col("id").alias("transaction_id"), F.array_join(lines, "\n").alias("entry"))


def bean_directives(transactions: DataFrame) -> DataFrame:
    """section (1 commodities, 2 accounts), name and line of what stands before the transactions."""
    c = commodity_uses(transactions).select(F.lit(1).alias("section"), F.col("commodity").alias("name"), F.concat(F.col("first_date").cast("string"), F.lit(" commodity "), F.col("commodity")).alias("line"))
    o = account_opens(transactions).select(F.lit(2).alias("section"), F.col("account").alias("name"), F.concat(F.col("first_date").cast("string"), F.lit(" open "), F.col("account")).alias("line"))
    return c.unionByName(o)


def _csv(transactions: DataFrame) -> tuple[str, DataFrame, str]:
    return CSV_HEAD + "\n", csv_lines(transactions).select("date", "transaction_id", "ordinal", F.concat("line", F.lit("\n")).alias("text")), ""


def _json(transactions: DataFrame) -> tuple[str, DataFrame, str]:
    rows = json_entries(transactions).select("date", "transaction_id", F.lit(0).alias("ordinal"), F.col("entry").alias("text"))
    empty = active(transactions).isEmpty()
    return '{\n  "transactions": [' if empty else '{\n  "transactions": [\n', rows, "]\n}" if empty else "\n  ]\n}"


def _beancount(transactions: DataFrame) -> tuple[str, DataFrame, str]:
    currency = operating_currency(transactions).first()
    head = [BANNER] + ([f'option "operating_currency" "{currency[0]}"'] if currency else []) + [""]
    directives = bean_directives(transactions).orderBy("section", "name").collect()  # a row for each currency and account
    for section in (1, 2):
        own = [d.line for d in directives if d.section == section]
        head += [*own, ""] if own else []
    rows = bean_entries(transactions).select("date", "transaction_id", F.lit(0).alias("ordinal"), F.concat("entry", F.lit("\n\n")).alias("text"))
    return "\n".join(head) + "\n", rows, ""


EXPORTERS: dict[str, Callable[[DataFrame], tuple[str, DataFrame, str]]] = {"csv": _csv, "json": _json, "beancount": _beancount}


def export_parts(transactions: DataFrame, form: str) -> Iterator[str]:
    """The whole export, piece by piece; rows come to the driver a partition at a time."""
    head, rows, tail = EXPORTERS[form](transactions)
    yield head
    first = True
    for r in rows.orderBy("date", "transaction_id", "ordinal").toLocalIterator():
        if form == "json" and not first:
            yield ",\n"
        first = False
        yield r.text
    yield tail


def export_text(transactions: DataFrame, form: str) -> str:
    """The whole export as one text."""
    return "".join(export_parts(transactions, form))


def export_files(transactions: DataFrame, form: str, path: str) -> None:
    """The export as text files below path (head, rows and tail, in this order), whose names are in order. Together, line by
    line, they are the export."""
    head, rows, tail = EXPORTERS[form](transactions)
    spark = transactions.sparkSession
    order = ("date", "transaction_id", "ordinal")
    value = F.regexp_replace("text", r"\n\z", "")
    if form == "json":  # all but the last end in a comma
        last = rows.agg(F.max(F.struct(*order)).alias("last"))
        rows = rows.crossJoin(F.broadcast(last))  # one row
        value = F.when(F.struct(*order) == F.col("last"), value).otherwise(F.concat(value, F.lit(",")))
    for name, text in (("head", head.removesuffix("\n")), ("tail", tail.removeprefix("\n").removesuffix("\n"))):
        if text:
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{name}")
    rows.orderBy(*order).select(value.alias("value")).write.text(f"{path}/rows")
