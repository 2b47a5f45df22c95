"""Bank statement sources: named layouts over CSV files of text.

A file is read by one task, whole, because row numbers count its records; files are capped for that reason. Nothing is
lost: a record that can't be read becomes a row with a parse error. All values are text; types come with conversion.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as arrow_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import RAW_ROW

#: Largest file, and most records of a file.
MAX_BYTES, MAX_ROWS = 32 << 20, 200_000
#: Rows of a batch that is handed on.
BATCH_ROWS = 1 << 14


class RowError(ValueError):
    """A record that can't be read."""


class SchemaError(ValueError):
    """A file without a column that its layout needs, or over a cap."""


Fields = Callable[[str], str]


@dataclass(frozen=True)
class Columns:
    """Names of the columns that hold each value. An amount is in one column, or in one of two for what was paid and got."""

    date: str
    description: str
    amount: str | None = None
    currency: str | None = None
    balance: str | None = None
    paid: str | None = None
    got: str | None = None
    code: str | None = None  # the currency of all rows
    amount_needed: bool = True


@dataclass(frozen=True)
class Adapter:
    """A layout: columns that it needs, and how a record becomes date, amount, currency, description and balance: by the
    columns that hold them, or by a function of one record's fields, which may raise RowError."""

    id: str
    name: str
    required: tuple[str, ...]
    ref: str
    columns: Columns | None = None
    map: Callable[[Fields, Fields], tuple] | None = field(default=None, repr=False)


def custom(date: str = "date", description: str = "description", amount: str = "amount", currency: str | None = "currency", balance: str | None = None) -> Adapter:
    """A layout with columns of any name. An empty amount is no parse error here; conversion reports it."""
    return Adapter("custom", "Custom column mapping", (date, description, amount), "custom", Columns(date, description, amount, currency, balance, amount_needed=False))


BUILTIN = {
    a.id: a
    for a in (
        Adapter("generic_csv", "Generic CSV", ("Date", "Description", "Amount"), "generic", Columns("Date", "Description", "Amount", "Currency", "Balance")),
        Adapter("hdfc", "HDFC CSV", ("Date", "Narration", "Withdrawal Amt.", "Deposit Amt."), "hdfc", Columns("Date", "Narration", None, None, "Closing Balance", "Withdrawal Amt.", "Deposit Amt.", "INR")),
        Adapter("credit_card", "Credit card CSV", ("Transaction Date", "Description", "Amount"), "cc", Columns("Transaction Date", "Description", "Amount", "Currency")),
        custom(),
    )
}
ALIASES = {"generic": "generic_csv", "cc": "credit_card"}


def adapter(name: str) -> Adapter | None:
    """A built-in layout by its id or an alias."""
    return BUILTIN.get(ALIASES.get(name, name))


def adapters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.id, a.name) for a in BUILTIN.values()], "id string, name string")


_RAW = pa.schema(
    [("row_number", pa.int32())]
    + [(c, pa.string()) for c in ("date_raw", "amount_raw", "currency_raw", "description_raw", "balance_raw")]
    + [("source_refs", pa.list_(pa.string())), ("parse_error", pa.string())]
)


def _records(text: str, max_rows: int) -> tuple[list[str], list[list[str]], dict[int, str]]:
    """Header, records that aren't empty, and errors of the reader by place; an unreadable record has no fields."""
    reader = csv.reader(io.StringIO(text, newline=""))
    head = next(filter(None, reader), [])  # lines without anything are no records
    records: list[list[str]] = []
    errors: dict[int, str] = {}
    while True:
        try:
            records += [r for r in reader if r] if not records else filter(None, reader)
            break
        except csv.Error as e:
            errors[len(records)] = str(e)
            records.append([])
    if len(records) > max_rows:
        raise SchemaError(f"too many data rows (max {max_rows})")
    return head, records, errors


def _plain_columns(content: bytes) -> list[pa.Array] | None:
    """The columns of a file without quotes all of whose records have as many fields, header first; null for other files."""
    if b'"' in content or content.count(b"\r") != content.count(b"\r\n"):
        return None
    first = content.lstrip(b"\r\n").partition(b"\n")[0]
    types = {f"f{k}": pa.string() for k in range(first.count(b",") + 1)}
    try:
        table = arrow_csv.read_csv(
            pa.BufferReader(content),
            arrow_csv.ReadOptions(autogenerate_column_names=True, use_threads=False),
            arrow_csv.ParseOptions(quote_char=False),
            arrow_csv.ConvertOptions(column_types=types, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return [c.combine_chunks() for c in table.columns]


def _place(head: list[str], required: tuple[str, ...]) -> dict[str, int]:
    """Where each column is, by its name in lower case; the first of equal ones."""
    names = [h.strip().encode("utf-8", "replace").decode() for h in head]
    place: dict[str, int] = {}
    for k, h in enumerate(names):
        place.setdefault(h.lower(), k)
    for name in required:
        if name.lower() not in place:
            raise SchemaError(f"missing required column '{name}' (have: {', '.join(names)})")
    return place


def _by_columns(columns: Columns, n: int, column: Callable[[int], pa.Array], place: dict[str, int]) -> tuple[list[pa.Array], pa.Array]:
    """The five values of n records, and what is wrong with each."""

    def values(name: str | None) -> pa.Array:
        k = place.get(name.lower()) if name else None
        return pa.nulls(n, pa.string()) if k is None else pc.utf8_trim_whitespace(column(k))

    wrong = pa.nulls(n, pa.string())
    asked = (columns.amount, columns.date, columns.description) if columns.amount_needed else (columns.date, columns.amount, columns.description)
    given = {name: values(name) for name in asked if name}  # in this order fields are missed
    balance = values(columns.balance)
    if columns.amount is None:
        paid, got = (pc.fill_null(values(name), "") for name in (columns.paid, columns.got))
        paid, got = (pc.if_else(pc.equal(x, "-"), "", x) for x in (paid, got))
        amount = pc.if_else(pc.equal(got, ""), pc.if_else(pc.equal(paid, ""), "", pc.binary_join_element_wise("-", paid, "")), got)
    else:
        amount = given[columns.amount]
    for name, found in given.items():
        wrong = pc.coalesce(wrong, pc.if_else(pc.is_null(found), f"missing field {name}", pa.scalar(None, pa.string())))
        if columns.amount_needed and name == columns.amount:
            wrong = pc.coalesce(wrong, pc.if_else(pc.equal(found, ""), "missing amount", pa.scalar(None, pa.string())))
    if columns.amount is None and columns.amount_needed:
        wrong = pc.coalesce(wrong, pc.if_else(pc.equal(amount, ""), "missing amount", pa.scalar(None, pa.string())))
    currency = pa.array([columns.code] * n, pa.string()) if columns.code else values(columns.currency)
    return [given[columns.date], amount, currency, given[columns.description], balance], wrong


def _by_function(layout: Adapter, records: list[list[str]], place: dict[str, int]) -> tuple[list[pa.Array], pa.Array]:
    rows, wrong = [], []
    for record in records:

        def maybe(name: str, record=record) -> str | None:
            k = place.get(name.lower())
            return record[k].strip() if k is not None and k < len(record) else None

        def get(name: str, maybe=maybe) -> str:
            value = maybe(name)
            if value is None:
                raise RowError(f"missing field {name}")
            return value

        try:
            rows.append(layout.map(get, maybe))
            wrong.append(None)
        except RowError as e:
            rows.append((None,) * 5)
            wrong.append(str(e))
    return [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.nulls(0, pa.string())] * 5, pa.array(wrong, pa.string())


def parse_batch(layout: Adapter, content: bytes, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> pa.RecordBatch:
    """Rows of RAW_ROW. Row numbers count records from 2, the first after the header."""
    if len(content) > max_bytes:
        raise SchemaError(f"file exceeds {max_bytes} bytes")
    csv.field_size_limit(max(csv.field_size_limit(), max_bytes))
    unread: dict[int, str] = {}
    plain = _plain_columns(content) if layout.columns else None
    if plain is not None:
        n = len(plain[0]) - 1
        if n > max_rows:
            raise SchemaError(f"too many data rows (max {max_rows})")
        number = np.arange(2, n + 2, dtype=np.int32)
        five, wrong = _by_columns(layout.columns, n, lambda k: plain[k].slice(1), _place([c[0].as_py() for c in plain], layout.required))
    else:
        text = content.decode("utf-8-sig", "surrogateescape")
        head, records, errors = _records(text, max_rows)
        n = len(records)
        place = _place(head, layout.required)
        number = np.arange(2, n + 2, dtype=np.int32)
        unread = {k: f"row {number[k]}: {e}" for k, e in errors.items()}
        if not text.isascii() and any("\udc80" <= c <= "\udcff" for c in text):  # bytes that no text has
            for k, r in enumerate(records):
                if any("\udc80" <= c <= "\udcff" for v in r for c in v):
                    unread[k], records[k] = f"row {number[k]}: invalid UTF-8", []
        column = lambda k: pa.array([r[k] if k < len(r) else None for r in records], pa.string())
        five, wrong = _by_columns(layout.columns, n, column, place) if layout.columns else _by_function(layout, records, place)
    numbers = pa.array(number)
    wrong = pc.if_else(pc.is_null(wrong), wrong, pc.binary_join_element_wise("parse error at row ", numbers.cast(pa.string()), ": ", pc.fill_null(wrong, ""), ""))
    if unread:
        wrong = pc.coalesce(pa.array([unread.get(k) for k in range(n)], pa.string()), wrong)
    good = pc.is_null(wrong)
    five = [pc.if_else(good, c, pa.scalar(None, pa.string())) for c in five]
    refs = pc.binary_join_element_wise(f"{layout.ref}:row:", numbers.cast(pa.string()), "").filter(good)
    ends = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), refs)
    return pa.RecordBatch.from_arrays([numbers, *five, lists, wrong], schema=_RAW)


def parse(layout: Adapter, content: bytes, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> Iterator[tuple]:
    """The rows of `parse_batch` as tuples."""
    batch = parse_batch(layout, content, max_bytes, max_rows)
    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


_SCHEMA = pa.schema([("source_path", pa.string()), ("source_sha256", pa.string()), *_RAW, ("schema_error", pa.string())])
RAW = f"source_path string, source_sha256 string, {RAW_ROW}, schema_error string"


def parsed(layout: Adapter, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over files (path, length, sha, content): their rows; a file that can't be read is one row with
    schema_error set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.to_pylist():
                try:
                    if one["length"] > max_bytes:
                        raise SchemaError(f"file exceeds {max_bytes} bytes")
                    rows, failed = parse_batch(layout, one["content"] or b"", max_bytes, max_rows), None
                except SchemaError as e:
                    rows, failed = pa.RecordBatch.from_pylist([{}], _RAW), f"invalid schema: {e}"
                for a in range(0, rows.num_rows, BATCH_ROWS):
                    part = rows.slice(a, BATCH_ROWS)
                    name = [pa.array([one[c]] * part.num_rows, pa.string()) for c in ("path", "sha")]
                    yield pa.RecordBatch.from_arrays([*name, *part.columns, pa.array([failed] * part.num_rows, pa.string())], schema=_SCHEMA)

    return run


def files_of(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What `parsed` takes of a frame of files. The content of one that is too large isn't handed on."""
    content = F.when(F.col("length") <= max_bytes, F.col("content"))
    return files.select("path", "length", F.sha2(content, 256).alias("sha"), content.alias("content"))


def read(spark: SparkSession, path: str, layout: Adapter, max_bytes: int = MAX_BYTES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Raw rows of all files at path, with source_path and source_sha256. A file that can't be read at all is one row, with
    schema_error set."""
    files = spark.read.format("binaryFile").load(path)
    return files_of(files, max_bytes).mapInArrow(parsed(layout, max_bytes, max_rows), RAW)


def report(raw: DataFrame) -> DataFrame:
    """ok_rows and error_rows of each source."""
    return raw.where("row_number is not null").groupBy("source_path").agg(F.count_if(F.col("parse_error").isNull()).alias("ok_rows"), F.count_if(F.col("parse_error").isNotNull()).alias("error_rows"))
