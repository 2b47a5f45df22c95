"""Column functions of the ledger: text, dates, amounts, merchants, identities, accounts and tags.

All are built-in expressions. Those with steps that are needed more than once come in two forms: one over a DataFrame
(`with_...`), in which each step is a column of a projection of its own and all stays in generated code, and one of a
column, for use in any expression, in which `let` holds the steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import AMOUNT, POSTING

GENESIS = "0" * 64

#: What dates look like: three numbers, or a day, a month's name and a year.
DATE_LIKE = r"^\d{1,4}([-/])\d{1,2}\1\d{1,4}$|^\d{1,2}([ -])[A-Za-z]{3}\2\d{1,4}$"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(rows: DataFrame) -> DataFrame:
    """rows whose columns are computed once, and compiled apart from what comes after.

    A filter on a computed column is pushed below its projection, which computes the column again. It isn't pushed through a
    projection that isn't deterministic, which the number of the partition makes of this one. And projections over each other
    become one generated method, which the virtual machine interprets if it is too long. A higher-order function isn't in
    generated code, so a method ends here.
    """
    number = F.element_at(F.transform(F.array(F.spark_partition_id()), lambda n: n), 1)
    return rows.withColumn("_partition", number).where("_partition >= 0").drop("_partition")


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end. The ends are looked at first: most texts have none."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).otherwise(text)


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null if there is no such day. A year below 100 is one of this century."""
    year = F.when(year < 100, year + 2000).otherwise(year)
    month = F.when(month.between(1, 12), month)
    last = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.make_date(year, month, F.when(day.between(1, last), day))


def _parts(pieces: Column) -> dict[str, Column]:
    """The three numbers, of which the second may be a month's name, whether it is, and whether the outer ones are short."""
    at = lambda k: F.get(pieces, F.lit(k))
    place = F.instr(F.lit(MONTHS), F.lower(at(1)))
    named = F.length(at(1)) == 3
    return {
        "a": at(0).try_cast("int"),
        "b": F.when(named, F.when(place % 3 == 1, ((place + 2) / 3).cast("int"))).otherwise(at(1).try_cast("int")),
        "c": at(2).try_cast("int"),
        "named": named,
        "short_a": F.length(at(0)) <= 2,
        "short_c": F.length(at(2)) <= 2,
    }


def _date_of(x: Column, p: Callable[[str], Column]) -> Column:
    """The first layout that fits, in this order: with dashes year or day first, with slashes day, year or month first."""
    year_first = F.when(p("short_c") & ~p("named"), _day(p("a"), p("b"), p("c")))
    day_first = F.when(p("short_a"), _day(p("c"), p("b"), p("a")))
    month_first = F.when(p("short_a"), _day(p("c"), p("a"), p("b")))
    found = F.when(x.contains("/"), F.coalesce(day_first, year_first, month_first)).otherwise(F.coalesce(year_first, day_first))
    return F.when(x.rlike(DATE_LIKE), found)


def with_date(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with `name`, the date of their column `text`, or null."""
    cut = rows.withColumn("_x", trim_all(F.col(text))).withColumn("_p", F.split("_x", "[-/ ]"))
    cut = cut.withColumns({f"_{k}": c for k, c in _parts(F.col("_p")).items()})
    return cut.withColumn(name, _date_of(F.col("_x"), lambda k: F.col(f"_{k}"))).select(*rows.columns, name)


def parse_date(text: Column) -> Column:
    """A date, or null. Day before month where both fit."""
    held = lambda x, p: let(F.struct(*(c.alias(k) for k, c in _parts(p).items())), lambda s: _date_of(x, lambda k: s[k]))
    return let(trim_all(text), lambda x: let(F.split(x, "[-/ ]"), lambda p: held(x, p)))


def amount_digits(text: Column) -> Column:
    """The amount's text without blanks around it and commas."""
    return F.replace(trim_all(text), F.lit(","), F.lit(""))


def amount_of(digits: Column) -> Column:
    return F.when(digits.rlike(r"^[+-]?(\d+\.?\d{0,10}|\.\d{1,10})$"), digits.try_cast(AMOUNT))


def parse_amount(text: Column) -> Column:
    """An exact decimal, or null where it isn't a plain number of at most 10 fractional digits."""
    return let(amount_digits(text), amount_of)


def text_of_digits(digits: Column) -> Column:
    """In the scale it was written in: no plus sign, no needless zeros in front, a digit before the point, none at the end."""
    plain = F.regexp_replace(F.regexp_replace(digits, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(-?)\.", "$10."), r"\.$", "")
    return F.when(digits.rlike(r"^(\+|-?0\d|-?\.)|\.$"), plain).otherwise(digits)


def amount_text(text: Column) -> Column:
    """The amount as written."""
    return text_of_digits(amount_digits(text))


def canonical_amount(text: Column) -> Column:
    """Without zeros at the end of the fraction: 10.00 is 10."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.endswith("0") | text.endswith("."), F.when(bare == "-0", "0").otherwise(bare)).otherwise(text)


def decimal_text(amount: Column) -> Column:
    """A decimal column as canonical text."""
    return canonical_amount(amount.cast("string"))


def negated_text(text: Column) -> Column:
    return F.when(text.startswith("-"), F.substring(text, 2, 1 << 20)).otherwise(F.concat(F.lit("-"), text))


def commodity(code: Column) -> Column:
    """Upper-cased code of 1 to 16 bytes, or null."""
    upper = F.upper(trim_all(code))
    return F.when(F.octet_length(upper).between(1, 16), upper)


def account_id(text: Column) -> Column:
    """Lower-cased segments of a-z, 0-9, _ and - joined by colons, or null."""
    low = F.translate(trim_all(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(low.rlike(r"^[a-z0-9_-]+(:[a-z0-9_-]+)*$"), low)


# First segments of account ids, singular or plural, and the types they stand for.
ACCOUNT_TYPES = {
    "asset": "asset",
    "assets": "asset",
    "liability": "liability",
    "liabilities": "liability",
    "equity": "equity",
    "income": "income",
    "expense": "expense",
    "expenses": "expense",
}


def account_type(account: Column) -> Column:
    """The type that the first segment names, or null."""
    head = F.element_at(F.split(account, ":"), 1)
    out = F.lit(None).cast("string")
    for name, kind in ACCOUNT_TYPES.items():
        out = F.when(head == name, kind).otherwise(out)
    return out


def _collapsed(text: Column) -> Column:
    """Upper-cased and trimmed, with a blank for each run of white space; runs that are a blank aren't touched."""
    return F.regexp_replace(F.upper(trim_all(text)), r"(?U)\s{2,}|[^\S ]", " ")


def _without_reference(whole: Column) -> Column:
    return trim_all(F.regexp_replace(whole, r"[*#][A-Z0-9]{4,}$", ""))


def merchant_name(text: Column) -> Column:
    """Upper-cased name with single blanks, without a reference such as *ABC123 at its end unless that is all."""
    return let(_collapsed(text), lambda whole: let(_without_reference(whole), lambda b: F.when(b == "", whole).otherwise(b)))


def key_of_name(name: Column) -> Column:
    bare = F.trim(F.regexp_replace(name, r"[^A-Z0-9 ]+", ""))
    return F.lower(F.regexp_replace(bare, " +", "_"))


def merchant_key(text: Column) -> Column:
    """Lower-cased ASCII letters and digits of the name, words joined by underscores; it may be empty."""
    return key_of_name(merchant_name(text))


def with_merchant(rows: DataFrame, text: str, key: str, name: str = "_name") -> DataFrame:
    """rows with the merchant's name, if it is named, and key of their column `text`."""
    steps = rows.withColumn("_whole", _collapsed(F.col(text))).withColumn("_bare", _without_reference(F.col("_whole")))
    named = steps.withColumn(name, F.when(F.col("_bare") == "", F.col("_whole")).otherwise(F.col("_bare")))
    return named.withColumn(key, key_of_name(F.col(name))).drop("_whole", "_bare", "_name")


def merchant_reasons(text: Column) -> Column:
    """What was done to get the key, in order."""
    upper, whole = F.upper(trim_all(text)), _collapsed(text)
    steps = F.array(
        F.lit("trim+uppercase"),
        F.when(whole != upper, "collapse_whitespace"),
        F.when(merchant_name(text) != whole, "strip_trailing_ref"),
        F.lit("alnum_underscore_key"),
    )
    return F.array_compact(steps)


def fingerprint(adapter: Column, account: Column, date: Column, text: Column, code: Column, refs: Column, merchant: Column) -> Column:
    """The identity of an imported row: no clock and no batch is in it. text: the amount."""
    sorted_refs = F.array_join(F.array_sort(F.coalesce(refs, F.array().cast("array<string>"))), "\u001f")
    return F.concat_ws("|", F.lit("v1"), adapter, account, date.cast("string"), canonical_amount(text), code, sorted_refs, F.coalesce(merchant, F.lit("")))


def uuid8_of(h: Column) -> Column:
    """A UUID of version 8 from a SHA-256 in hexadecimal digits."""
    at = lambda start, n: F.substring(h, start, n)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))


def uuid8(text: Column) -> Column:
    """A UUID of version 8 from the first half of the SHA-256 of a text."""
    return let(F.sha2(text, 256), uuid8_of)


def bean_account(account: Column) -> Column:
    """Each segment with its first letter in upper case."""
    return F.array_join(F.transform(F.split(account, ":"), lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 20))), ":")


def bean_string(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def file_part(account: Column) -> Column:
    return F.replace(account, F.lit(":"), F.lit("_"))


def csv_field(text: Column) -> Column:
    """Quoted only where a comma, a quote or a line end is in it."""
    plain = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain.rlike('[,"\r\n]'), quoted).otherwise(plain)


def is_categorized(tags: Column) -> Column:
    return F.exists(tags, lambda t: t.startswith("category:"))


def replace_category(tags: Column, category: Column) -> Column:
    """tags with the category instead of any they have."""
    others = F.filter(tags, lambda t: ~t.startswith("category:"))
    return F.concat(others, F.array(F.concat(F.lit("category:"), category)))


def categories(tags: Column) -> Column:
    return F.transform(F.filter(tags, lambda t: t.startswith("category:")), lambda t: F.substring(t, 10, 1 << 20))


def refs_key(postings: Column) -> Column:
    """Memos that aren't empty, sorted and joined."""
    memos = F.filter(F.transform(postings, lambda p: p["memo"]), lambda m: m.isNotNull() & (m != ""))
    return F.array_join(F.array_sort(memos), ";")


def near_merchant(narration: Column, payee: Column) -> Column:
    """What dedupe compares: the narration if it isn't empty, else the payee's key."""
    return F.coalesce(F.when(narration != "", narration), merchant_key(payee))


def rule_text(narration: Column, payee: Column) -> Column:
    """What merchant rules look at: the narration, empty or not, else the payee in lower case."""
    return F.coalesce(narration, F.lower(payee))


def event_hash(prev: Column, event_id: Column, at: Column, kind: Column, payload: Column) -> Column:
    """The hash that seals an event; it holds the hash of the event before."""
    lines = [F.lit("v1"), *(F.concat(F.lit(f"{name}="), c) for name, c in (("prev", prev), ("id", event_id), ("at", at), ("kind", kind), ("payload", payload)))]
    return F.sha2(F.concat_ws("\n", *lines), 256)


def error_row(message: Column) -> Column:
    """The row number that a message names, or null."""
    return F.nullif(F.regexp_extract(F.lower(message), r"row\s*(\d+)", 1), F.lit("")).try_cast("long")


def posting(account: Column, amount: Column, text: Column, code: Column, memo: Column | None = None) -> Column:
    """A leg of a transaction."""
    return F.struct(account, amount, text, code, F.lit(None) if memo is None else memo).cast(POSTING)


def posting_literal(spec: Column) -> Column:
    """account=amount:commodity, split at the first = and the last colon; null fields where it isn't one."""
    part = lambda k: trim_all(F.regexp_extract(spec, "(?s)^([^=]*)=(.*):([^:]*)$", k))
    text = part(2)
    return posting(account_id(part(1)), parse_amount(text), amount_text(text), commodity(part(3)))
