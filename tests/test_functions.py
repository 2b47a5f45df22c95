import datetime as dt
import uuid
from decimal import Decimal
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S


def values(spark, fn, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "n int, x string")
    return [r.y for r in df.orderBy("n").select(fn(F.col("x")).alias("y")).collect()]


def test_dates(spark):
    cases = {
        "2026-01-02": (2026, 1, 2),
        "01/02/26": (2026, 2, 1),
        "01/13/2026": (2026, 1, 13),
        "31/12/99": (2099, 12, 31),
        "01-02-26": (2001, 2, 26),
        "26/02/01": (2001, 2, 26),
        "29/02/00": (2000, 2, 29),
        "05-FEB-2026": (2026, 2, 5),
        "5 Feb 2026": (2026, 2, 5),
        "  2026/3/4\t": (2026, 3, 4),
        "30/02/2026": None,
        "01/02/20260": None,
        "not-a-date": None,
        "": None,
        None: None,
    }
    assert values(spark, S.parse_date, list(cases)) == [dt.date(*v) if v else None for v in cases.values()]


def test_amounts(spark):
    cases = {"-42.15": "-42.15", " 1,234.50 ": "1234.5", "+5": "5", ".5": "0.5", "5.": "5", "1e3": None, "--5": None, "-": None, "": None, "$5": None, "(5)": None, "0.12345678901": None, "0.1234567890": "0.123456789", None: None, "9" * 29: None}
    got = values(spark, S.parse_amount, list(cases))
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, S.amount_text, ["10.00", "+5", "007", "-.5", "5.", "1,000.10", "0"]) == ["10.00", "5", "7", "-0.5", "5", "1000.10", "0"]
    assert values(spark, S.canonical_amount, ["10.00", "100", "1.010", "-0.00", "0", "-5.50"]) == ["10", "100", "1.01", "0", "0", "-5.5"]
    assert values(spark, S.negated_text, ["1.50", "-1.50"]) == ["-1.50", "1.50"]


def test_merchants(spark):
    cases = {
        "AMZN MKTP US*ABC123": "amzn_mktp_us",
        "STARBUCKS STORE 12345": "starbucks_store_12345",
        "UBER *TRIP": "uber",
        "UPI-AMZN MKTP US*9XZ": "upiamzn_mktp_us9xz",
        "NEFT CR-SALARY-ACME": "neft_crsalaryacme",
        "NETFLIX.COM": "netflixcom",
        "*ABC123": "abc123",
        " a   b\t c ": "a_b_c",
        "漢字": "",
    }
    assert values(spark, S.merchant_key, list(cases)) == list(cases.values())
    assert values(spark, S.merchant_reasons, ["A  B*1234"]) == [["trim+uppercase", "collapse_whitespace", "strip_trailing_ref", "alnum_underscore_key"]]
    assert values(spark, S.merchant_reasons, ["A B"]) == [["trim+uppercase", "alnum_underscore_key"]]


def test_identity(spark):
    def brute(x):
        b = bytearray(sha256(x.encode()).digest()[:16])
        b[6], b[8] = b[6] & 0x0F | 0x80, b[8] & 0x3F | 0x80
        return str(uuid.UUID(bytes=bytes(b)))

    names = [f"v1|{i}" for i in range(50)]
    assert values(spark, S.uuid8, names) == [brute(x) for x in names]
    mark = S.fingerprint(F.lit("a"), F.lit("b"), F.lit("2026-01-02").cast("date"), F.lit("10.00"), F.lit("USD"), F.array(F.lit("r2"), F.lit("r1")), F.lit("m"))
    assert spark.range(1).select(mark).first()[0] == "v1|a|b|2026-01-02|10|USD|r1\x1fr2|m"


def test_accounts(spark):
    assert values(spark, S.account_id, [" Assets:Bank ", "a::b", ":a", "a:", "", "a b", "é", "x-1:y_2"]) == ["assets:bank", None, None, None, None, None, None, "x-1:y_2"]
    assert values(spark, S.commodity, [" usd ", "", "x" * 17, "é" * 8, "é" * 9]) == ["USD", None, None, "É" * 8, None]
    assert values(spark, S.account_type, ["assets:x", "liability", "other:y"]) == ["asset", "liability", None]
    assert values(spark, S.bean_account, ["assets:bank-x:1a"]) == ["Assets:Bank-x:1a"]
    assert values(spark, S.bean_string, ['a"b\\c']) == ['a\\"b\\\\c']
    assert values(spark, S.csv_field, ["a", "a,b", 'a"b', "a\nb", None]) == ["a", '"a,b"', '"a""b"', '"a\nb"', ""]
    assert values(spark, S.error_row, ["parse error at row 7: x", "Row 12", "none"]) == [7, 12, None]


def test_posting_literals(spark):
    got = values(spark, S.posting_literal, ["Assets:Cash=-6.50:usd", "a=1:b:USD", "nothing", "a=x:USD"])
    assert (got[0].account, got[0].amount, got[0].commodity) == ("assets:cash", Decimal("-6.5"), "USD")
    assert got[1].amount is None and got[2].account is None and got[3].amount is None


@pytest.mark.parametrize("kind", ["yaml", "json"])
def test_tags(spark, kind):
    tags = F.array(F.lit("seen"), F.lit("category:a"), F.lit("category:b"))
    row = spark.range(1).select(S.replace_category(tags, F.lit("c")).alias("new"), S.categories(tags).alias("own"), S.is_categorized(tags).alias("is")).first()
    assert row.new == ["seen", "category:c"] and row.own == ["a", "b"] and row["is"]
