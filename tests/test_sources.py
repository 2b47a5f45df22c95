import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.operators import convert
from tallyforge.sources import statements as A

GENERIC = "Date,Description,Amount,Currency,Balance\n2026-01-02,AMZN MKTP US*ABC123,-42.15,USD,957.85\n2026-01-03,STARBUCKS STORE 12345,-6.50,USD,951.35\n2026-01-05,ACME PAYROLL,2500.00,USD,3451.35\n2026-01-07,Amazon Marketplace,-42.15,USD,3409.20\n"
MALFORMED = "Date,Description,Amount\n2026-01-01,Good row,10.00\n2026-01-02,Missing amount,\n"
HDFC = "Date,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance\n01/02/26,UPI-AMZN MKTP US*9XZ,-,1299.00,1\n01/03/26,POS 4821 AMAZON MKTPLACE,1299.00,,2\n01/05/26,NEFT CR-SALARY-ACME,,75000.00,3\n"
CARD = "Transaction Date,Post Date,Description,Amount,Currency\n2026-02-01,2026-02-02,NETFLIX.COM,-15.99,USD\n2026-02-03,2026-02-04,UBER *TRIP,-18.40,USD\n2026-02-05,2026-02-06,PAYMENT THANK YOU,200.00,USD\n"
CUSTOM = "date,description,amount,currency\n2026-03-01,LOCAL CAFE,-320.00,INR\n2026-03-02,METRO CARD TOPUP,-500.00,INR\n"


def rows(name, text):
    return list(A.parse(A.adapter(name), text.encode()))


def counts(found):
    bad = sum(r[-1] is not None for r in found)
    return len(found) - bad, bad


def test_counts_of_samples():
    assert counts(rows("generic", GENERIC)) == (4, 0)
    assert counts(rows("generic_csv", MALFORMED)) == (1, 1)
    assert counts(rows("hdfc", HDFC)) == (3, 0)
    assert counts(rows("cc", CARD)) == (3, 0)
    assert counts(rows("custom", CUSTOM)) == (2, 0)
    assert rows("generic", MALFORMED)[1][-1] == "parse error at row 3: missing amount"


def test_two_column_amounts():
    got = rows("hdfc", HDFC)
    assert [(r[2], r[3]) for r in got] == [("1299.00", "INR"), ("-1299.00", "INR"), ("75000.00", "INR")]
    assert counts(rows("hdfc", "Date,Narration,Withdrawal Amt.,Deposit Amt.\n01/02/26,x,-,\n")) == (0, 1)
    assert rows("hdfc", "Date,Narration,Withdrawal Amt.,Deposit Amt.\n01/02/26,x,5,0.00\n")[0][2] == "0.00"
    short = rows("hdfc", "Date,Narration,Withdrawal Amt.,Deposit Amt.\n01/02/26,x\n01/02/26,x,5\n01/02/26\n")
    assert [(r[2], r[-1]) for r in short] == [(None, "parse error at row 2: missing amount"), ("-5", None), (None, "parse error at row 4: missing field Narration")]


def test_headers_and_short_records():
    with pytest.raises(A.SchemaError, match="missing required column 'Amount' \\(have: Date, Description\\)"):
        rows("generic", "Date,Description\n1,2\n")
    assert rows("generic", "AMOUNT,date,Description\n1,2026-01-01,x\n")[0][1:3] == ("2026-01-01", "1")
    assert rows("generic", "Date,Description,Amount\n2026-01-01,x\n")[0][-1] == "parse error at row 2: missing field Amount"
    assert rows("custom", "date,description,amount\n2026-01-01,x,\n")[0][-1] is None


def test_bytes_that_are_no_text():
    content = b"Date,Description,Amount\n2026-01-01,caf\xe9,1\n2026-01-02,ok,2\n"
    got = list(A.parse(A.adapter("generic"), content))
    assert [r[-1] for r in got] == ["row 2: invalid UTF-8", None]


def test_long_fields_and_plug_ins():
    long = "x" * 300_000
    got = rows("generic", f"Date,Description,Amount\n2026-01-01,{long},1\n")
    assert got[0][4] == long and got[0][-1] is None

    def mapped(get, maybe):
        if get("n") == "0":
            raise A.RowError("no n")
        return get("d"), get("n"), None, maybe("t"), None

    own = A.Adapter("own", "Own", ("d", "n"), "own", map=mapped)
    found = list(A.parse(own, b"d,n,t\n2026-01-01, 5 ,x\n\n2026-01-02,0\n2026-01-03\n"))
    assert found[0][:6] == (2, "2026-01-01", "5", None, "x", None) and found[0][6] == ["own:row:2"]
    assert [r[-1] for r in found] == [None, "parse error at row 3: no n", "parse error at row 4: missing field n"]


def test_caps():
    with pytest.raises(A.SchemaError, match="exceeds"):
        list(A.parse(A.adapter("generic"), b"x" * 11, max_bytes=10))
    with pytest.raises(A.SchemaError, match="too many"):
        list(A.parse(A.adapter("generic"), GENERIC.encode(), max_rows=3))
    assert A.adapter("nothing") is None


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=2000), st.text(max_size=400).map(str.encode), st.text(alphabet="Date,Description,Amount\n-1.\"", max_size=300).map(lambda s: ("Date,Description,Amount\n" + s).encode())))
def test_any_bytes(content):
    for layout in A.BUILTIN.values():
        try:
            found = list(A.parse(layout, content))
        except A.SchemaError:
            continue
        assert all(len(r) == 8 for r in found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab ,,,\n\n\r1.-é\u00a0", max_size=120), st.sampled_from(["Date,Description,Amount\n", "\n Amount ,date,Description\r\n", "\ufeffDate,Description,Amount,Currency\n"]))
def test_plain_files_read_alike_either_way(text, head):
    content = (head + text).encode()
    layout = A.adapter("generic")

    def tried():
        try:
            return list(A.parse(layout, content))
        except A.SchemaError as e:
            return str(e)

    quick = tried()
    plain, A._plain_columns = A._plain_columns, lambda content: None
    try:
        assert quick == tried()
    finally:
        A._plain_columns = plain


def test_plain_files_are_read_by_columns():
    assert A._plain_columns(GENERIC.encode()) is not None and A._plain_columns(b'a,"b"\n1,2\n') is None
    assert A._plain_columns(b"a,b\n1\n") is None and A._plain_columns(b"a,b\n\xff,2\n") is None


def test_read_and_convert(spark, tmp_path):
    for name, text in (("a.csv", GENERIC), ("b.csv", MALFORMED), ("c.csv", "Date,Description\n1,2\n"), ("d.csv", "Date,Description,Amount\nnot-a-date,x,1\n2026-01-01,x,0.00\n2026-01-01,x,abc\n")):
        (tmp_path / name).write_text(text)
    raw = A.read(spark, f"file://{tmp_path}", A.adapter("generic"))
    assert {(r.source_path[-5:], r.ok_rows, r.error_rows) for r in A.report(raw).collect()} == {("a.csv", 4, 0), ("b.csv", 1, 1), ("d.csv", 3, 0)}
    assert [r.schema_error for r in raw.where("schema_error is not null").collect()] == ["invalid schema: missing required column 'Amount' (have: Date, Description)"]
    out = convert.convert(raw.where("source_path like '%d.csv'"), "generic_csv", convert.Options("assets:bank", commodity="USD", batch_id="b"))
    got = {r.row_number: (r.parse_status, r.error) for r in convert.statement_rows(out, "generic_csv", convert.Options("assets:bank", batch_id="b")).collect()}
    assert got[2] == ("convert_error", 'unparseable date "not-a-date"') and got[3] == ("convert_error", "amount is zero") and got[4][0] == "convert_error"


def test_layouts_are_listed(spark):
    assert [r.id for r in A.adapters(spark).collect()] == ["generic_csv", "hdfc", "credit_card", "custom"]
