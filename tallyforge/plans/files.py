"""Queries that read statement files: the driver's rows are written as files of each layout and read by its adapter."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import statements
from .views import table

#: Records of a file, about.
FILE_ROWS = 20_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path, with its scheme, below the folder that driver and executors share (spark.checkpoint.dir); on one machine
    that names none, a local one. A folder named without a scheme is one of the default file system, as it is for Spark."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tallyforge-files")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.deleteOnExit(path)  # it goes with the application
    return store.makeQualified(path).toString()


def write(rows: DataFrame, head: str, path: str) -> str:
    """Writes rows (file, n, line) as text files, one for each number of a file, in the order of n, with head first."""
    spark = rows.sparkSession
    heads = rows.select("file").distinct().select("file", F.lit(None).cast(rows.schema["n"].dataType).alias("n"), F.lit(head).alias("line"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = rows.select("file", "n", "line").unionByName(heads)
    whole.repartition(parts, "file").sortWithinPartitions("file", "n").select("file", "line").write.partitionBy("file").text(path)
    return path


CUSTOM = statements.custom("when", "what", "how much", "cur", "left")

HEADS = {
    "generic_csv": "Date,Description,Amount,Currency,Balance",
    "hdfc": "Date , narration,Withdrawal Amt.,Deposit Amt.,Closing Balance",
    "credit_card": "Transaction Date,Post Date,Description,Amount,Currency",
    "custom": "left,cur,how much,what,when",
}


def lines(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """file, n and line: each line item as a record of a layout. Some have no amount, some lack fields, some are quoted."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    files = max(1, -(-rows.count() // FILE_ROWS))
    k = F.col("l_orderkey")
    date = F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    text = S.csv_field(F.concat(F.lit('part "'), F.col("l_partkey").cast("string"), F.lit('", '), F.col("l_returnflag")))
    amount = F.when(k % 89 == 0, " ").when(F.col("l_returnflag") == "R", F.concat(F.lit("-"), price)).otherwise(price)
    code = F.when(F.col("l_linenumber") % 2 == 0, "USD").otherwise("")
    # a withdrawal, a deposit, both, or neither
    paid = F.when(F.col("l_returnflag") == "R", price).otherwise("-")
    got = F.when((F.col("l_returnflag") == "N") | (k % 83 == 0), F.concat(F.lit(" "), price)).otherwise("")
    fields: dict[str, list[Column]] = {
        "generic_csv": [date, text, amount, code, F.lit("")],
        "hdfc": [date, text, paid, got, price],
        "credit_card": [date, F.lit("1999-01-01"), text, amount, code],
        "custom": [price, code, amount, text, date],
    }
    own = fields[layout]
    whole, short = F.concat_ws(",", *own), F.concat_ws(",", *own[:2])
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    return rows.select((k % files).alias("file"), order.alias("n"), F.when(k % 113 == 0, short).otherwise(whole).alias("line"))


def _mapped(get: statements.Fields, maybe: statements.Fields) -> tuple:
    """A record of the custom layout by a function: one without a currency is an error."""
    date = get("when")
    if not maybe("cur"):
        raise statements.RowError("no currency")
    return date, get("how much"), maybe("cur"), get("what"), None


#: A layout that isn't built in.
PLUG_IN = statements.Adapter("own", "Own layout", ("when", "how much", "what"), "own", map=_mapped)


def read(spark: SparkSession, sf_dir: str, layout: str, **caps) -> DataFrame:
    path = write(lines(spark, sf_dir, layout), HEADS[layout], scratch(spark, layout))
    adapter = CUSTOM if layout == "custom" else statements.adapter(layout)
    return statements.read(spark, path, adapter, **caps).withColumn("file", F.regexp_extract("source_path", r"file=(\d+)/", 1).cast("long"))


def rows_read(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    raw = read(spark, sf_dir, layout)
    return raw.select("file", "row_number", "date_raw", "amount_raw", "currency_raw", "description_raw", "balance_raw", F.array_join("source_refs", ",").alias("refs"), "parse_error")


def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files over a cap on records, on bytes, or without a column say."""
    said = lambda raw, kind: raw.where("schema_error is not null").select(F.lit(kind).alias("cap"), "file", "schema_error")
    path = write(lines(spark, sf_dir, "custom"), HEADS["custom"], scratch(spark, "other"))
    other = statements.read(spark, path, statements.adapter("generic")).withColumn("file", F.regexp_extract("source_path", r"file=(\d+)/", 1).cast("long"))
    return said(read(spark, sf_dir, "generic_csv", max_rows=1000), "rows").unionByName(said(read(spark, sf_dir, "generic_csv", max_bytes=5000), "bytes")).unionByName(said(other, "column"))


def lookup(spark: SparkSession) -> DataFrame:
    """The adapter that each name stands for, if any."""
    names = ("generic", "generic_csv", "hdfc", "cc", "credit_card", "custom", "none")
    found = [(n, getattr(statements.adapter(n), "id", None)) for n in names]
    asked = spark.createDataFrame(found, "asked string, id string")
    return asked.join(statements.adapters(spark), "id", "left").select("asked", "id", "name")


_F = f"(SELECT greatest(1, CAST(ceil(count(*) / {FILE_ROWS}.0) AS BIGINT)) FROM lineitem)"
_RECORDS = f"""WITH b AS (
  SELECT l_orderkey % {_F} AS file, l_orderkey AS k, l_linenumber AS m, strftime(l_shipdate,'%Y-%m-%d') AS date, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, l_returnflag AS flag,
    'part "'||l_partkey||'", '||l_returnflag AS text, CASE WHEN l_linenumber%2=0 THEN 'USD' ELSE '' END AS code, l_orderkey%113=0 AS short, l_partkey, l_extendedprice, l_shipdate FROM lineitem),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file ORDER BY k, m, l_partkey, l_extendedprice, l_shipdate, flag)+1 AS INTEGER) AS row_number, CASE WHEN k%89=0 THEN '' WHEN flag='R' THEN '-'||price ELSE price END AS amount FROM b)"""


def _sql(ref: str, amount: str, code: str, text: str, balance: str, error: str) -> str:
    """Rows of a layout; error: what is wrong with one, null if nothing is."""
    null = lambda x: f"CASE WHEN wrong IS NULL THEN {x} END"
    return f"""{_RECORDS}, w AS (SELECT *, {error} AS wrong FROM r) SELECT file, row_number, {null("date")} AS date_raw, {null(amount)} AS amount_raw, {null(code)} AS currency_raw, {null(text)} AS description_raw, {null(balance)} AS balance_raw,
      CASE WHEN wrong IS NULL THEN '{ref}:row:'||row_number ELSE '' END AS refs, 'parse error at row '||row_number||': '||wrong AS parse_error FROM w"""


QUERIES = {
    "source_generic": (
        lambda s, d: rows_read(s, d, "generic_csv"),
        _sql("generic", "amount", "code", "text", "''", "CASE WHEN short THEN 'missing field Amount' WHEN amount='' THEN 'missing amount' END"),
    ),
    "hdfc_amount": (
        lambda s, d: rows_read(s, d, "hdfc"),
        _sql("hdfc", "CASE WHEN flag='N' OR k%83=0 THEN price ELSE '-'||price END", "'INR'", "text", "price", "CASE WHEN short OR (flag<>'R' AND flag<>'N' AND k%83<>0) THEN 'missing amount' END"),
    ),
    "source_credit_card": (
        lambda s, d: rows_read(s, d, "credit_card"),
        _sql("cc", "amount", "code", "text", "CAST(NULL AS VARCHAR)", "CASE WHEN short THEN 'missing field Amount' WHEN amount='' THEN 'missing amount' END"),
    ),
    "source_custom": (
        lambda s, d: rows_read(s, d, "custom"),
        _sql("custom", "amount", "code", "text", "price", "CASE WHEN short THEN 'missing field when' END"),
    ),
    "source_plug_in": (
        lambda s, d: statements.read(s, write(lines(s, d, "custom"), HEADS["custom"], scratch(s, "own")), PLUG_IN).select(F.regexp_extract("source_path", r"file=(\d+)/", 1).cast("long").alias("file"), "row_number", "date_raw", "amount_raw", "currency_raw", "description_raw", "balance_raw", F.array_join("source_refs", ",").alias("refs"), "parse_error"),
        _sql("own", "amount", "code", "text", "CAST(NULL AS VARCHAR)", "CASE WHEN short THEN 'missing field when' WHEN code='' THEN 'no currency' END"),
    ),
    "source_counts": (
        lambda s, d: statements.report(read(s, d, "generic_csv")).select(F.regexp_extract("source_path", r"file=(\d+)/", 1).cast("long").alias("file"), "ok_rows", "error_rows"),
        f"{_RECORDS} SELECT file, count(*) FILTER (NOT short AND amount<>'') AS ok_rows, count(*) FILTER (short OR amount='') AS error_rows FROM r GROUP BY file",
    ),
    "source_caps": (
        caps,
        f"""{_RECORDS}, l AS (SELECT file, short, length(date||',"part ""'||replace(text[7:],'"','""')||'"'||CASE WHEN short THEN '' ELSE ','||CASE WHEN k%89=0 THEN ' ' ELSE amount END||','||code||',' END)+1 AS bytes FROM r),
n AS (SELECT file, count(*) AS rows, sum(bytes)+{len(HEADS["generic_csv"]) + 1} AS bytes FROM l GROUP BY file)
SELECT 'rows' AS cap, file, 'invalid schema: too many data rows (max 1000)' AS schema_error FROM n WHERE rows>1000
UNION ALL SELECT 'bytes', file, 'invalid schema: file exceeds 5000 bytes' FROM n WHERE bytes>5000
UNION ALL SELECT 'column', file, 'invalid schema: missing required column ''Date'' (have: left, cur, how much, what, when)' FROM n""",
    ),
    "source_adapters": (
        lambda s, d: lookup(s),
        """SELECT asked, id, name FROM (VALUES ('generic','generic_csv'),('generic_csv','generic_csv'),('hdfc','hdfc'),('cc','credit_card'),('credit_card','credit_card'),('custom','custom'),('none',NULL)) a(asked,id)
        LEFT JOIN (VALUES ('generic_csv','Generic CSV'),('hdfc','HDFC CSV'),('credit_card','Credit card CSV'),('custom','Custom column mapping')) b(id,name) USING (id)""",
    ),
}
