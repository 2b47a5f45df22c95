"""Ledger shapes derived from the driver's tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import convert

BANK = "assets:bank:checking"
STATEMENT = convert.Options(BANK, commodity="INR", batch_id="b1")
CURRENCIES = ("ZAR", "USD", "JPY", "EUR", "AED")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_id(key: Column) -> Column:
    return S.uuid8(F.concat(F.lit("v1|orders|"), key.cast("string")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each order: receivables against sales or refunds, in a currency for each region."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    amount = F.when(F.col("o_orderstatus") == "F", -amount).otherwise(amount)
    code = F.element_at(F.array(*map(F.lit, CURRENCIES)), F.col("n_regionkey").cast("int") + 1)
    key = F.col("o_orderkey")
    rows = rows.select(key, _order_id(key).alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("c_name").alias("payee"), F.lower("c_mktsegment").alias("segment"), amount.alias("amount"), code.alias("code"), "o_orderpriority")
    own = S.posting(F.concat(F.lit("assets:receivable:"), F.col("segment")), F.col("amount"), F.col("amount").cast("string"), F.col("code"), F.concat(F.lit("order:"), key.cast("string")))
    other = S.posting(F.when(F.col("amount") < 0, "expenses:refunds").otherwise("income:sales"), -F.col("amount"), (-F.col("amount")).cast("string"), F.col("code"))
    return rows.select(
        "id",
        "date",
        "payee",
        S.merchant_key(F.col("payee")).alias("narration"),
        F.when(key % 7 != 0, F.concat(F.lit("batch-"), (key % 5).cast("string"))).alias("import_batch_id"),
        F.when(key % 50 == 0, _order_id(F.lit(1))).alias("duplicate_of"),
        F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("category:income:urgent"), F.lit("seen"))).otherwise(F.array(F.lit("seen"))).alias("tags"),
        F.concat(F.lit("v1|orders|"), key.cast("string")).alias("row_fingerprint"),
        F.array(own, other).alias("postings"),
    )


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw statement row for each line item, in five date layouts, with amounts that can't be read among them."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    rows = rows.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    k, d = F.col("l_orderkey"), F.col("l_shipdate").cast("date")
    kind = F.col("l_linenumber") % 5
    layouts = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy")
    date = F.date_format(d, layouts[0])
    for i, layout in enumerate(layouts[1:], 1):
        date = F.when(kind == i, F.date_format(d, layout)).otherwise(date)
    price = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    amount = F.when(k % 89 == 0, "").when(k % 83 == 0, "0.00").when(F.col("l_returnflag") == "R", F.concat(F.lit("-"), price)).otherwise(price)
    tail = F.when(F.col("l_partkey") % 4 == 0, " *ABC1234").when(F.col("l_partkey") % 4 == 1, "  #99").otherwise("")
    number = k * 10 + F.col("l_linenumber")
    return rows.select(
        number.cast("int").alias("row_number"),
        F.when(k % 97 == 0, "not-a-date").otherwise(date).alias("date_raw"),
        amount.alias("amount_raw"),
        F.when(F.col("l_linenumber") % 3 == 1, " usd ").when(F.col("l_linenumber") % 3 == 2, "EUR").alias("currency_raw"),
        F.concat("p_name", tail).alias("description_raw"),
        F.lit(None).cast("string").alias("balance_raw"),
        F.array(F.concat(F.lit("stmt:row:"), number.cast("string"))).alias("source_refs"),
        F.when(k % 101 == 0, F.concat(F.lit("parse error at row "), number.cast("string"), F.lit(": missing amount"))).alias("parse_error"),
    )


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.convert(statement(spark, sf_dir), "stmt", STATEMENT)


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction for each event: one unit from a user for a kind of event, some with references."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ref = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("row:"), (F.col("event_id") % 7).cast("string")))
    own = S.posting(F.concat(F.lit("assets:user:"), F.col("user_id").cast("string")), F.lit(1), F.lit("1.00"), F.lit("USD"), ref)
    other = S.posting(F.lit("expenses:use"), F.lit(-1), F.lit("-1.00"), F.lit("USD"))
    null = F.lit(None).cast("string")
    return e.select(
        S.uuid8(F.concat(F.lit("v1|events|"), F.col("event_id").cast("string"))).alias("id"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("payee"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("narration"),
        null.alias("import_batch_id"),
        F.when(F.col("event_id") % 40 == 0, S.uuid8(F.lit("v1|events|1"))).alias("duplicate_of"),
        F.array().cast("array<string>").alias("tags"),
        null.alias("row_fingerprint"),
        F.array(own, other).alias("postings"),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log over the orders: each is posted; some get a category, some of these another, some are linked."""
    t = transactions(spark, sf_dir).withColumn("k", F.substring("row_fingerprint", 11, 20).cast("long"))
    t = t.withColumn("duplicate_of", F.lit(None).cast("string"))
    body = F.to_json(F.struct(*[c for c in t.columns if c != "k"]), {"ignoreNullFields": "false"})
    tagged = lambda c: F.to_json(F.struct(F.col("id").alias("transaction_id"), F.lit(c).alias("category"), F.lit("r").alias("rule_id"), F.lit(90).alias("confidence"), F.array(F.lit("payee_regex=x")).alias("reasons")))
    linked = F.to_json(F.struct(F.col("id").alias("duplicate_id"), _order_id(F.lit(1)).alias("survivor_id"), F.lit("exact").alias("strategy"), F.lit("same").alias("explanation")))
    events = F.array(
        F.struct(F.lit(0).alias("n"), F.lit("posted").alias("kind"), F.to_json(F.struct(body.alias("transaction"))).alias("payload_json")),
        F.when(F.col("k") % 3 == 0, F.struct(F.lit(1).alias("n"), F.lit("categorized").alias("kind"), tagged("expenses:a").alias("payload_json"))),
        F.when(F.col("k") % 6 == 0, F.struct(F.lit(2).alias("n"), F.lit("categorized").alias("kind"), tagged("expenses:b").alias("payload_json"))),
        F.when(F.col("k") % 10 == 0, F.struct(F.lit(3).alias("n"), F.lit("deduped").alias("kind"), linked.alias("payload_json"))),
    )
    rows = t.select("k", F.explode(F.array_compact(events)).alias("e"))
    seq = F.col("k") * 4 + F.col("e.n")
    return rows.select(seq.alias("seq"), S.uuid8(F.concat(F.lit("v1|log|"), seq.cast("string"))).alias("id"), F.lit("2026-01-01T00:00:00+00:00").alias("at"), "e.kind", "e.payload_json", F.sha2(seq.cast("string"), 256).alias("content_hash"), F.lit(S.GENESIS).alias("prev_hash"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a chain by event_id, broken at every thousandth."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    hashed = lambda k: F.sha2(k.cast("string"), 256)
    k = F.col("event_id")
    prev = F.when(k % 1000 == 999, "?").when(k == 0, S.GENESIS).otherwise(hashed(k - 1))
    return e.select((k + 1).alias("seq"), F.lit("i").alias("id"), F.lit("t").alias("at"), F.lit("posted").alias("kind"), F.col("props").alias("payload_json"), hashed(k).alias("content_hash"), prev.alias("prev_hash"))


