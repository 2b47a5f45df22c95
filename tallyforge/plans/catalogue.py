"""Queries over the driver's tables, one or more for each operator, each with the SQL that DuckDB answers it by."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import convert, dedupe, events, export, importing, ledger, reconcile, rules
from . import files, workspace
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]

ACCOUNT, CODE, AS_OF = "assets:receivable:building", "EUR", "1997-06-30"

RULES = [
    rules.Rule("urgent-big", "income:large", 20, merchant_regex="(?i)customer", min_amount="300000"),
    rules.Rule("refund", "expenses:returns", 15, account_regex="^expenses:", max_amount="200000"),
    rules.Rule("fives", "income:fives", 10, payee_regex="5$", confidence=85),
    rules.Rule("also-fives", "income:others", 10, payee_regex="55$"),
    rules.Rule("ends-in-seven", "income:sevens", 5, payee_regex="7$", min_amount="1,000", max_amount="150000.50"),
    rules.Rule("named", "income:named", 4, payee_regex=r"(?P<who>Customer)#\d*1$"),
    rules.Rule("letters", "income:letters", 3, payee_regex=r"^\p{L}+#(?i)[[:digit:]]*(?:3|X)$"),
    rules.Rule("broken", "none", 99, payee_regex="("),
    rules.Rule("reference", "none", 98, payee_regex=r"(C).*\1"),
    rules.Rule("look-around", "none", 98, payee_regex="(?=C)"),
    rules.Rule("no-number", "none", 97, min_amount="many"),
    rules.Rule("empty", "none", 96),
]


# Pieces of SQL.


def _uuid8(text: str) -> str:
    h = f"sha256({text})"
    return f"(substr({h},1,8)||'-'||substr({h},9,4)||'-8'||substr({h},14,3)||'-'||substr('89ab',1+(strpos('0123456789abcdef',substr({h},17,1))-1)%4,1)||substr({h},18,3)||'-'||substr({h},21,12))"


def _name(x: str) -> str:
    whole = rf"regexp_replace(upper(replace(regexp_replace({x},'^\s+|\s+$','','g'),'ß','ss')),'\s+',' ','g')"
    bare = f"trim(regexp_replace({whole},'[*#][A-Z0-9]{{4,}}$',''))"
    return f"(CASE WHEN {bare}='' THEN {whole} ELSE {bare} END)"


def _key(x: str) -> str:
    return f"lower(regexp_replace(trim(regexp_replace({_name(x)},'[^A-Z0-9 ]','','g')),' +','_','g'))"


def _canonical(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x},'(\.\d*?)0+$','\1'),'\.$','')"


_T = f"""t AS (
  SELECT o_orderkey AS k, {_uuid8("'v1|orders|'||o_orderkey")} AS id, CAST(o_orderdate AS DATE) AS date, c_name AS payee, {_key("c_name")} AS narration,
    'assets:receivable:'||lower(c_mktsegment) AS account, list_value('ZAR','USD','JPY','EUR','AED')[n_regionkey+1] AS commodity,
    CASE WHEN o_orderstatus='F' THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
    CASE WHEN o_orderstatus='F' THEN 'expenses:refunds' ELSE 'income:sales' END AS other,
    CASE WHEN o_orderkey%7<>0 THEN 'batch-'||(o_orderkey%5) END AS batch,
    CASE WHEN o_orderkey%50=0 THEN {_uuid8("'v1|orders|1'")} END AS dup,
    CASE WHEN o_orderpriority LIKE '1%' THEN ['category:income:urgent','seen'] ELSE ['seen'] END AS tags
  FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)"""
_P = """p AS (
  SELECT id, k, date, payee, dup, batch, 0 AS ordinal, account, amount, commodity, 'order:'||k AS memo FROM t
  UNION ALL SELECT id, k, date, payee, dup, batch, 1, other, -amount, commodity, NULL FROM t)"""
_TP = f"WITH {_T}, {_P} "

_BAD = "l_orderkey%97=0"
_S = f"""s AS (
  SELECT l_orderkey*10+l_linenumber AS n,
    CASE WHEN {_BAD} THEN 'not-a-date' ELSE list_value(strftime(l_shipdate,'%Y-%m-%d'),strftime(l_shipdate,'%d/%m/%Y'),strftime(l_shipdate,'%d-%m-%Y'),strftime(l_shipdate,'%Y/%m/%d'),strftime(l_shipdate,'%d %b %Y'))[l_linenumber%5+1] END AS date_raw,
    CASE WHEN l_orderkey%89=0 THEN '' WHEN l_orderkey%83=0 THEN '0.00' WHEN l_returnflag='R' THEN '-'||format('{{:,.2f}}', l_extendedprice) ELSE format('{{:,.2f}}', l_extendedprice) END AS amount_raw,
    CASE WHEN l_linenumber%3=1 THEN ' usd ' WHEN l_linenumber%3=2 THEN 'EUR' END AS currency_raw,
    p_name||CASE WHEN l_partkey%4=0 THEN ' *ABC1234' WHEN l_partkey%4=1 THEN '  #99' ELSE '' END AS description_raw,
    CASE WHEN l_orderkey%101=0 THEN 'parse error at row '||(l_orderkey*10+l_linenumber)||': missing amount' END AS parse_error
  FROM lineitem JOIN part ON l_partkey=p_partkey),
c AS (
  SELECT *, CAST(coalesce(try_strptime(date_raw,'%Y-%m-%d'),try_strptime(date_raw,'%d/%m/%Y'),try_strptime(date_raw,'%d-%m-%Y'),try_strptime(date_raw,'%Y/%m/%d'),try_strptime(date_raw,'%d %b %Y')) AS DATE) AS date,
    replace(amount_raw,',','') AS amount_text, TRY_CAST(replace(amount_raw,',','') AS DECIMAL(38,10)) AS amount, coalesce(upper(trim(currency_raw)),'INR') AS commodity, {_key("description_raw")} AS narration FROM s),
e AS (
  SELECT *, CASE WHEN parse_error IS NOT NULL THEN NULL WHEN date IS NULL THEN 'unparseable date "'||date_raw||'"' WHEN amount IS NULL THEN 'invalid money amount: '||amount_raw||': not a decimal' WHEN amount=0 THEN 'amount is zero' END AS error FROM c),
f AS (
  SELECT *, CASE WHEN error IS NULL AND parse_error IS NULL THEN 'v1|stmt|{V.BANK}|'||date||'|'||{_canonical("amount_text")}||'|'||commodity||'|stmt:row:'||n||'|'||narration END AS fp FROM e),
r AS (
  SELECT 'b1' AS batch_id, n, fp, CASE WHEN parse_error IS NOT NULL THEN 'parse_error' WHEN error IS NOT NULL THEN 'convert_error' ELSE 'ok' END AS status, coalesce(parse_error, error) AS error, CASE WHEN fp IS NOT NULL THEN {_uuid8("fp")} END AS id FROM f),
rows AS (
  SELECT * FROM r WHERE status<>'parse_error' UNION ALL
  SELECT DISTINCT ON (batch_id, n) * FROM r WHERE status='parse_error' AND n NOT IN (SELECT n FROM r WHERE status<>'parse_error'))"""
_SR = f"WITH {_S} "

_D = f"""d AS (
  SELECT {_uuid8("'v1|events|'||event_id")} AS id, CAST(ts AS DATE) AS date, 'assets:user:'||user_id AS account, event_type AS merchant,
    CASE WHEN event_id%3=0 THEN 'row:'||(event_id%7) ELSE '' END AS refs, event_id FROM events WHERE event_id%40<>0),
x AS (SELECT *, min(id) OVER g AS survivor, row_number() OVER (PARTITION BY date,account,merchant,refs ORDER BY id) AS rank FROM d WINDOW g AS (PARTITION BY date,account,merchant,refs))"""


def _near(days: int) -> str:
    return f"""SELECT b.id AS duplicate_id, arg_min(a.id,(a.date,a.id)) AS survivor_id, 'near_window' AS strategy, CAST(85 AS INTEGER) AS confidence,
  'same account+amount+merchant; dates '||min(a.date)||' and '||any_value(b.date)||' within {days} day(s)' AS explanation
  FROM x a JOIN x b ON a.account=b.account AND a.merchant=b.merchant AND (a.date,a.id)<(b.date,b.id) AND b.date-a.date<={days}
    AND NOT (a.date=b.date AND a.refs<>'' AND b.refs<>'' AND a.refs<>b.refs)
  WHERE a.rank=1 AND b.rank=1 GROUP BY b.id"""


_EXACT = """SELECT id AS duplicate_id, survivor AS survivor_id, 'exact' AS strategy, CAST(100 AS INTEGER) AS confidence,
  'same date+account+amount+commodity+merchant+source_refs as '||survivor AS explanation FROM x WHERE rank>1"""

_R = rf"""{_T}, m AS (
  SELECT *, abs(amount) AS size, list_filter([
    CASE WHEN regexp_matches(narration,'(?i)customer') AND abs(amount)>=300000 THEN {{'at':0,'p':20,'id':'urgent-big','c':'income:large','f':80}} END,
    CASE WHEN regexp_matches(other,'^expenses:') AND abs(amount)<=200000 THEN {{'at':1,'p':15,'id':'refund','c':'expenses:returns','f':80}} END,
    CASE WHEN regexp_matches(payee,'5$') THEN {{'at':2,'p':10,'id':'fives','c':'income:fives','f':85}} END,
    CASE WHEN regexp_matches(payee,'55$') THEN {{'at':3,'p':10,'id':'also-fives','c':'income:others','f':80}} END,
    CASE WHEN regexp_matches(payee,'7$') AND abs(amount)>=1000 AND abs(amount)<=150000.50 THEN {{'at':4,'p':5,'id':'ends-in-seven','c':'income:sevens','f':80}} END,
    CASE WHEN regexp_matches(payee,'(?P<who>Customer)#\d*1$') THEN {{'at':5,'p':4,'id':'named','c':'income:named','f':80}} END,
    CASE WHEN regexp_matches(payee,'^\p{{L}}+#(?i)[[:digit:]]*(?:3|X)$') THEN {{'at':6,'p':3,'id':'letters','c':'income:letters','f':80}} END], lambda h: h IS NOT NULL) AS hits FROM t),
v AS (SELECT *, list_filter(hits, lambda h: h.p=list_max(list_transform(hits, lambda y: y.p))) AS top FROM m),
o AS (SELECT *, CASE WHEN dup IS NOT NULL THEN 'duplicate' WHEN tags[1]='category:income:urgent' THEN 'skipped' WHEN len(hits)=0 THEN 'unmatched'
  WHEN len(list_distinct(list_transform(top, lambda h: h.c)))>1 THEN 'conflict' ELSE 'applied' END AS outcome FROM v)"""

_L = f"""{_TP.removeprefix("WITH ")}, l AS (
  SELECT CASE WHEN date>DATE '{AS_OF}' THEN 'after_as_of' WHEN dup IS NOT NULL THEN 'skipped_duplicate' ELSE 'matched' END AS bucket, date, id AS transaction_id, payee, CAST(sum(amount) AS DECIMAL(38,10)) AS amount
  FROM p WHERE account='{ACCOUNT}' AND commodity='{CODE}' GROUP BY date, id, payee, dup)"""

_JSON_ROW = """'{"id":"'||id||'","date":"'||date||'","payee":"'||payee||'","narration":"'||narration||'","import_batch_id":null,"duplicate_of":'||coalesce('"'||dup||'"','null')
  ||',"tags":['||list_aggregate(list_transform(tags, lambda x: '"'||x||'"'),'string_agg',',')||'],"row_fingerprint":"v1|orders|'||k||'","postings":[{"account":"'||account||'","amount":'||CAST(amount AS DECIMAL(38,10))||',"amount_text":"'||amount||'","commodity":"'||commodity||'","memo":"order:'||k
  ||'"},{"account":"'||other||'","amount":'||CAST(-amount AS DECIMAL(38,10))||',"amount_text":"'||(-amount)||'","commodity":"'||commodity||'","memo":null}]}'"""

_BEAN = "list_aggregate(list_transform(string_split({0},':'), lambda s: upper(s[1])||s[2:]),'string_agg',':')"


def _from_files(spark: SparkSession) -> list[rules.Rule]:
    """RULES, half of them by way of YAML and half by way of JSON."""
    listed = [{k: v for k, v in vars(r).items() if v is not None} | {"note": "not a field"} for r in RULES]
    folder = tempfile.mkdtemp()  # the driver writes and reads it
    for name, part in (("rules.yaml", listed[:4]), ("rules.json", listed[4:])):
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            json.dump({"rules": part}, f)  # which is YAML as well
    return rules.load_file(f"{folder}/rules.yaml") + rules.load_file(f"{folder}/rules.json")


def _wanted_links(spark: SparkSession, d: str) -> DataFrame:
    """For each event a link, of which some may not be made."""
    e = V.table(spark, d, "events").select("event_id")
    own = S.uuid8(F.concat(F.lit("v1|events|"), F.col("event_id").cast("string")))
    kind = F.col("event_id") % 4
    target = F.when(kind == 0, own).when(kind == 1, "nothing").otherwise(S.uuid8(F.lit("v1|events|1")))
    return e.select(F.when(kind == 3, F.concat(F.lit("none-"), F.col("event_id").cast("string"))).otherwise(own).alias("duplicate_id"), target.alias("survivor_id"))


def _statement_rows(spark: SparkSession, d: str) -> DataFrame:
    return convert.statement_rows(V.converted(spark, d), "stmt", V.STATEMENT)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    return rules.evaluate(V.transactions(spark, d), RULES)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.lines(V.transactions(spark, d), ACCOUNT, CODE, AS_OF)


def _known(t: DataFrame) -> DataFrame:
    return t.where("pmod(cast(substring(row_fingerprint, 11) as long), 3) = 0")


def _replayed(spark: SparkSession, d: str, seq: int | None) -> DataFrame:
    t = events.replay(V.log(spark, d), seq)
    return t.select("id", "date", "duplicate_of", F.array_join("tags", ",").alias("tags"), F.size("postings").alias("n_postings"), F.col("postings")[0]["amount"].alias("amount"))


def _replayed_sql(seq: int | None) -> str:
    seen = lambda n: f"k*4+{n}<={seq}" if seq is not None else "true"
    cat = f"CASE WHEN k%6=0 AND {seen(2)} THEN 'expenses:b' WHEN k%3=0 AND {seen(1)} THEN 'expenses:a' END"
    return f"""WITH {_T}, u AS (SELECT *, {cat} AS cat FROM t WHERE {seen(0)})
      SELECT id, date, CASE WHEN k%10=0 AND {seen(3)} THEN {_uuid8("'v1|orders|1'")} END AS duplicate_of,
        list_aggregate(CASE WHEN cat IS NULL THEN tags ELSE list_filter(tags, lambda x: NOT starts_with(x,'category:'))||['category:'||cat] END,'string_agg',',') AS tags,
        CAST(2 AS INTEGER) AS n_postings, CAST(amount AS DECIMAL(38,10)) AS amount FROM u"""


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return S.with_date(V.statement(spark, d).select("row_number", "date_raw"), "date_raw", "date")


def _why(spark: SparkSession, d: str) -> DataFrame:
    key = V.table(spark, d, "orders").agg(F.max(F.when(F.col("o_orderkey") % 30 == 0, F.col("o_orderkey"))).alias("k")).first().k
    tx = spark.range(1).select(S.uuid8(F.lit(f"v1|orders|{key}")).alias("id")).first().id
    return events.why(V.log(spark, d), V.transactions(spark, d), tx)


_WHY_SQL = f"""WITH {_T}, w AS (SELECT * FROM t WHERE k=(SELECT max(o_orderkey) FROM orders WHERE o_orderkey%30=0))
SELECT CAST(k*4 AS BIGINT) AS seq, 'posted' AS kind, 'posted payee='||payee||' date='||date||' postings=2' AS summary FROM w
UNION ALL SELECT k*4+1, 'categorized', 'categorized expenses:a rule=r conf=90 reasons=payee_regex=x' FROM w
UNION ALL SELECT k*4+2, 'categorized', 'categorized expenses:b rule=r conf=90 reasons=payee_regex=x' FROM w
UNION ALL SELECT k*4+3, 'deduped', 'deduped '||id||' -> '||{_uuid8("'v1|orders|1'")}||' (exact) same' FROM w"""

#: Name to query and SQL.
CATALOGUE: dict[str, tuple[Query, str]] = {
    "balance_by_account": (
        lambda s, d: ledger.balances(V.transactions(s, d)),
        _TP + "SELECT account AS account_id, commodity, CAST(sum(amount) AS DECIMAL(38,10)) AS balance FROM p WHERE dup IS NULL GROUP BY ALL",
    ),
    "balance_one_account": (
        lambda s, d: ledger.balance(V.transactions(s, d), ACCOUNT, CODE),
        _TP + f"SELECT '{ACCOUNT}' AS account_id, '{CODE}' AS commodity, CAST(coalesce(sum(amount),0) AS DECIMAL(38,10)) AS balance FROM p WHERE dup IS NULL AND account='{ACCOUNT}' AND commodity='{CODE}'",
    ),
    "balance_absent_account": (
        lambda s, d: ledger.balance(V.transactions(s, d), "assets:none", "USD"),
        "SELECT 'assets:none' AS account_id, 'USD' AS commodity, CAST(0 AS DECIMAL(38,10)) AS balance",
    ),
    "postings_flat": (
        lambda s, d: ledger.postings(V.transactions(s, d)).select("transaction_id", "ordinal", "account_id", "amount", "commodity", "memo"),
        _TP + "SELECT id AS transaction_id, CAST(ordinal AS INTEGER) AS ordinal, account AS account_id, CAST(amount AS DECIMAL(38,10)) AS amount, commodity, memo FROM p",
    ),
    "snapshot_join": (
        lambda s, d: ledger.with_postings(V.transactions(s, d).select("id", "date"), ledger.postings(V.transactions(s, d))).select("id", "date", F.col("postings")[0]["account"].alias("first"), F.col("postings")[1]["account"].alias("second")),
        _TP + "SELECT id, date, account AS first, other AS second FROM t",
    ),
    "verify_unbalanced": (
        lambda s, d: ledger.unbalanced(V.transactions(s, d).withColumn("postings", F.expr("if(pmod(cast(substring(row_fingerprint, 11) as long), 11) = 0, slice(postings, 1, 1), postings)"))),
        _TP + f"SELECT id AS transaction_id, 'transaction '||id||' does not balance: '||commodity||' residual='||{_canonical('CAST(amount AS VARCHAR)')} AS message FROM t WHERE k%11=0",
    ),
    "verify_counts": (
        lambda s, d: ledger.verify(V.transactions(s, d)).select("transaction_count", "posting_count", "unbalanced_count"),
        _TP + "SELECT count(*) AS transaction_count, 2*count(*) AS posting_count, CAST(0 AS BIGINT) AS unbalanced_count FROM t",
    ),
    "ledger_hash_portable": (
        lambda s, d: ledger.ledger_hash(V.transactions(s, d), portable=True),
        _TP + f", h AS (SELECT date, id, sha256({_JSON_ROW}) AS h FROM t), z AS (SELECT date, substr(id,1,4) AS head, sha256(string_agg(h,'' ORDER BY id)) AS h FROM h GROUP BY ALL), y AS (SELECT date, sha256(string_agg(h,'' ORDER BY head)) AS h FROM z GROUP BY date) SELECT sha256(string_agg(h,'' ORDER BY date)) AS ledger_hash FROM y",
    ),
    "canonical_order": (
        lambda s, d: ledger.canonical_order(V.transactions(s, d)).select("id", "date", "payee"),
        _TP + "SELECT id, date, payee FROM t ORDER BY date, id",
    ),
    "parse_date_ladder": (
        _dates,
        _SR + "SELECT CAST(n AS INTEGER) AS row_number, date_raw, date FROM c",
    ),
    "parse_amount": (
        lambda s, d: V.statement(s, d).select("row_number", S.amount_digits(F.col("amount_raw")).alias("digits")).select("row_number", S.amount_of(F.col("digits")).alias("amount")),
        _SR + "SELECT CAST(n AS INTEGER) AS row_number, amount FROM c",
    ),
    "canonical_amount": (
        lambda s, d: V.table(s, d, "orders").select("o_orderkey", S.canonical_amount(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("amount")),
        f"SELECT o_orderkey, {_canonical('CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)')} AS amount FROM orders",
    ),
    "normalize_merchant_docs": (
        lambda s, d: S.with_merchant(V.table(s, d, "documents").select("doc_id", "text"), "text", "merchant_key", "merchant_name").drop("text"),
        f"SELECT doc_id, {_key('text')} AS merchant_key, {_name('text')} AS merchant_name FROM documents",
    ),
    "normalize_merchant_parts": (
        lambda s, d: V.statement(s, d).select("row_number", S.merchant_key(F.col("description_raw")).alias("key"), F.array_join(S.merchant_reasons(F.col("description_raw")), ";").alias("reasons")),
        _SR + r"SELECT CAST(n AS INTEGER) AS row_number, narration AS key, 'trim+uppercase'||CASE WHEN description_raw LIKE '%  %' THEN ';collapse_whitespace' ELSE '' END||CASE WHEN description_raw LIKE '%*ABC1234' THEN ';strip_trailing_ref' ELSE '' END||';alnum_underscore_key' AS reasons FROM c",
    ),
    "fingerprint_id": (
        lambda s, d: convert.transactions(V.converted(s, d)).select("id", "row_fingerprint"),
        _SR + f"SELECT {_uuid8('fp')} AS id, fp AS row_fingerprint FROM f WHERE fp IS NOT NULL",
    ),
    "account_validate": (
        lambda s, d: V.table(s, d, "supplier").select("s_suppkey", S.account_id(F.concat(F.lit("Assets:"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(":")).otherwise(F.lit("")), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(" x")).otherwise(F.lit("")))).alias("account"), S.commodity(F.concat(F.lit(" us"), F.repeat(F.lit("d"), (F.col("s_suppkey") % 20).cast("int")))).alias("commodity")),
        "SELECT s_suppkey, CASE WHEN s_suppkey%3<>0 AND s_suppkey%5<>0 THEN 'assets:'||s_suppkey END AS account, CASE WHEN s_suppkey%20<=14 THEN 'US'||repeat('D', s_suppkey%20) END AS commodity FROM supplier",
    ),
    "account_type": (
        lambda s, d: ledger.postings(V.transactions(s, d)).select("account_id", S.account_type(F.col("account_id")).alias("account_type")).distinct(),
        _TP + "SELECT DISTINCT account AS account_id, CASE split_part(account,':',1) WHEN 'assets' THEN 'asset' WHEN 'expenses' THEN 'expense' WHEN 'income' THEN 'income' END AS account_type FROM p",
    ),
    "bean_account": (
        lambda s, d: V.table(s, d, "customer").select("c_custkey", S.bean_account(F.concat(F.lit("assets:"), F.lower("c_mktsegment"), F.lit(":a-"), F.col("c_custkey").cast("string"))).alias("account")),
        f"SELECT c_custkey, {_BEAN.format(chr(39) + 'assets:' + chr(39) + '||lower(c_mktsegment)||' + chr(39) + ':a-' + chr(39) + '||c_custkey')} AS account FROM customer",
    ),
    "file_part": (
        lambda s, d: V.table(s, d, "customer").select("c_custkey", S.file_part(F.concat(F.lit("assets:"), F.lower("c_mktsegment"), F.lit(":"), F.col("c_custkey").cast("string"))).alias("part")),
        "SELECT c_custkey, 'assets_'||lower(c_mktsegment)||'_'||c_custkey AS part FROM customer",
    ),
    "posting_literals": (
        lambda s, d: V.table(s, d, "orders").select("o_orderkey", S.posting_literal(F.concat(F.lit("Assets:Cash ="), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(": usd"))).alias("p")).select("o_orderkey", "p.account", "p.amount", "p.commodity"),
        "SELECT o_orderkey, 'assets:cash' AS account, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS amount, 'USD' AS commodity FROM orders",
    ),
    "convert_rows": (
        lambda s, d: convert.transactions(V.converted(s, d)).select("id", "date", "payee", F.col("postings")[0]["amount"].alias("amount"), F.col("postings")[1]["account"].alias("offset_account"), F.col("postings")[1]["amount_text"].alias("offset_text"), F.col("postings")[0]["memo"].alias("memo")),
        _SR + f"SELECT {_uuid8('fp')} AS id, date, description_raw AS payee, amount, CASE WHEN amount<0 THEN 'expenses:uncategorized' ELSE 'income:uncategorized' END AS offset_account, CAST(-CAST(amount AS DECIMAL(18,2)) AS VARCHAR) AS offset_text, 'stmt:row:'||n AS memo FROM f WHERE fp IS NOT NULL",
    ),
    "convert_errors": (
        lambda s, d: V.converted(s, d).where("error is not null").groupBy("error").agg(F.count("*").alias("rows")),
        _SR + "SELECT error, count(*) AS rows FROM e WHERE error IS NOT NULL GROUP BY error",
    ),
    "statement_rows_union": (
        lambda s, d: _statement_rows(s, d).select("batch_id", "row_number", "parse_status", "error", "fingerprint", "transaction_id"),
        _SR + "SELECT batch_id, CAST(n AS BIGINT) AS row_number, status AS parse_status, error, fp AS fingerprint, id AS transaction_id FROM rows",
    ),
    "parse_report": (
        lambda s, d: V.statement(s, d).agg(F.count_if(F.col("parse_error").isNull()).alias("ok_rows"), F.count_if(F.col("parse_error").isNotNull()).alias("error_rows")),
        _SR + "SELECT count(*) FILTER (parse_error IS NULL) AS ok_rows, count(*) FILTER (parse_error IS NOT NULL) AS error_rows FROM s",
    ),
    "error_row_numbers": (
        lambda s, d: V.statement(s, d).where("parse_error is not null").select("row_number", S.error_row(F.col("parse_error")).alias("named")),
        _SR + "SELECT CAST(n AS INTEGER) AS row_number, CAST(n AS BIGINT) AS named FROM s WHERE parse_error IS NOT NULL",
    ),
    "topk_errors": (
        lambda s, d: _statement_rows(s, d).where("error is not null").orderBy("row_number", "error").select("row_number", "error").limit(20),
        _SR + "SELECT CAST(n AS BIGINT) AS row_number, error FROM rows WHERE error IS NOT NULL ORDER BY n, error LIMIT 20",
    ),
    "new_rows_anti": (
        lambda s, d: importing.new_transactions(V.transactions(s, d), _known(V.transactions(s, d))).select("id"),
        _TP + "SELECT id FROM t WHERE k%3<>0",
    ),
    "skip_existing_semi": (
        lambda s, d: importing.skipped(V.transactions(s, d), _known(V.transactions(s, d))).agg(F.count("*").alias("skipped")),
        _TP + "SELECT count(*) AS skipped FROM t WHERE k%3=0",
    ),
    "idempotent_import": (
        lambda s, d: importing.new_transactions(convert.transactions(V.converted(s, d)), convert.transactions(V.converted(s, d))).agg(F.count("*").alias("posted")),
        "SELECT CAST(0 AS BIGINT) AS posted",
    ),
    "new_batches": (
        lambda s, d: importing.new_batches(
            V.table(s, d, "supplier").select(F.lit("hdfc").alias("adapter"), F.sha2(F.col("s_name"), 256).alias("source_sha256"), (F.col("s_suppkey") % 4).cast("string").alias("account_id")),
            V.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.lit("hdfc").alias("adapter"), F.sha2(F.col("s_name"), 256).alias("source_sha256"), (F.col("s_suppkey") % 8).cast("string").alias("account_id")),
        ),
        "SELECT 'hdfc' AS adapter, sha256(s_name) AS source_sha256, CAST(s_suppkey%4 AS VARCHAR) AS account_id FROM supplier WHERE NOT (s_suppkey%2=0 AND s_suppkey%8<4)",
    ),
    "accounts_to_insert": (
        lambda s, d: importing.new_accounts(ledger.postings(V.transactions(s, d)).select(F.col("account_id").alias("id")), s.createDataFrame([("income:sales",)], "id string")),
        _TP + "SELECT DISTINCT account AS id FROM p WHERE account<>'income:sales'",
    ),
    "dedupe_exact": (lambda s, d: dedupe.exact_links(dedupe.candidates(V.activity(s, d))), f"WITH {_D} {_EXACT}"),
    "dedupe_near_w1": (lambda s, d: dedupe.near_links(dedupe.candidates(V.activity(s, d)), 1), f"WITH {_D} {_near(1)}"),
    "dedupe_near_w0": (lambda s, d: dedupe.near_links(dedupe.candidates(V.activity(s, d)), 0), f"WITH {_D} {_near(0)}"),
    "dedupe_near_w3": (lambda s, d: dedupe.near_links(dedupe.candidates(V.activity(s, d)), 3), f"WITH {_D} {_near(3)}"),
    "dedupe_all": (lambda s, d: dedupe.plan(V.activity(s, d), 1), f"WITH {_D} {_EXACT} UNION ALL {_near(1)}"),
    "dedupe_already_linked": (lambda s, d: dedupe.already_linked(V.activity(s, d)), "SELECT count(*) FILTER (event_id%40=0) AS already_linked FROM events"),
    "dedupe_applied": (
        lambda s, d: dedupe.apply(V.activity(s, d), dedupe.exact_links(dedupe.candidates(V.activity(s, d)))).where("duplicate_of is not null").select("id", "duplicate_of"),
        f"WITH {_D} SELECT id, survivor AS duplicate_of FROM x WHERE rank>1 UNION ALL SELECT {_uuid8(chr(39) + 'v1|events|' + chr(39) + '||event_id')}, {_uuid8(chr(39) + 'v1|events|1' + chr(39))} FROM events WHERE event_id%40=0",
    ),
    "rules_hits": (
        lambda s, d: _evaluated(s, d).select("id", F.array_join(F.transform("hits", lambda h: h["id"]), ",").alias("hits"), "outcome"),
        f"WITH {_R} SELECT id, coalesce(list_aggregate(list_transform(hits, lambda h: h.id),'string_agg',','),'') AS hits, outcome FROM o",
    ),
    "rules_applied": (
        lambda s, d: rules.applied(_evaluated(s, d)).select("transaction_id", "category", "rule_id", F.col("confidence").cast("int").alias("confidence")),
        f"WITH {_R} SELECT id AS transaction_id, top[1].c AS category, top[1].id AS rule_id, CAST(top[1].f AS INTEGER) AS confidence FROM o WHERE outcome='applied'",
    ),
    "rules_conflicts": (
        lambda s, d: rules.conflicts(_evaluated(s, d)),
        f"WITH {_R} SELECT id AS transaction_id, 'tx '||id||' priority '||top[1].p||' conflict: '||list_aggregate(list_transform(top, lambda h: h.id||'=>'||h.c),'string_agg',', ') AS message FROM o WHERE outcome='conflict'",
    ),
    "rules_outcome_counts": (
        lambda s, d: rules.counts(_evaluated(s, d)),
        f"WITH {_R} SELECT count(*) FILTER (outcome='applied') AS applied, count(*) FILTER (outcome='conflict') AS conflicts, count(*) FILTER (outcome='unmatched') AS unmatched, count(*) FILTER (outcome='skipped') AS skipped FROM o",
    ),
    "tag_replace": (
        lambda s, d: rules.tag(V.transactions(s, d), rules.applied(_evaluated(s, d))).select("id", F.array_join("tags", ",").alias("tags")),
        f"WITH {_R} SELECT id, list_aggregate(CASE WHEN outcome='applied' THEN list_filter(tags, lambda x: NOT starts_with(x,'category:'))||['category:'||top[1].c] ELSE tags END,'string_agg',',') AS tags FROM o",
    ),
    "tag_categories": (
        lambda s, d: V.transactions(s, d).select("id", F.explode(S.categories(F.col("tags"))).alias("category")),
        _TP + "SELECT id, 'income:urgent' AS category FROM t WHERE tags[1]='category:income:urgent'",
    ),
    "reconcile_lines": (_lines, f"WITH {_L} SELECT * FROM l"),
    "reconcile_summary": (
        lambda s, d: reconcile.summary(_lines(s, d), "1000.50", "10"),
        f"WITH {_L} SELECT CAST(10 AS DECIMAL(38,10)) AS starting, CAST(10+coalesce(sum(amount) FILTER (bucket='matched'),0) AS DECIMAL(38,10)) AS computed_ending, CAST(1000.50 AS DECIMAL(38,10)) AS stated_ending, CAST(10+coalesce(sum(amount) FILTER (bucket='matched'),0)-1000.50 AS DECIMAL(38,10)) AS unexplained_delta, count(*) FILTER (bucket='matched') AS matched, count(*) FILTER (bucket='skipped_duplicate') AS skipped_duplicate, count(*) FILTER (bucket='after_as_of') AS after_as_of FROM l",
    ),
    "row_reconcile_buckets": (
        lambda s, d: reconcile.bucket_counts(reconcile.row_buckets(_statement_rows(s, d), V.BANK)),
        _SR + "SELECT CASE WHEN status='ok' THEN 'matched' ELSE status END AS bucket, count(*) AS rows FROM rows GROUP BY 1",
    ),
    "row_reconcile_unmatched_tx": (
        lambda s, d: reconcile.uncovered(V.transactions(s, d), V.transactions(s, d).where("duplicate_of is null").select(F.lit(ACCOUNT).alias("account_id"), F.lit("ok").alias("parse_status"), F.col("id").alias("transaction_id")), ACCOUNT),
        _TP + f"SELECT id FROM t WHERE batch IS NOT NULL AND account='{ACCOUNT}' AND dup IS NOT NULL",
    ),
    "chain_verify": (
        lambda s, d: events.with_previous(V.chain(s, d), block=512).where("prev_hash <> expected_prev").select("seq"),
        "SELECT CAST(event_id+1 AS BIGINT) AS seq FROM events WHERE event_id%1000=999",
    ),
    "chain_tip": (
        lambda s, d: events.tip(V.chain(s, d)),
        "SELECT CAST(max(event_id)+1 AS BIGINT) AS seq, sha256(CAST(max(event_id) AS VARCHAR)) AS content_hash FROM events",
    ),
    "event_hashes": (
        lambda s, d: V.chain(s, d).select("seq", S.event_hash(F.col("prev_hash"), F.col("id"), F.col("at"), F.col("kind"), F.col("payload_json")).alias("hash")),
        "SELECT CAST(event_id+1 AS BIGINT) AS seq, sha256('v1'||chr(10)||'prev='||CASE WHEN event_id%1000=999 THEN '?' WHEN event_id=0 THEN repeat('0',64) ELSE sha256(CAST(event_id-1 AS VARCHAR)) END||chr(10)||'id=i'||chr(10)||'at=t'||chr(10)||'kind=posted'||chr(10)||'payload='||props) AS hash FROM events",
    ),
    "event_decode": (
        lambda s, d: events.decoded(V.log(s, d), "categorized").select("seq", "transaction_id", "category", "rule_id", "confidence", F.array_join("reasons", ";").alias("reasons")),
        f"WITH {_T} SELECT CAST(k*4+1 AS BIGINT) AS seq, id AS transaction_id, 'expenses:a' AS category, 'r' AS rule_id, CAST(90 AS INTEGER) AS confidence, 'payee_regex=x' AS reasons FROM t WHERE k%3=0 UNION ALL SELECT k*4+2, id, 'expenses:b', 'r', 90, 'payee_regex=x' FROM t WHERE k%6=0",
    ),
    "replay_through_n": (lambda s, d: _replayed(s, d, 20001), _replayed_sql(20001)),
    "replay_latest_tag": (lambda s, d: _replayed(s, d, None), _replayed_sql(None)),
    "rebuild_diff": (
        lambda s, d: events.differences(events.replay(V.log(s, d)), events.replay(V.log(s, d), 4000)).groupBy("side").agg(F.count("*").alias("rows")),
        f"WITH {_T}, y AS (SELECT k, CASE WHEN k*4>4000 THEN 1 WHEN k=1000 THEN 1 ELSE 0 END AS l, CASE WHEN k=1000 THEN 1 ELSE 0 END AS r FROM t) SELECT 'left' AS side, CAST(sum(l) AS BIGINT) AS rows FROM y HAVING sum(l)>0 UNION ALL SELECT 'right', CAST(sum(r) AS BIGINT) FROM y HAVING sum(r)>0",
    ),
    "why_tx": (_why, _WHY_SQL),
    "export_csv_lines": (
        lambda s, d: export.csv_lines(V.transactions(s, d)).select("transaction_id", "ordinal", "line"),
        _TP + "SELECT id AS transaction_id, CAST(ordinal AS INTEGER) AS ordinal, date||','||id||','||payee||','||account||','||amount||','||commodity||','||coalesce(memo,'') AS line FROM p WHERE dup IS NULL",
    ),
    "export_json_lines": (
        lambda s, d: export.json_lines(V.transactions(s, d)).select("transaction_id", "line"),
        _TP + """SELECT id AS transaction_id, '{"id":"'||id||'","date":"'||date||'","payee":"'||payee||'","narration":"'||narration||'","postings":[{"account":"'||account||'","amount":"'||amount||'","commodity":"'||commodity||'","memo":"order:'||k||'"},{"account":"'||other||'","amount":"'||(-amount)||'","commodity":"'||commodity||'","memo":null}],"import_batch_id":'||coalesce('"'||batch||'"','null')||',"duplicate_of":null,"tags":['||list_aggregate(list_transform(tags, lambda x: '"'||x||'"'),'string_agg',',')||'],"row_fingerprint":"v1|orders|'||k||'"}' AS line FROM t WHERE dup IS NULL""",
    ),
    "export_json_entries": (
        lambda s, d: export.json_entries(V.transactions(s, d)).select("transaction_id", "entry"),
        _TP + """, e AS (SELECT *, chr(10) AS n FROM t WHERE dup IS NULL) SELECT id AS transaction_id, '    {'||n||'      "id": "'||id||'",'||n||'      "date": "'||date||'",'||n||'      "payee": "'||payee||'",'||n||'      "narration": "'||narration||'",'||n||'      "postings": ['||n
          ||'        {'||n||'          "account": "'||account||'",'||n||'          "amount": "'||amount||'",'||n||'          "commodity": "'||commodity||'",'||n||'          "memo": "order:'||k||'"'||n||'        },'||n
          ||'        {'||n||'          "account": "'||other||'",'||n||'          "amount": "'||(-amount)||'",'||n||'          "commodity": "'||commodity||'",'||n||'          "memo": null'||n||'        }'||n||'      ],'||n
          ||'      "import_batch_id": '||coalesce('"'||batch||'"','null')||','||n||'      "duplicate_of": null,'||n||'      "tags": ['||n||'        '||array_to_string(list_transform(tags, lambda x: '"'||x||'"'),','||chr(10)||'        ')||n||'      ],'||n||'      "row_fingerprint": "v1|orders|'||k||'"'||n||'    }' AS entry FROM e""",
    ),
    "export_bean_directives": (
        lambda s, d: export.bean_directives(V.transactions(s, d)).select(F.col("section").cast("int").alias("section"), "name", "line"),
        _TP + f"SELECT CAST(1 AS INTEGER) AS section, commodity AS name, min(date)||' commodity '||commodity AS line FROM p WHERE dup IS NULL GROUP BY commodity UNION ALL SELECT 2, {_BEAN.format('account')}, min(date)||' open '||{_BEAN.format('account')} FROM p WHERE dup IS NULL GROUP BY account",
    ),
    "export_bean_entries": (
        lambda s, d: export.bean_entries(V.transactions(s, d)).select("transaction_id", "entry"),
        _TP + f"""SELECT id AS transaction_id, date||' * "'||payee||'"'||CASE WHEN narration<>'' THEN ' "'||narration||'"' ELSE '' END||chr(10)||'  id: "'||id||'"'||chr(10)||CASE WHEN batch IS NOT NULL THEN '  import_batch: "'||batch||'"'||chr(10) ELSE '' END||CASE WHEN tags[1]='category:income:urgent' THEN '  category: "income:urgent"'||chr(10) ELSE '' END||'  '||{_BEAN.format("account")}||'  '||amount||' '||commodity||' ; order:'||k||chr(10)||'  '||{_BEAN.format("other")}||'  '||(-amount)||' '||commodity AS entry FROM t WHERE dup IS NULL""",
    ),
    "operating_currency": (
        lambda s, d: export.operating_currency(V.transactions(s, d)),
        _TP + "SELECT commodity AS operating_currency FROM p WHERE dup IS NULL GROUP BY commodity ORDER BY count(*) DESC, min(date), commodity LIMIT 1",
    ),
    "exported_count": (lambda s, d: ledger.active(V.transactions(s, d)).agg(F.count("*").alias("transactions")), _TP + "SELECT count(*) AS transactions FROM t WHERE dup IS NULL"),
    "rules_file": (
        lambda s, d: rules.applied(rules.evaluate(V.transactions(s, d), _from_files(s))).select("transaction_id", "category", "rule_id", F.col("confidence").cast("int").alias("confidence")),
        f"WITH {_R} SELECT id AS transaction_id, top[1].c AS category, top[1].id AS rule_id, CAST(top[1].f AS INTEGER) AS confidence FROM o WHERE outcome='applied'",
    ),
    "error_row_fallback": (
        lambda s, d: convert.numbered(V.table(s, d, "orders").select((F.col("o_orderkey") % 7).cast("string").alias("batch_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("row_number"), F.concat(F.lit("unreadable "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("error"))),
        "SELECT CAST(o_orderkey%7 AS VARCHAR) AS batch_id, o_orderkey AS row_number, 'unreadable '||lpad(CAST(o_orderkey AS VARCHAR),12,'0') AS error FROM orders WHERE o_orderkey%3=0 UNION ALL SELECT CAST(o_orderkey%7 AS VARCHAR), -row_number() OVER (PARTITION BY o_orderkey%7 ORDER BY o_orderkey), 'unreadable '||lpad(CAST(o_orderkey AS VARCHAR),12,'0') FROM orders WHERE o_orderkey%3<>0",
    ),
    "link_checks": (
        lambda s, d: dedupe.invalid(_wanted_links(s, d), V.activity(s, d)),
        f"""WITH w AS (SELECT event_id, {_uuid8("'v1|events|'||event_id")} AS a, CASE event_id%4 WHEN 0 THEN {_uuid8("'v1|events|'||event_id")} WHEN 1 THEN 'nothing' ELSE {_uuid8("'v1|events|1'")} END AS b FROM events)
        SELECT CASE WHEN event_id%4=3 THEN 'none-'||event_id ELSE a END AS duplicate_id, b AS survivor_id,
          CASE event_id%4 WHEN 0 THEN 'a transaction can''t repeat itself' WHEN 3 THEN 'no such duplicate' WHEN 1 THEN 'no such survivor' ELSE 'already linked' END AS reason FROM w WHERE event_id%4<>2 OR event_id%40=0""",
    ),
    "eval_dedupe": (
        lambda s, d: dedupe.scores(V.table(s, d, "events").select((F.col("event_id") % 5 < 2).alias("expected"), (F.col("event_id") % 3 == 0).alias("found"))),
        "WITH c AS (SELECT event_id%5<2 AS e, event_id%3=0 AS f FROM events), n AS (SELECT count(*) FILTER (e AND f) AS tp, count(*) FILTER (f AND NOT e) AS fp, count(*) FILTER (e AND NOT f) AS fn FROM c) SELECT tp, fp, fn, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall FROM n",
    ),
    "eval_rules": (
        lambda s, d: rules.scores(V.table(s, d, "events").select(F.when(F.col("event_id") % 5 < 3, (F.col("event_id") % 2).cast("string")).alias("expected"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 4 % 2).cast("string")).alias("found"))),
        "WITH c AS (SELECT CASE WHEN event_id%5<3 THEN event_id%2 END AS e, CASE WHEN event_id%3>0 THEN event_id%4%2 END AS f FROM events), n AS (SELECT count(*) FILTER (f IS NOT NULL AND f IS NOT DISTINCT FROM e) AS tp, count(*) FILTER (f IS NOT NULL AND f IS DISTINCT FROM e) AS fp, count(*) FILTER (f IS NULL AND e IS NOT NULL) AS fn FROM c) SELECT tp, fp, fn, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall FROM n",
    ),
}
CATALOGUE |= files.QUERIES | workspace.QUERIES
