"""Queries over a workspace that is made from the driver's customers: commands and what they leave, held against SQL.

The workspace is made once for a session and tables, in the folder that driver and executors share: one statement with a
row for each customer is imported, imported again, and worked on. It is one file however many customers there are, so it is
imported without the caps that hold for files of people.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..operators import events, export, reconcile, rules
from . import files
from .views import table

BANK, FOOD, OTHER = "assets:bank:main", "expenses:food", "income:other"
AS_OF, STATED = "2026-01-20", "1000.50"
RULES = [rules.Rule("sevens", "income:sevens", 5, payee_regex="7$"), rules.Rule("big", "income:big", 9, payee_regex="^Customer", min_amount="9000")]

#: No caps but those of a file source.
UNCAPPED = {"max_bytes": (1 << 31) - 1, "max_rows": (1 << 31) - 1}

_made: dict[tuple[str, str], dict] = {}


def _statement(spark: SparkSession, sf_dir: str) -> str:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    date = F.format_string("2026-01-%02d", (k % 28 + 1).cast("int"))
    amount = F.when(k % 50 == 0, "").otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    line = F.concat_ws(",", date, F.col("c_name"), amount, F.lit("usd"), F.lit("1"))
    return files.write(c.select(F.lit(0).cast("long").alias("file"), k.alias("n"), line.alias("line")), "Date,Description,Amount,Currency,Balance", files.scratch(spark, "statement"))


def made(spark: SparkSession, sf_dir: str) -> dict:
    """The workspace and what its commands returned."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        w = store.Workspace.init(spark, files.scratch(spark, "workspace"))
        path = spark.read.format("binaryFile").load(_statement(spark, sf_dir)).select("path").first().path
        path = re.sub("^file:/+", "file:///", path)
        version = w.schema_version()
        w.add_account("Expenses:Food", "expense", "usd", "Food")
        first = w.import_file(path, BANK, "generic", commodity="USD", **UNCAPPED)
        again = w.import_file(path, BANK, "generic", commodity="USD", **UNCAPPED)
        elsewhere = w.import_file(path, "assets:bank:other", "generic", commodity="USD", **UNCAPPED)
        lunch = w.transfer("2026-01-15", "lunch", BANK, FOOD, "12.50", "USD")
        twice = w.add_transaction("2026-01-15", "lunch twice", [f"{BANK}=-12.50:USD", f"{FOOD}=12.50:USD"])
        w.mark_duplicate(twice, lunch, "by hand")
        w.categorize(lunch, "expenses:first")
        w.categorize(lunch, "expenses:second")
        counted = w.apply_rules(RULES)
        proof, report = w.reconcile(BANK, STATED, AS_OF, "USD", "10")
        ok, coverage = w.reconcile_rows(BANK)
        _made[key] = {"w": w, "version": version, "imports": (first, again, elsewhere), "lunch": lunch, "twice": twice, "counted": counted, "report": report, "coverage": coverage, "ok": ok}
    return _made[key]


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def imported(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, i.posted, i.skipped, i.rows, i.duplicate, len(i.errors)) for k, i in enumerate(made(spark, d)["imports"])]
    return spark.createDataFrame(rows, "nth int, posted long, skipped long, n_rows long, known boolean, errors_shown int")


def transactions(spark: SparkSession, d: str) -> DataFrame:
    t = made(spark, d)["w"].transactions()
    leg = lambda k: F.col("postings")[k]
    return t.select("date", "payee", "narration", F.array_join("tags", ",").alias("tags"), F.col("duplicate_of").isNotNull().alias("duplicate"), F.col("import_batch_id").isNotNull().alias("imported"), leg(0)["account"].alias("account"), leg(0)["amount"].alias("amount"), leg(1)["account"].alias("other"), leg(1)["amount_text"].alias("other_text"), leg(0)["commodity"].alias("commodity"))


def log(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind; how many have ids of version 7, and how many break the chain."""
    t = made(spark, d)["w"].table("log")
    own = t.groupBy("kind").agg(F.count("*").alias("events"), F.count_if(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("ids"))
    broken = events.broken(t).agg(F.count("*").alias("broken"))
    return own.crossJoin(F.broadcast(broken))  # one row


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """An account, an absent one, and each hundredth statement row by batch and number with what it became."""
    m = made(spark, d)
    found = [(a, *(getattr(m["w"].account(a), c, None) for c in ("account_type", "commodity", "name"))) for a in (FOOD, BANK, "assets:none")]
    batch = m["imports"][0].batch_id
    rows = [(f"row {n}", r.parse_status if r else None, r.amount_raw if r else None, r.error if r else None) for n in (2, 51, 10**9) for r in [m["w"].statement_row(batch, n)]]
    return spark.createDataFrame(found + rows, "asked string, a string, b string, c string")


def verified(spark: SparkSession, d: str) -> DataFrame:
    """Counts before and after the projections are made anew, and whether the ledger is the same."""
    w = made(spark, d)["w"]
    before = w.verify()
    after = w.rebuild()
    w.verify_chain()
    return _one(spark, "transactions long, postings long, unbalanced long, same boolean, events long, at_start long", before.transaction_count, before.posting_count, before.unbalanced_count, before.ledger_hash == after.ledger_hash, w.counts()["events"], w.replay(2).count())


_ID = "`[0-9a-f]{8}-[0-9a-f-]{27}`"


def report_lines(spark: SparkSession, d: str, which: str) -> DataFrame:
    path = made(spark, d)[which]
    text = spark.read.text(path, wholetext=True).first().value
    return spark.createDataFrame([(path.rpartition("/")[2], k, re.sub(_ID, "`id`", line)) for k, line in enumerate(text.split("\n"))], "file string, n int, line string")


def report_counts(spark: SparkSession, d: str, which: str) -> DataFrame:
    """file, line and copies of a report with a line for each transaction; what follows its last line break is a line as well."""
    path = made(spark, d)[which]
    last = spark.createDataFrame([("",)], "value string")
    lines = spark.read.text(path, lineSep="\n").unionByName(last).select(F.regexp_replace("value", _ID, "`id`").alias("line"))
    return lines.groupBy(F.lit(path.rpartition("/")[2]).alias("file"), "line").agg(F.count("*").alias("copies"))


def folder(spark: SparkSession, d: str) -> DataFrame:
    """What init made: the version, the settings, and the copy of the imported file under the name of its contents."""
    m = made(spark, d)
    f = m["w"].folder
    copies = spark.read.format("binaryFile").load(f.at("artifacts")).select("length", F.sha2("content", 256).alias("sha"), F.element_at(F.split("path", "/"), -1).alias("name"))
    one = copies.select(F.concat(F.lit("generic_csv-"), F.substring("sha", 1, 16), F.lit(".bin")).alias("want"), "name", "length").where("want = name")
    config = json.loads(f.read("config.json"))
    return one.select(F.lit(m["version"]).alias("version"), F.lit(config["default_commodity"]).alias("commodity"), F.lit(f.exists("reports")).alias("reports"), "name", "length")


def guarded(spark: SparkSession) -> DataFrame:
    """Names that the guards of paths and of reports take."""
    names = ("out.bean", "a/b.csv", "../x", "a/../b", "", "a\\..\\b", "..hidden", "a..b")

    def taken(guard, name: str) -> bool:
        try:
            guard(name)
        except store.LedgerError:
            return False
        return True

    return spark.createDataFrame([(n, taken(store.guard_path, n), taken(store.report_name, n)) for n in names], "name string, path_ok boolean, report_ok boolean")


def explained(spark: SparkSession, d: str) -> DataFrame:
    """The steps of a statement row and its transaction, of a row that failed, and of a transaction made by hand."""
    m = made(spark, d)
    batch = m["imports"][0].batch_id
    told = []
    for name, what in (("row 3", f"{batch}:3"), ("row 2", f"{batch}:2"), ("lunch", m["lunch"])):
        for k, step in enumerate(m["w"].why(what)):
            told.append((name, k, step.kind))
    return spark.createDataFrame(told, "what string, n int, kind string")


def exported(spark: SparkSession, d: str) -> DataFrame:
    """Of the exports as files: the lines of the CSV with its head, the entries of the JSON document and the first's date,
    and the transactions of the Beancount file with the second line of its head."""
    t = made(spark, d)["w"].transactions()
    out = []
    for form in ("csv", "json", "beancount"):
        path = files.scratch(spark, form)
        export.export_files(t, form, path)
        # the head is a few lines
        head = [r.value for r in spark.read.text(f"{path}/head", lineSep="\n").collect()]
        rows = spark.read.text(f"{path}/rows", lineSep="\n" if form != "json" else "\n    }").select("value")
        if form == "json":
            tail = [r.value for r in spark.read.text(f"{path}/tail", lineSep="\n").collect()]
            assert (head, tail) == (["{", '  "transactions": ['], ["  ]", "}"])
            # a record is an entry without its last line; before it, the comma of the one before, and at a file's end a line break
            entries = rows.where(~F.col("value").isin("", "\n", ",\n", ",")).select(F.from_json(F.concat(F.regexp_replace("value", r"^,?\n", ""), F.lit("}")), "id string, date string", {"mode": "FAILFAST"}).alias("e"))
            names = sorted(r[0] for r in entries.select(F.input_file_name()).distinct().collect())  # those that have entries
            first = entries.where(F.input_file_name() == names[0]).first()
            out.append((form, entries.where("e.id is not null").count(), first.e.date))
        elif form == "csv":
            out.append((form, len(head) + rows.count(), head[0]))
        else:
            out.append((form, sum(" * " in x for x in head) + rows.where(F.col("value").contains(" * ")).count(), head[1]))
        gone = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return spark.createDataFrame(out, "form string, n long, sample string")


def required(spark: SparkSession) -> DataFrame:
    """What a command says where there is no workspace."""
    try:
        store.Workspace(spark, files.scratch(spark, "none"))
    except store.LedgerError as e:
        return _one(spark, "refused boolean, said string", True, re.sub("at .* \\(", "at ... (", str(e)))
    return _one(spark, "refused boolean, said string", False, None)


def plugged_in(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an exporter that isn't built in: payees, in the order of exports."""
    t = made(spark, d)["w"].transactions()

    def payees(rows: DataFrame) -> tuple[str, DataFrame, str]:
        text = F.concat("payee", F.lit("\n"))
        return "# payees\n", rows.where("duplicate_of is null").select("date", F.col("id").alias("transaction_id"), F.lit(0).alias("ordinal"), text.alias("text")), "# end\n"

    path = files.scratch(spark, "payees")
    export.EXPORTERS["payees"] = payees
    try:
        export.export_files(t, "payees", path)
    finally:
        del export.EXPORTERS["payees"]
    lines = spark.read.text([f"{path}/{part}" for part in ("head", "rows", "tail")], lineSep="\n")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("copies"))


_C = """WITH c AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey)+1 AS n, c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS amount, make_date(2026,1,CAST(c_custkey%28+1 AS INTEGER)) AS date, c_custkey%50=0 AS bad FROM customer),
g AS (SELECT * FROM c WHERE NOT bad AND amount<>0),
a AS (SELECT g.*, account FROM g, (VALUES ('assets:bank:main'),('assets:bank:other')) x(account)),
l AS (SELECT date, account, amount, CASE WHEN c_name LIKE '%7' THEN 1 ELSE 0 END AS seven, abs(amount)>=9000 AS big, c_name FROM a)"""
_PAYEE = "'customer'"  # the number after the # is a reference
_P = f"""{_C}, m AS (SELECT date, c_name AS payee, amount, 0 AS kind FROM g UNION ALL SELECT DATE '2026-01-15', 'lunch', -12.50, 0 UNION ALL SELECT DATE '2026-01-15', 'lunch twice', -12.50, 1),
b AS (SELECT *, CASE WHEN date>DATE '{AS_OF}' THEN 2 ELSE kind END AS bucket FROM m),
s AS (SELECT coalesce(sum(amount) FILTER (bucket=0),0)+10 AS ending, count(*) FILTER (bucket=0) AS matched, count(*) FILTER (bucket>0) AS unmatched FROM b)"""


def _plain_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(18,2)) AS VARCHAR),'(\.\d*?)0+$','\1'),'\.$','')"


QUERIES = {
    "workspace_import": (
        imported,
        f"{_C}, n AS (SELECT count(*) AS n_rows, CAST(least(20,count(*) FILTER (bad OR amount=0)) AS INTEGER) AS bad_rows, (SELECT count(*) FROM g) AS good FROM c) SELECT CAST(0 AS INTEGER) AS nth, good AS posted, CAST(0 AS BIGINT) AS skipped, n_rows, false AS known, bad_rows AS errors_shown FROM n UNION ALL SELECT 1, 0, good, n_rows, true, bad_rows FROM n UNION ALL SELECT 2, good, 0, n_rows, false, bad_rows FROM n",
    ),
    "workspace_transactions": (
        transactions,
        f"""{_C} SELECT date, c_name AS payee, {_PAYEE} AS narration, CASE WHEN abs(amount)>=9000 THEN 'category:income:big' WHEN c_name LIKE '%7' THEN 'category:income:sevens' ELSE '' END AS tags, false AS duplicate, true AS imported, account, CAST(amount AS DECIMAL(38,10)) AS amount,
          CASE WHEN amount<0 THEN 'expenses:uncategorized' ELSE 'income:uncategorized' END AS other, CAST(-amount AS VARCHAR) AS other_text, 'USD' AS commodity FROM a
        UNION ALL SELECT DATE '2026-01-15', 'lunch', NULL, 'category:expenses:second', false, false, '{FOOD}', 12.5, '{BANK}', '-12.50', 'USD' UNION ALL SELECT DATE '2026-01-15', 'lunch twice', NULL, '', true, false, '{BANK}', -12.5, '{FOOD}', '12.50', 'USD'""",
    ),
    "workspace_accounts": (
        lambda s, d: made(s, d)["w"].table("accounts").select("id", "account_type", "commodity", "name"),
        f"SELECT * FROM (VALUES ('{FOOD}','expense','USD','Food'),('{BANK}','asset','USD','{BANK}'),('assets:bank:other','asset','USD','assets:bank:other'),('expenses:uncategorized','expense','USD','expenses:uncategorized'),('income:uncategorized','income','USD','income:uncategorized')) x(id,account_type,commodity,name)",
    ),
    "workspace_statement_rows": (
        lambda s, d: made(s, d)["w"].table("statement_rows").select("adapter", "account_id", "row_number", "date_raw", "amount_raw", "parse_status", "error", F.col("transaction_id").isNotNull().alias("posted")),
        f"""{_C} SELECT 'generic_csv' AS adapter, account AS account_id, n AS row_number, CASE WHEN NOT bad THEN strftime(date,'%Y-%m-%d') END AS date_raw, CASE WHEN NOT bad THEN CAST(amount AS VARCHAR) END AS amount_raw, CASE WHEN bad THEN 'parse_error' WHEN amount=0 THEN 'convert_error' ELSE 'ok' END AS parse_status,
          CASE WHEN bad THEN 'parse error at row '||n||': missing amount' WHEN amount=0 THEN 'amount is zero' END AS error, NOT bad AND amount<>0 AS posted FROM c, (VALUES ('{BANK}'),('assets:bank:other')) x(account)""",
    ),
    "workspace_log": (
        log,
        f"""{_C}, t AS (SELECT count(*) FILTER (c_name LIKE '%7' OR abs(amount)>=9000) AS tagged, count(*) AS posted FROM a)
        SELECT kind, events, events AS ids, CAST(0 AS BIGINT) AS broken FROM (SELECT 'account_upserted' AS kind, CAST(5 AS BIGINT) AS events UNION ALL SELECT 'imported', 2 UNION ALL SELECT 'posted', posted+2 FROM t UNION ALL SELECT 'deduped', 1 UNION ALL SELECT 'categorized', tagged+2 FROM t UNION ALL SELECT 'reconciled', 1)""",
    ),
    "workspace_lookups": (
        looked_up,
        f"""{_C} SELECT '{FOOD}' AS asked, 'expense' AS a, 'USD' AS b, 'Food' AS c UNION ALL SELECT '{BANK}', 'asset', 'USD', '{BANK}' UNION ALL SELECT 'assets:none', NULL, NULL, NULL UNION ALL SELECT 'row 1000000000', NULL, NULL, NULL
        UNION ALL SELECT 'row '||n, CASE WHEN bad THEN 'parse_error' WHEN amount=0 THEN 'convert_error' ELSE 'ok' END, CASE WHEN NOT bad THEN CAST(amount AS VARCHAR) END, CASE WHEN bad THEN 'parse error at row '||n||': missing amount' WHEN amount=0 THEN 'amount is zero' END FROM c WHERE n IN (2,51)""",
    ),
    "workspace_verify": (
        verified,
        f"{_C}, t AS (SELECT count(*) FILTER (c_name LIKE '%7' OR abs(amount)>=9000) AS tagged, count(*) AS posted FROM a) SELECT posted+2 AS transactions, 2*(posted+2) AS postings, CAST(0 AS BIGINT) AS unbalanced, true AS same, 5+2+posted+2+1+tagged+2+1 AS events, CAST(0 AS BIGINT) AS at_start FROM t",
    ),
    "workspace_proof": (
        # rows of one date go by id, which SQL hasn't got: lines are counted
        lambda s, d: report_counts(s, d, "report"),
        f"""{_P}, r AS (SELECT '| '||date||' | `id` | '||payee||' | '||{_plain_sql("amount")}||' |' AS line FROM b)
        SELECT 'reconcile-assets_bank_main-{AS_OF}.md' AS file, line, CAST(count(*) AS BIGINT) AS copies FROM (
          SELECT unnest(['# Reconciliation proof','','- account: `{BANK}`','- commodity: `USD`','- as_of: {AS_OF}','- starting: 10','- computed_ending: '||{_plain_sql("ending")},'- stated_ending: 1000.5','- unexplained_delta: '||{_plain_sql(f"ending-{STATED}")},'- status: '||CASE WHEN ending={STATED} THEN 'BALANCED' ELSE 'UNEXPLAINED_DELTA' END,'- matched: '||matched,'- unmatched: '||unmatched,
            '','## Included postings (skip duplicates)','','| date | tx | payee | amount |','|---|---|---|---|','','## Skipped duplicates','','| date | tx | payee | amount |','|---|---|---|---|','','## After as_of (excluded)','','| date | tx | payee | amount |','|---|---|---|---|','']) AS line FROM s UNION ALL SELECT line FROM r) GROUP BY line""",
    ),
    "workspace_coverage": (
        lambda s, d: report_lines(s, d, "coverage"),
        f"""{_C}, n AS (SELECT count(*) FILTER (NOT bad AND amount<>0) AS ok, count(*) FILTER (NOT bad AND amount=0) AS zero, count(*) FILTER (bad) AS bad FROM c)
        SELECT 'reconcile-rows-assets_bank_main.md' AS file, CAST(k AS INTEGER) AS n, line FROM (SELECT unnest(range(10)) AS k, unnest(['# Statement-row reconciliation','','- account: `{BANK}`','- matched: '||ok,'- unmatched_rows: 0','- convert_errors: '||zero,'- parse_errors: '||bad,'- unmatched_imported_txns: 0','- status: '||CASE WHEN zero+bad=0 THEN 'ROWS_MATCHED' ELSE 'ROW_GAPS' END,'']) AS line FROM n)""",
    ),
    "workspace_folder": (
        folder,
        """WITH x AS (SELECT 'Date,Description,Amount,Currency,Balance'||chr(10)||string_agg(strftime(make_date(2026,1,CAST(c_custkey%28+1 AS INTEGER)),'%Y-%m-%d')||','||c_name||','||CASE WHEN c_custkey%50=0 THEN '' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END||',usd,1'||chr(10), '' ORDER BY c_custkey) AS t FROM customer)
        SELECT CAST(3 AS INTEGER) AS version, 'INR' AS commodity, true AS reports, 'generic_csv-'||substr(sha256(t),1,16)||'.bin' AS name, CAST(strlen(t) AS BIGINT) AS length FROM x""",
    ),
    "workspace_guards": (
        lambda s, d: guarded(s),
        r"SELECT name, name<>'' AND NOT list_contains(string_split(replace(name,'\','/'),'/'),'..') AS path_ok, NOT contains(name,'..') AND NOT contains(name,'/') AND NOT contains(name,'\') AS report_ok FROM (VALUES ('out.bean'),('a/b.csv'),('../x'),('a/../b'),(''),('a\..\b'),('..hidden'),('a..b')) x(name)",
    ),
    "workspace_required": (lambda s, d: required(s), "SELECT true AS refused, 'no workspace at ... (run init)' AS said"),
    "workspace_plug_in": (
        plugged_in,
        f"{_C} SELECT c_name AS line, count(*) AS copies FROM a GROUP BY ALL UNION ALL SELECT unnest(['# payees','lunch','# end']), 1",
    ),
    "workspace_why": (
        explained,
        f"""{_C}, f AS (SELECT * FROM c WHERE n=3), s AS (SELECT date, c_name LIKE '%7' OR abs(amount)>=9000 AS tagged FROM f)
        SELECT 'row 3' AS what, CAST(row_number() OVER ()-1 AS INTEGER) AS n, kind FROM (SELECT unnest(list_concat(['statement_row','imported','posted'], CASE WHEN tagged THEN ['categorized'] ELSE [] END, CASE WHEN date<=DATE '{AS_OF}' THEN ['reconciled'] ELSE [] END)) AS kind FROM s)
        UNION ALL SELECT 'row 2', 0, 'statement_row' UNION ALL SELECT 'lunch', CAST(k AS INTEGER), kind FROM (SELECT unnest(range(5)) AS k, unnest(['posted','deduped','categorized','categorized','reconciled']) AS kind)""",
    ),
    "workspace_export": (
        exported,
        f"""{_C} SELECT 'csv' AS form, 1+2*(count(*)+1) AS n, 'date,tx_id,payee,account,amount,commodity,memo' AS sample FROM a UNION ALL SELECT 'json', count(*)+1, CAST(min(date) AS VARCHAR) FROM a UNION ALL SELECT 'beancount', count(*)+1, 'option "operating_currency" "USD"' FROM a""",
    ),
}
