import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_sources import GENERIC, MALFORMED

from tallyforge import cli, store
from tallyforge.operators import events, export, ledger, reconcile, rules
from tallyforge.plans import files, workspace
from tallyforge.sources import statements
from tallyforge.store import LedgerError, Workspace, guard_path

BANK = "assets:bank:checking"
RULES = """
rules:
  - {id: amazon-shopping, priority: 20, category: "expenses:shopping", merchant_regex: "(?i)amzn|amazon", confidence: 90}
  - {id: coffee, priority: 10, category: "expenses:food", payee_regex: "(?i)starbucks|cafe"}
  - {id: payroll, priority: 30, category: "income:salary", payee_regex: "(?i)payroll|salary", min_amount: "1000", confidence: 95}
"""


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("w")
    (d / "s.csv").write_text(GENERIC)
    (d / "m.csv").write_text(MALFORMED)
    return Workspace.init(spark, str(d / "ledger")), d


def test_story(work):
    w, d = work
    first = w.import_file(str(d / "s.csv"), BANK, "generic", commodity="USD")
    assert (first.posted, first.skipped, first.rows, first.duplicate) == (4, 0, 4, False)
    again = w.import_file(str(d / "s.csv"), BANK, "generic", commodity="USD")
    assert again.duplicate and again.batch_id == first.batch_id and w.counts()["transactions"] == 4
    assert w.balance(BANK, "usd") == Decimal("2409.20")
    manual = w.add_transaction("2026-01-03", "STARBUCKS STORE 12345", [f"{BANK}=-6.50:USD", "expenses:uncategorized=6.50:USD"])
    links = w.dedupe()
    assert len(links) == 1 and links[0].strategy == "near_window" and manual in (links[0].duplicate_id, links[0].survivor_id)
    assert w.balance(BANK, "USD") == Decimal("2409.20") and w.dedupe() == []
    counts = w.apply_rules(rules.load(RULES))
    assert (counts["applied"], counts["conflicts"], counts["unmatched"], counts["skipped"]) == (4, 0, 0, 0)
    assert w.apply_rules(rules.load(RULES))["skipped"] == 4
    t, path = w.reconcile(BANK, "2409.20", "2026-01-07", "USD")
    assert t.unexplained_delta == 0 and "status: BALANCED" in open(path).read() and os.path.basename(path) == "reconcile-assets_bank_checking-2026-01-07.md"
    t, _ = w.reconcile(BANK, "2400", "2026-01-05", "USD", "1000")
    assert t.unexplained_delta == Decimal("1051.35") and t.after_as_of == 1
    ok, path = w.reconcile_rows(BANK)
    assert ok and "ROWS_MATCHED" in open(path).read()
    before = w.verify()
    assert before.transaction_count == 5 and w.rebuild().ledger_hash == before.ledger_hash and w.verify().ledger_hash == before.ledger_hash
    early = w.replay(first.posted)
    assert early.count() < 5
    kinds = [s.kind for s in w.why(manual)]
    assert kinds[0] == "posted" and "deduped" in kinds and "reconciled" in kinds
    imported = w.transactions().where("import_batch_id is not null and payee like 'ACME%'").first()
    steps = w.why(f"{first.batch_id}:4")
    assert steps[0].kind == "statement_row" and [s.kind for s in steps[1:]][:2] == ["imported", "posted"]
    assert any("categorized income:salary rule=payroll conf=95" in s.summary for s in w.why(imported.id))


def test_bad_rows_are_kept(work):
    w, d = work
    r = w.import_file(str(d / "m.csv"), "assets:other", "generic", commodity="USD")
    assert (r.posted, r.rows, r.errors) == (1, 2, ("parse error at row 3: missing amount",))
    ok, path = w.reconcile_rows("assets:other")
    assert not ok and "parse_errors: 1" in open(path).read()


def test_one_transaction(spark, tmp_path):
    w = Workspace.init(spark, str(tmp_path / "w"))
    name = w.transfer("2026-02-01", "rent", "assets:bank", "expenses:rent", "120.50", "INR")
    assert w.balance("assets:bank") == Decimal("-120.50") and w.balance("expenses:rent") == Decimal("120.50")
    w.categorize(name, "expenses:a")
    w.categorize(name, "expenses:b")
    assert w.transactions().first().tags == ["category:expenses:b"] and w.replay(2).first().tags == ["category:expenses:a"]
    other = w.transfer("2026-02-02", "rent", "assets:bank", "expenses:rent", "120.50", "INR")
    w.mark_duplicate(other, name, "by hand")
    assert w.balance("assets:bank") == Decimal("-120.50") and w.account("assets:bank") is None
    with pytest.raises(LedgerError):
        w.mark_duplicate(other, name)
    with pytest.raises(LedgerError):
        w.categorize("none", "x")


def test_exports(work):
    w, d = work
    t = w.transactions()
    n = w.export("csv", str(d / "x.csv"))
    lines = (d / "x.csv").read_text().splitlines()
    assert lines[0] == export.CSV_HEAD and len(lines) == 1 + 2 * n
    w.export("json", str(d / "x.json"))
    data = json.loads((d / "x.json").read_text())["transactions"]
    assert len(data) == n and [x["date"] for x in data] == sorted(x["date"] for x in data)
    w.export("beancount", str(d / "x.bean"))
    text = (d / "x.bean").read_text()
    assert text.startswith(export.BANNER + '\noption "operating_currency" "USD"\n\n2026-01-01 commodity USD\n') and "open Assets:Bank:Checking" in text and '  category: "income:salary"' in text
    assert ledger.unbalanced(t).count() == 0


def test_refusals(work, spark, tmp_path):
    w, d = work
    for bad in (["a=1:USD"], ["a=1:USD", "b=-2:USD"], ["a", "b=1:USD"], ["a:=1:USD", "b=-1:USD"]):
        with pytest.raises(LedgerError):
            w.add_transaction("2026-01-01", "x", bad)
    for call in (
        lambda: w.add_transaction("01/01/2026", "x", ["a=1:USD", "b=-1:USD"]),
        lambda: w.add_account("a", "other"),
        lambda: w.add_account("a::b", "asset"),
        lambda: w.import_file(str(d / "s.csv"), BANK, "nothing"),
        lambda: w.export("pdf", str(d / "x")),
        lambda: w.export("csv", "../x"),
        lambda: w.why("nothing"),
        lambda: w.mark_duplicate("a", "a"),
        lambda: guard_path(""),
        lambda: Workspace(spark, str(tmp_path / "none")),
    ):
        with pytest.raises(LedgerError):
            call()


def test_a_changed_log_is_noticed(work):
    w, _ = work
    log = w.table("log")
    assert events.broken(log).count() == 0
    changed = log.withColumn("payload_json", F.when(F.col("seq") == 2, "{}").otherwise(F.col("payload_json")))
    assert [(r.seq, r.reason) for r in events.broken(changed).collect()] == [(2, "content_hash mismatch")]
    assert [r.reason for r in events.broken(log.where("seq <> 3")).collect()] == ["prev_hash mismatch"]
    with pytest.raises(Exception, match="unknown event kind"):
        events.checked_kinds(log.withColumn("kind", F.lit("other"))).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.csv").write_text(GENERIC)
    (tmp_path / "r.yaml").write_text(RULES)
    d = ["--dir", str(tmp_path / "w")]
    go = lambda *a: cli.run([*a], spark)
    assert go("balance", *d, "--account", BANK) == 1
    assert go("init", *d) == 0 and go("adapters") == 0
    assert go("account", "add", *d, "--id", BANK, "--type", "asset", "--commodity", "USD") == 0
    assert go("import", *d, str(tmp_path / "s.csv"), "--account", BANK, "--adapter", "generic", "--commodity", "USD") == 0
    assert go("tx", "add", *d, "--date", "2026-01-03", "--payee", "STARBUCKS STORE 12345", "--posting", f"{BANK}=-6.50:USD", "--posting", "expenses:food=6.50:USD") == 0
    assert go("dedupe", *d) == 0 and go("rules", "apply", *d, "--file", str(tmp_path / "r.yaml")) == 0
    assert go("reconcile", *d, "--account", BANK, "--rows") == 0
    assert go("reconcile", *d, "--account", BANK, "--balance", "2409.20", "--as-of", "2026-01-07", "--commodity", "USD") == 0
    assert go("reconcile", *d, "--account", BANK, "--balance", "1", "--as-of", "2026-01-07", "--commodity", "USD") == 1
    assert go("verify", *d) == 0 and go("replay", *d, "--through", "3") == 0 and go("rebuild", *d) == 0
    assert go("export", *d, "--format", "beancount", "--out", str(tmp_path / "x.bean")) == 0
    capsys.readouterr()
    assert go("balance", *d, "--account", BANK, "--commodity", "USD") == 0
    assert capsys.readouterr().out.strip() == f"{BANK} 2409.2 USD"


def _many(n):
    return "Date,Description,Amount,Currency,Balance\n" + "".join(f"2026-01-{k % 28 + 1:02d},SHOP {k % 5},{'-' * (k % 2)}{k + 1}.50,USD,1\n" for k in range(n))


def _whole(w):
    """verify() holds the tables against the replayed log; these are the rows."""
    w.verify()
    return sorted((t.id, t.payee, t.duplicate_of, tuple(t.tags)) for t in w.transactions().collect())


def test_rows_of_a_table_are_sealed_in_blocks_and_not_on_the_driver(spark, tmp_path, monkeypatch):
    own = events.seal
    sealed = []
    monkeypatch.setattr(events, "SEALED", 16)
    monkeypatch.setattr(events, "seal", lambda payloads, *tip: own(sealed.append(list(payloads)) or sealed[-1], *tip))
    (tmp_path / "s.csv").write_text(_many(100))
    w = Workspace.init(spark, str(tmp_path / "w"))
    first = w.import_file(str(tmp_path / "s.csv"), BANK, "generic", commodity="USD")
    assert (first.posted, first.skipped, first.rows, w.counts()["transactions"]) == (100, 0, 100, 100)
    assert w.apply_rules([rules.Rule("shops", "expenses:shop", payee_regex="[12]$")])["applied"] == 40
    assert max(map(len, sealed)) < 10  # accounts and the batch; posted and categorized events by tasks
    log = w.table("log")
    assert [r.seq for r in log.orderBy("seq").collect()] == list(range(1, log.count() + 1)) and events.broken(log).count() == 0
    refs = [json.loads(json.loads(r.payload_json)["transaction"])["postings"][0]["memo"] for r in log.where("kind = 'posted'").orderBy("seq").collect()]
    assert refs == [f"generic:row:{k}" for k in range(2, 102)]
    assert sum(t[3] == ("category:expenses:shop",) for t in _whole(w)) == 40


def test_changes_are_laid_over_the_transactions_or_written_into_them(spark, tmp_path, monkeypatch):
    (tmp_path / "s.csv").write_text(_many(12))
    w = Workspace.init(spark, str(tmp_path / "w"))
    w.import_file(str(tmp_path / "s.csv"), BANK, "generic", commodity="USD")
    posted = w.manifest["transactions"]
    ids = [r.id for r in w.transactions().orderBy("id").collect()]
    for category in ("expenses:a", "expenses:b"):
        w.categorize(ids[0], category)
    w.mark_duplicate(ids[1], ids[2])
    assert w.manifest["transactions"] == posted and w.manifest["changed"] == 3  # what is there isn't written again
    over = _whole(w)
    assert over[0][3] == ("category:expenses:b",) and over[1][2] == ids[2]
    monkeypatch.setattr(store, "CHANGES", 3)
    w.categorize(ids[0], "expenses:c")
    assert (len(w.manifest["transactions"]), w.manifest["changes"]) == (1, [])
    w.categorize(ids[3], "expenses:d")
    assert [t[3] for t in _whole(w)][:4] == [("category:expenses:c",), (), (), ("category:expenses:d",)] and _whole(w)[1][2] == ids[2]
    laid = _whole(w)
    assert w.rebuild() and _whole(w) == laid and w.manifest["changes"] == []


def test_caps_of_an_import_can_be_raised(spark, tmp_path):
    (tmp_path / "s.csv").write_text(_many(8))
    w = Workspace.init(spark, str(tmp_path / "w"))
    for caps in ({"max_rows": 7}, {"max_bytes": 100}):
        with pytest.raises(LedgerError):
            w.import_file(str(tmp_path / "s.csv"), BANK, "generic", commodity="USD", **caps)
    assert w.import_file(str(tmp_path / "s.csv"), BANK, "generic", commodity="USD", **workspace.UNCAPPED).posted == 8


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("shop"))
    k = F.col("id")
    customers = spark.range(60).select(k.alias("c_custkey"), F.format_string("Customer#%09d", k).alias("c_name"), (k * 200 - 999).cast("double").alias("c_acctbal"))
    customers.coalesce(1).write.parquet(f"{d}/customer.parquet")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(statements, "MAX_BYTES", 100)  # the customers' statement is larger
        workspace.made(spark, d)
    return d


def test_all_customers_are_imported_however_large_their_statement_is(spark, shop):
    assert [(i.posted, i.skipped, i.rows) for i in workspace.made(spark, shop)["imports"]] == [(58, 0, 60), (0, 58, 60), (58, 0, 60)]


def test_lines_of_a_proof_stay_where_they_lie(spark, tmp_path):
    w = Workspace.init(spark, str(tmp_path / "w"))
    rent = w.transfer("2026-02-02", "rent", "assets:bank", "expenses:rent", "120.50", "INR")
    zero = w.add_transaction("2026-02-01", "zero", ["assets:bank=5:INR", "assets:bank=-5:INR"])
    late = w.transfer("2026-02-09", "late", "expenses:rent", "assets:bank", "1000", "INR")
    twice = w.transfer("2026-02-02", "rent", "assets:bank", "expenses:rent", "120.50", "INR")
    w.mark_duplicate(twice, rent)
    t, path = w.reconcile("assets:bank", "1", "2026-02-05", "INR", "0")
    lines = reconcile.lines(w.transactions(), "assets:bank", "INR", "2026-02-05").repartition(3)
    parts = reconcile.proof_parts("assets:bank", "INR", "2026-02-05", lines, reconcile.summary(lines, "1"))
    assert [[r.value for r in p.collect()] for p in parts if not isinstance(p, str)] == [[f"| 2026-02-01 | `{zero}` | zero | 0 |", f"| 2026-02-02 | `{rent}` | rent | -120.5 |"], [f"| 2026-02-02 | `{twice}` | rent | -120.5 |"], [f"| 2026-02-09 | `{late}` | late | 1000 |"]]
    table = "| date | tx | payee | amount |\n|---|---|---|---|\n"
    text = open(path).read()
    assert text.endswith(f"- unmatched: 2\n\n## Included postings (skip duplicates)\n\n{table}| 2026-02-01 | `{zero}` | zero | 0 |\n| 2026-02-02 | `{rent}` | rent | -120.5 |\n\n## Skipped duplicates\n\n{table}| 2026-02-02 | `{twice}` | rent | -120.5 |\n\n## After as_of (excluded)\n\n{table}| 2026-02-09 | `{late}` | late | 1000 |\n")
    assert os.listdir(os.path.dirname(path)) == [os.path.basename(path)] or all(".crc" in f for f in os.listdir(os.path.dirname(path)) if f != os.path.basename(path))


def test_exports_do_not_reach_the_driver(spark, shop, monkeypatch):
    monkeypatch.setattr(export, "export_text", None)
    assert [tuple(r) for r in workspace.exported(spark, shop).collect()] == [("csv", 235, export.CSV_HEAD), ("json", 117, "2026-01-01"), ("beancount", 117, 'option "operating_currency" "USD"')]


@pytest.mark.parametrize("form", ["csv", "json", "beancount"])
def test_export_files_are_the_export(spark, shop, tmp_path, form):
    t = workspace.made(spark, shop)["w"].transactions()
    export.export_files(t.repartition(3), form, f"file://{tmp_path}/x")
    lines = [r.value for part in ("head", "rows", *["tail"] * (form == "json")) for r in spark.read.text(f"file://{tmp_path}/x/{part}", lineSep="\n").toLocalIterator()]
    assert "\n".join(lines).rstrip("\n") == export.export_text(t, form).rstrip("\n")


def test_files_of_a_plug_in_are_its_export(work, spark, tmp_path, monkeypatch):
    w, _ = work
    order = (F.col("id").alias("transaction_id"), F.lit(0).alias("ordinal"))
    monkeypatch.setitem(export.EXPORTERS, "own", lambda t: ("# head\n", t.select("date", *order, F.concat("payee", F.lit("\n")).alias("text")), "# end\n"))
    export.export_files(w.transactions(), "own", f"file://{tmp_path}/own")
    lines = [r.value for part in ("head", "rows", "tail") for r in spark.read.text(f"file://{tmp_path}/own/{part}").collect()]
    assert lines == export.export_text(w.transactions(), "own").splitlines() and lines[-1] == "# end"


def test_lines_of_a_plug_in_do_not_reach_the_driver(spark, shop, monkeypatch):
    monkeypatch.setattr(export, "export_text", None)
    lines = {r.line: r.copies for r in workspace.plugged_in(spark, shop).collect()}
    assert (len(lines), lines["Customer#000000007"], lines["# end"], lines["lunch"]) == (61, 2, 1, 1)


def _nodes(plan):
    yield plan
    for k in range(plan.children().size()):
        yield from _nodes(plan.children().apply(k))


def test_the_chain_is_checked_without_moving_payloads(work):
    plan = events.broken(work[0].table("log"))._jdf.queryExecution().optimizedPlan()
    sorted_ = [{n.output().apply(k).name() for k in range(n.output().size())} for n in _nodes(plan) if n.nodeName() == "Window"]
    assert any("content_hash" in names for names in sorted_) and not any("payload_json" in names for names in sorted_)


def test_ledgers_are_made_once_to_be_compared(spark):
    left = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    right = spark.createDataFrame([("a", 1), ("b", 5), ("c", 3)], "id string, x int")
    found = events.differences(left, right)
    assert sorted((r.id, r.side) for r in found.collect()) == [("a", "left"), ("b", "left"), ("b", "right")]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


@pytest.fixture
def cluster(spark, tmp_path, monkeypatch):
    """As on a cluster whose shared folder is named without a scheme: a path of the default file system."""
    own = type(spark.conf).get
    monkeypatch.setattr(spark.sparkContext, "master", "spark://127.0.0.1:7077")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: str(tmp_path / "shared") if key == "spark.checkpoint.dir" else own(self, key, *default))
    return tmp_path


def test_the_shared_folder_may_be_named_without_a_scheme(spark, cluster):
    w = Workspace.init(spark, files.scratch(spark, "workspace"))
    assert w.path.startswith(f"file:{cluster}/shared/workspace-")
    path = files.write(spark.createDataFrame([(0, k, line) for k, line in enumerate(_many(3).splitlines()[1:])], "file long, n long, line string"), files.HEADS["generic_csv"], files.scratch(spark, "statement"))
    assert w.import_file(path, BANK, "generic", commodity="USD").posted == 3
    assert workspace.required(spark).first().said == "no workspace at ... (run init)"


def test_a_path_of_a_person_needs_a_scheme_on_a_cluster(spark, cluster):
    with pytest.raises(LedgerError, match="needs the scheme"):
        Workspace.init(spark, str(cluster / "w"))
    assert Workspace.init(spark, f"file:{cluster}/w").schema_version() == store.SCHEMA_VERSION
    assert [store.has_scheme(p) for p in ("hdfs://h/x", "file:/x", "viewfs:/x", "/x", "x/y", "a:b", "c:/x")] == [True, True, True, False, False, False, False]
