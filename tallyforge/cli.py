"""Command line: python -m tallyforge.cli COMMAND."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import rules
from .sources import statements
from .store import LedgerError, Workspace


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, into=sub, **options):
        c = into.add_parser(name, **options)
        c.add_argument("--dir", default=".tallyforge")
        return c

    command("init", help="create a workspace")
    account = sub.add_parser("account", help="chart of accounts").add_subparsers(dest="action", required=True)
    c = command("add", account)
    c.add_argument("--id", required=True)
    c.add_argument("--type", required=True)
    c.add_argument("--commodity", default="INR")
    c.add_argument("--name")
    tx = sub.add_parser("tx", help="post transactions").add_subparsers(dest="action", required=True)
    c = command("add", tx)
    c.add_argument("--date", required=True)
    c.add_argument("--payee", required=True)
    c.add_argument("--posting", action="append", required=True, help="account=amount:commodity")
    c = command("balance", help="balance of an account")
    c.add_argument("--account", required=True)
    c.add_argument("--commodity", default="INR")
    c = command("replay", help="replay the log, up to an event if one is given")
    c.add_argument("--through", type=int)
    c = command("import", help="import a statement")
    c.add_argument("path")
    c.add_argument("--account", required=True)
    c.add_argument("--adapter", required=True)
    c.add_argument("--offset-expense", default="expenses:uncategorized")
    c.add_argument("--offset-income", default="income:uncategorized")
    c.add_argument("--commodity", default="INR")
    r = sub.add_parser("rules", help="category rules").add_subparsers(dest="action", required=True)
    c = command("apply", r)
    c.add_argument("--file", required=True)
    c = command("dedupe", help="link duplicates")
    c.add_argument("--window-days", type=int, default=1)
    c = command("reconcile", help="prove an ending balance or the coverage of statement rows")
    c.add_argument("--account", required=True)
    c.add_argument("--balance")
    c.add_argument("--as-of")
    c.add_argument("--commodity", default="INR")
    c.add_argument("--starting", default="0")
    c.add_argument("--rows", action="store_true")
    c = command("why", help="explain a transaction or a statement row")
    c.add_argument("id")
    c = command("export", help="write json, beancount or csv")
    c.add_argument("--format", default="json")
    c.add_argument("--out", required=True)
    command("verify", help="check chain, invariants and tables")
    command("rebuild", help="make the tables anew from the log")
    sub.add_parser("adapters", help="list layouts")
    return p


def run(argv: list[str], spark: SparkSession) -> int:
    """Runs one command; 0 if it is done, 1 if it can't be or what it proves isn't so."""
    a = _parser().parse_args(argv)
    try:
        return _run(a, spark)
    except (LedgerError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command == "adapters":
        for r in statements.adapters(spark).collect():
            print(f"{r.id}\t{r.name}")
        return 0
    if a.command == "init":
        w = Workspace.init(spark, a.dir)
        print(f"initialized workspace at {a.dir} (schema v{w.schema_version()})")
        return 0
    w = Workspace(spark, a.dir)
    if a.command == "account":
        seq, sealed = w.add_account(a.id, a.type, a.commodity, a.name)
        print(f"account upserted id={a.id} event_seq={seq} hash={sealed}")
    elif a.command == "tx":
        print(f"posted tx={w.add_transaction(a.date, a.payee, a.posting)} postings={len(a.posting)}")
    elif a.command == "balance":
        n = format(w.balance(a.account, a.commodity), "f").rstrip("0").rstrip(".")
        print(f"{a.account} {n} {a.commodity}")
    elif a.command == "replay":
        from .operators import ledger

        rows = w.replay(a.through)
        r = ledger.verify(rows).first()
        print(f"replay through={a.through or 'all'} transactions={r.transaction_count} ledger_hash={r.ledger_hash}")
        return int(r.unbalanced_count > 0)
    elif a.command == "import":
        r = w.import_file(a.path, a.account, a.adapter, a.offset_expense, a.offset_income, a.commodity)
        for e in r.errors:
            print(f"    - {e}")
        print(f"  already imported (idempotent) batch={r.batch_id}" if r.duplicate else f"  posted={r.posted} skipped_existing={r.skipped} batch={r.batch_id}")
    elif a.command == "rules":
        r = w.apply_rules(rules.load_file(a.file))
        print(f"rules applied={r['applied']} conflicts={r['conflicts']} unmatched={r['unmatched']} skipped={r['skipped']}")
        for m in r["conflict_messages"]:
            print(f"  {m}")
    elif a.command == "dedupe":
        for r in w.dedupe(a.window_days):
            print(f"  {r.duplicate_id} -> {r.survivor_id} ({r.strategy}, {r.confidence}) {r.explanation}")
    elif a.command == "reconcile":
        if a.rows:
            ok, path = w.reconcile_rows(a.account)
            print(f"row_reconcile: {'OK' if ok else 'gaps'} report={path}")
            if not ok or a.balance is None:
                return int(not ok)
        if a.balance is None or a.as_of is None:
            raise LedgerError("reconcile requires --balance and --as-of (or pass --rows only)")
        t, path = w.reconcile(a.account, a.balance, a.as_of, a.commodity, a.starting)
        print(f"reconcile account={a.account} as_of={a.as_of} computed={t.computed_ending} stated={t.stated_ending} delta={t.unexplained_delta} report={path}")
        return int(t.unexplained_delta != 0)
    elif a.command == "why":
        for s in w.why(a.id):
            print(f"{s.seq}\t{s.kind}\t{s.summary}")
    elif a.command == "export":
        print(f"exported transactions={w.export(a.format, a.out)} to {a.out}")
    elif a.command in ("verify", "rebuild"):
        r = w.verify() if a.command == "verify" else w.rebuild()
        print(f"{a.command} transactions={r.transaction_count} postings={r.posting_count} ledger_hash={r.ledger_hash}")
        return int(r.unbalanced_count > 0)
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(run(sys.argv[1:], session))
