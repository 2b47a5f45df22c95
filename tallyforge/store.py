"""A workspace: a ledger kept as an append-only event log and the tables that follow from it.

    log/            events, one Parquet directory for each commit
    statement_rows/ and import_batches/, likewise
    transactions/, changes/ and accounts/   projections of the log: transactions, links and categories that are laid over
                    them when they are read, and accounts
    manifest.json   the commits that count; replaced last, at once

A commit adds what its own events say to the projections. Only where more than CHANGES links and categories lie over the
transactions, these are written anew with them. Rows that a command finds by the table (an import's, a rule set's, a
proof's) don't reach the driver.

A commit writes its directories first and then the manifest, so a command that dies half way leaves nothing behind. One
writer at a time is assumed. All goes through Spark's file systems: on a cluster a workspace lies in a folder that driver and
executors share, named with its scheme.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass
from datetime import date as Date
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import types as T
from .functions import scalars as S
from .operators import convert, dedupe, events, export, importing, ledger, reconcile, rules
from .sources import statements

SCHEMA_VERSION = 3
_SCHEMAS = {"log": T.EVENT, "statement_rows": T.STATEMENT_ROW, "import_batches": T.BATCH, "transactions": T.TRANSACTION, "changes": T.CHANGE, "accounts": T.ACCOUNT}
#: Links and categories that lie over the transactions, at most: each task that reads transactions holds them.
CHANGES = 1 << 16
#: Bytes of a statement that a task converts, about.
PART_BYTES = 1 << 20


class LedgerError(ValueError):
    """A command that can't be done."""


def has_scheme(path: str) -> bool:
    """Whether path says which file system it is of: Spark's own names may have one slash after the scheme."""
    return "://" in path or re.match("[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def guard_path(path: str) -> str:
    """path, if it isn't empty and doesn't climb."""
    if not path or ".." in path.replace("\\", "/").split("/"):
        raise LedgerError(f"path '{path}' may not be empty or hold '..'")
    return path


def report_name(name: str) -> str:
    if ".." in name or "/" in name or "\\" in name:
        raise LedgerError(f"report name '{name}' may not hold '..' or a separator")
    return name


@dataclass(frozen=True)
class Imported:
    batch_id: str
    posted: int
    skipped: int
    rows: int
    errors: tuple[str, ...]
    duplicate: bool = False


class Folder:
    """Small files of a folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        if not has_scheme(path):
            if not spark.sparkContext.master.startswith("local"):
                raise LedgerError("on a cluster, a workspace's path needs the scheme of a folder that driver and executors share")
            path = f"file://{os.path.abspath(path)}"
        self.spark, self.uri, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.files = self._path(self.uri).getFileSystem(self.conf)

    def _path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def at(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def exists(self, name: str) -> bool:
        return self.files.exists(self._path(self.at(name)))

    def make(self, name: str) -> None:
        self.files.mkdirs(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self.files.open(self._path(self.at(name)))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.files.create(self._path(self.at(name)), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Writes the file anew, at once: it is there as it was, or as it is to be."""
        temporary = f"{name}.{uuid.uuid4().hex}"
        self.write(temporary, text)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        whole = self._path(self.uri).toUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole, self.conf).rename(self._path(self.at(temporary)), self._path(self.at(name)), options)

    def join(self, name: str, pieces: list[str | DataFrame]) -> None:
        """Writes a file of texts and of frames (value) whose rows are lines. Rows go from file to file."""
        stream = self.files.create(self._path(self.at(name)), True)
        try:
            for piece in pieces:
                if isinstance(piece, str):
                    stream.write(bytearray(piece, "utf-8"))
                    continue
                part = f"{name}.{uuid.uuid4().hex}"
                try:
                    piece.write.option("lineSep", "\n").text(self.at(part))
                    for f in sorted(str(x.getPath().toString()) for x in self.files.globStatus(self._path(self.at(f"{part}/part-*")))):
                        lines = self.files.open(self._path(f))
                        try:
                            self.jvm.org.apache.commons.io.IOUtils.copyLarge(lines, stream)
                        finally:
                            lines.close()
                finally:
                    self.remove(part)
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.files.delete(self._path(self.at(name)), True)

    def copy_from(self, uri: str, name: str) -> None:
        source = self._path(uri)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(self.conf), source, self.files, self._path(self.at(name)), False, True, self.conf)


class Workspace:
    """A workspace in a folder: a local path, or one with a scheme that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.folder = spark, path, Folder(spark, path)
        if not self.folder.exists("manifest.json"):
            raise LedgerError(f"no workspace at {path} (run init)")

    @classmethod
    def init(cls, spark: SparkSession, path: str) -> Workspace:
        """Creates the workspace if there is none."""
        folder = Folder(spark, path)
        for d in ("artifacts", "reports"):
            folder.make(d)
        if not folder.exists("config.json"):
            folder.replace("config.json", json.dumps({"version": 1, "default_commodity": "INR", "telemetry": False}))
        if not folder.exists("manifest.json"):
            folder.replace("manifest.json", json.dumps({"schema_version": SCHEMA_VERSION, **{name: [] for name in _SCHEMAS}}, indent=1))
        return cls(spark, path)

    @property
    def manifest(self) -> dict:
        return json.loads(self.folder.read("manifest.json"))

    def schema_version(self) -> int:
        return int(self.manifest.get("schema_version", 0))

    def table(self, name: str) -> DataFrame:
        return self._stored(name, self.manifest) if name != "transactions" else self.transactions()

    def _stored(self, name: str, manifest: dict) -> DataFrame:
        parts = [self.folder.at(p) for p in manifest.get(name, [])]
        empty = self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(empty.schema).parquet(*parts) if parts else empty

    def transactions(self) -> DataFrame:
        manifest = self.manifest
        posted = self._stored("transactions", manifest)
        return events.laid(posted, self._stored("changes", manifest), few=True) if manifest.get("changes") else posted

    def events(self, seq: int | None = None) -> DataFrame:
        return events.through(self.table("log"), seq)

    def account(self, account_id: str) -> Row | None:
        return self.table("accounts").where(F.col("id") == account_id).first()

    def statement_row(self, batch_id: str, row_number: int) -> Row | None:
        return self.table("statement_rows").where((F.col("batch_id") == batch_id) & (F.col("row_number") == row_number)).first()

    def counts(self) -> dict[str, int]:
        t = self.transactions().agg(F.count("*"), F.coalesce(F.sum(F.size("postings")), F.lit(0))).first()
        return {"events": self.events().count(), "transactions": t[0], "postings": t[1]}

    def _commit(self, payloads: list[tuple[str, str]], tables: dict[str, DataFrame] | None = None, rows: DataFrame | None = None, about: int = 0) -> tuple[int, str]:
        """Seals payloads onto the log, and after them rows (place, kind, payload_json; about so many) by their place, adds
        what they say to the projections, and makes all of it count at once. The log's tip after it."""
        manifest = self.manifest
        last = events.tip(self.table("log")).first()
        number = f"{last.seq + 1:012d}-{uuid.uuid4().hex[:8]}"
        log = f"log/{number}"
        sealed = events.seal(payloads, last.seq, last.content_hash)
        self.spark.createDataFrame(sealed, T.EVENT).coalesce(1).write.parquet(self.folder.at(log))
        tip = (sealed[-1][0], sealed[-1][5]) if sealed else (last.seq, last.content_hash)
        if rows is not None:
            tip = self._seal_rows(rows, about, log, tip)
        for name, added in (tables or {}).items():
            added.write.parquet(self.folder.at(f"{name}/{number}"))
            manifest[name] = [*manifest[name], f"{name}/{number}"]
        manifest["log"] = [*manifest["log"], log]
        self._project(manifest, number, log)
        self.folder.replace("manifest.json", json.dumps(manifest, indent=1))
        return tip

    def _seal_rows(self, rows: DataFrame, about: int, log: str, tip: tuple[int, str]) -> tuple[int, str]:
        """Appends rows to a directory of the log. The chain is a sequence: rows are dealt out by their place, and sealed a
        block after the other, each by one task. The tip after them."""
        staged = f"staged/{uuid.uuid4().hex}"
        try:
            dealt = rows.repartitionByRange(max(1, -(-about // events.SEALED)), "place").withColumn("block", F.spark_partition_id())
            dealt.write.partitionBy("block").parquet(self.folder.at(staged))
            if not self.folder.files.globStatus(self.folder._path(self.folder.at(f"{staged}/block=*"))):
                return tip
            dealt = self.spark.read.parquet(self.folder.at(staged))
            blocks: list[list[int]] = []  # first, last and rows of each: neighbours together if they are small
            for r in sorted(dealt.groupBy("block").count().collect()):
                if blocks and blocks[-1][2] + r[1] <= events.SEALED:
                    blocks[-1] = [blocks[-1][0], r[0], blocks[-1][2] + r[1]]
                else:
                    blocks.append([r[0], r[0], r[1]])
            for first, last, count in blocks:
                own = dealt.where(F.col("block").between(first, last)).coalesce(1).sortWithinPartitions("place")
                own.select("kind", "payload_json").mapInArrow(events.sealing(*tip), T.EVENT).write.mode("append").parquet(self.folder.at(log))
                end = self.spark.read.parquet(self.folder.at(log)).where(F.col("seq") == tip[0] + count).select("seq", "content_hash").first()
                tip = (end.seq, end.content_hash)
            return tip
        finally:
            self.folder.remove(staged)

    def _project(self, manifest: dict, number: str, log: str) -> None:
        """Adds what the events of a directory of the log say to the projections."""
        new = events.checked_kinds(self.spark.read.schema(self.spark.createDataFrame([], T.EVENT).schema).parquet(self.folder.at(log)))
        kinds = {r[0]: r[1] for r in new.groupBy("kind").count().collect()}  # a row for each kind
        changed = kinds.get("deduped", 0) + kinds.get("categorized", 0)
        written: dict[str, DataFrame] = {}
        if kinds.get("posted"):
            written["transactions"] = events.posted(new)
        if changed:
            written["changes"] = events.changes(new)
        for name, rows in written.items():
            rows.write.parquet(self.folder.at(f"{name}/{number}"))
            manifest[name] = [*manifest.get(name, []), f"{name}/{number}"]
        manifest["changed"] = manifest.get("changed", 0) + changed
        if kinds.get("account_upserted"):
            now = events.accounts(new)
            before = self._stored("accounts", manifest).join(now.select("id"), "id", "left_anti")
            before.unionByName(now).coalesce(1).write.parquet(self.folder.at(f"accounts/{number}"))
            manifest["accounts"] = [f"accounts/{number}"]
        if manifest["changed"] > CHANGES:
            whole = events.laid(self._stored("transactions", manifest), self._stored("changes", manifest), few=False)
            whole.write.parquet(self.folder.at(f"transactions/{number}-whole"))
            manifest.update(transactions=[f"transactions/{number}-whole"], changes=[], changed=0)

    def _project_whole(self, manifest: dict, number: str) -> None:
        log = self._stored("log", manifest)
        for name, rows in (("transactions", events.replay(log)), ("accounts", events.accounts(log))):
            rows.write.parquet(self.folder.at(f"{name}/{number}"))
            manifest[name] = [f"{name}/{number}"]
        manifest.update(changes=[], changed=0)

    def add_account(self, account_id: str, kind: str, commodity: str = "INR", name: str | None = None) -> tuple[int, str]:
        a = self._valid(account_id, commodity)
        if kind.lower() not in S.ACCOUNT_TYPES:
            raise LedgerError(f"unknown account type '{kind}' (asset|liability|equity|income|expense)")
        return self._commit([self._account(a.account, S.ACCOUNT_TYPES[kind.lower()], a.commodity, name or account_id)])

    def _valid(self, account: str, commodity: str) -> Row:
        checked = self.spark.range(1).select(S.account_id(F.lit(account)).alias("account"), S.commodity(F.lit(commodity)).alias("commodity")).first()
        if checked.account is None:
            raise LedgerError(f"invalid account id: {account}")
        if checked.commodity is None:
            raise LedgerError(f"invalid commodity: {commodity}")
        return checked

    @staticmethod
    def _account(account_id: str, kind: str, commodity: str, name: str) -> tuple[str, str]:
        return events.payload("account_upserted", account={"id": account_id, "account_type": kind, "commodity": commodity, "name": name})

    def add_transaction(self, date: str, payee: str, postings: list[str]) -> str:
        """Posts a balanced transaction of postings account=amount:commodity; its id."""
        try:
            day = Date.fromisoformat(date)
        except ValueError:
            raise LedgerError(f"invalid date '{date}' (want YYYY-MM-DD)") from None
        specs = self.spark.createDataFrame(list(enumerate(postings)), "n int, spec string")
        legs = specs.select("n", "spec", S.posting_literal(F.col("spec")).alias("p")).orderBy("n").collect()
        for leg in legs:
            if None in (leg.p.account, leg.p.amount, leg.p.commodity):
                raise LedgerError(f"invalid posting '{leg.spec}' (want account=amount:commodity)")
        name = events.uuid7()
        body = {"id": name, "date": day.isoformat(), "payee": payee, "narration": None, "import_batch_id": None, "duplicate_of": None, "tags": [], "row_fingerprint": None}
        body["postings"] = [leg.p.asDict() | {"amount": str(leg.p.amount)} for leg in legs]
        one = self.spark.createDataFrame([(json.dumps(body),)], "j string").select(F.from_json("j", T.TRANSACTION).alias("t")).select("t.*")
        wrong = ledger.unbalanced(one).first()
        if wrong:
            raise LedgerError(wrong.message)
        self._commit([self._posted(one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])])
        return name

    @staticmethod
    def _posted(transaction_json: str) -> tuple[str, str]:
        return events.payload("posted", transaction=transaction_json)

    def import_file(self, path: str, account: str, adapter: str | statements.Adapter, expense: str = "expenses:uncategorized", income: str = "income:uncategorized", commodity: str = "INR", max_bytes: int = statements.MAX_BYTES, max_rows: int = statements.MAX_ROWS) -> Imported:
        """Imports one statement file. A file that was imported before changes nothing; one over a cap is refused."""
        layout = adapter if isinstance(adapter, statements.Adapter) else statements.adapter(adapter)
        if layout is None:
            raise LedgerError(f"unknown adapter '{adapter}'")
        bank = self._valid(account, commodity)
        uri = path if has_scheme(path) else f"file://{os.path.abspath(path)}"
        file = self.spark.read.format("binaryFile").load(uri).select("length", F.sha2("content", 256).alias("sha"))
        size = file.select("length").first()
        if size.length > max_bytes:
            raise LedgerError(f"file exceeds {max_bytes} bytes")
        sha = file.first().sha
        self.folder.copy_from(uri, f"artifacts/{layout.id}-{sha[:16]}.bin")
        batch = Row(id=events.uuid7(), adapter=layout.id, account_id=bank.account, source_path=path, source_sha256=sha)
        options = convert.Options(bank.account, self._valid(expense, commodity).account, self._valid(income, commodity).account, bank.commodity, batch.id)
        raw = statements.read(self.spark, uri, layout, max_bytes, max_rows)
        failed = raw.where("schema_error is not null").first()
        if failed:
            raise LedgerError(failed.schema_error)
        parts = -(-size.length // PART_BYTES)  # one task reads the file, many convert its rows
        converted = convert.convert(raw.repartition(parts, "row_number") if parts > 1 else raw, layout.id, options).cache()
        try:
            rows = convert.statement_rows(converted, layout.id, options)
            errors = tuple(r.error for r in rows.where("error is not null").orderBy("row_number").limit(20).collect())
            incoming = convert.transactions(converted)
            n_rows, n_incoming = rows.count(), incoming.count()
            if not n_rows:
                raise LedgerError("no transactions converted")
            known = self.table("import_batches").where((F.col("adapter") == layout.id) & (F.col("source_sha256") == sha) & (F.col("account_id") == bank.account)).first()
            if known:
                return Imported(known.id, 0, n_incoming, n_rows, errors, True)
            numbered = converted.where("parse_error is null and error is null").select(*incoming.columns, "row_number")
            new = importing.new_transactions(numbered, self._stored("transactions", self.manifest).select("id"))
            new = new.select("row_number", F.to_json(F.struct(*incoming.columns), {"ignoreNullFields": "false"}).alias("transaction"))
            wanted = [(options.bank, "asset"), (options.expense, "expense"), (options.income, "income")]
            typed = self.spark.createDataFrame([(a, d, commodity, n) for (a, d), n in zip(wanted, (account, expense, income), strict=True)], "id string, role string, commodity string, name string")
            typed = typed.select("id", F.coalesce(S.account_type(F.col("id")), "role").alias("account_type"), S.commodity(F.col("commodity")).alias("commodity"), "name")
            payloads = [self._account(*a) for a in importing.new_accounts(typed, self.table("accounts")).collect()]
            payloads.append(events.payload("imported", batch_id=batch.id, source_path=path, source_sha256=sha, row_count=n_rows))
            stamp = self.spark.createDataFrame([(batch.id, layout.id, bank.account, path, sha, datetime.now(timezone.utc), n_rows)], T.BATCH)
            before = events.tip(self.table("log")).first().seq + len(payloads)
            seq, _ = self._commit(payloads, {"statement_rows": rows.select(*self.table("statement_rows").columns), "import_batches": stamp}, events.payloads("posted", new, "row_number"), n_incoming)
            return Imported(batch.id, seq - before, n_incoming - (seq - before), n_rows, errors)
        finally:
            converted.unpersist()

    def balance(self, account: str, commodity: str = "INR") -> Decimal:
        a = self._valid(account, commodity)
        return ledger.balance(self.transactions(), a.account, a.commodity).first().balance

    def dedupe(self, days: int = 1) -> list[Row]:
        """Links duplicates; all links of a run are one commit."""
        links = dedupe.plan(self.transactions(), days).orderBy("duplicate_id").collect()
        if links:
            self._commit([events.payload("deduped", duplicate_id=r.duplicate_id, survivor_id=r.survivor_id, strategy=r.strategy, explanation=r.explanation) for r in links])
        return links

    def mark_duplicate(self, duplicate: str, survivor: str, explanation: str = "") -> None:
        wanted = self.spark.createDataFrame([(duplicate, survivor)], "duplicate_id string, survivor_id string")
        wrong = dedupe.invalid(wanted, self.transactions()).first()
        if wrong:
            raise LedgerError(wrong.reason)
        self._commit([events.payload("deduped", duplicate_id=duplicate, survivor_id=survivor, strategy="manual", explanation=explanation)])

    def categorize(self, transaction_id: str, category: str, rule_id: str = "manual", confidence: int = 100, reasons: tuple[str, ...] = ()) -> None:
        """Tags one transaction with a category instead of any it has."""
        if self.transactions().where(F.col("id") == transaction_id).first() is None:
            raise LedgerError(f"no transaction {transaction_id}")
        self._commit([events.payload("categorized", transaction_id=transaction_id, category=category, rule_id=rule_id, confidence=confidence, reasons=list(reasons))])

    def transfer(self, date: str, payee: str, source: str, target: str, amount: str, commodity: str) -> str:
        """Posts what goes from one account to another."""
        plain = amount.strip().lstrip("+")
        return self.add_transaction(date, payee, [f"{target}={plain}:{commodity}", f"{source}={plain[1:] if plain.startswith('-') else '-' + plain}:{commodity}"])

    def apply_rules(self, rule_set: list[rules.Rule]) -> dict:
        """Tags by rules; all tags of a run are one commit. Counts and conflicts."""
        seen = rules.evaluate(self.transactions(), rule_set)
        out = rules.counts(seen).first().asDict() | {"conflict_messages": [r.message for r in rules.conflicts(seen).orderBy("transaction_id").collect()]}
        if out["applied"]:
            self._commit([], rows=events.payloads("categorized", rules.applied(seen), "transaction_id"), about=out["applied"])
        return out

    def reconcile(self, account: str, stated: str, as_of: str, commodity: str = "INR", starting: str = "0") -> tuple[Row, str]:
        """Totals of the proof and the report's path. A difference is recorded like a balance."""
        a = self._valid(account, commodity)
        Date.fromisoformat(as_of)
        lines = reconcile.lines(self.transactions(), a.account, a.commodity, as_of).cache()
        totals = reconcile.summary(lines, Decimal(stated.replace(",", "")), Decimal(starting.replace(",", "")))
        t = totals.first()
        name = report_name(reconcile.proof_name(a.account, as_of))
        self.folder.join(f"reports/{name}", reconcile.proof_parts(a.account, a.commodity, as_of, lines, totals))
        lines.unpersist()
        plain = reconcile._plain
        self._commit([events.payload("reconciled", account=a.account, as_of=as_of, ending_balance=plain(t.stated_ending), matched=t.matched, unmatched=t.skipped_duplicate + t.after_as_of, unexplained_delta=plain(t.unexplained_delta), report_path=f"reports/{name}")])
        return t, f"{self.path}/reports/{name}"

    def reconcile_rows(self, account: str) -> tuple[bool, str]:
        a = self._valid(account, "INR").account
        buckets = reconcile.row_buckets(self.table("statement_rows"), a)
        text, ok = reconcile.rows_markdown(a, buckets, reconcile.uncovered(self.transactions(), self.table("statement_rows"), a))
        name = report_name(f"reconcile-rows-{a.replace(':', '_')}.md")
        self.folder.write(f"reports/{name}", text)
        return ok, f"{self.path}/reports/{name}"

    def verify_chain(self) -> None:
        wrong = events.broken(self.table("log")).orderBy("seq").first()
        if wrong:
            raise LedgerError(f"event {wrong.seq}: {wrong.reason}")

    def replay(self, seq: int | None = None) -> DataFrame:
        self.verify_chain()
        return events.replay(self.table("log"), seq)

    def verify(self) -> Row:
        """Counts and hash, after checking the chain, the invariants, and that the tables are what the log makes."""
        self.verify_chain()
        if events.differences(self.transactions(), events.replay(self.table("log"))).first():
            raise LedgerError("tables differ from the replayed log")
        wrong = ledger.unbalanced(self.transactions()).first()
        if wrong:
            raise LedgerError(wrong.message)
        return ledger.verify(self.transactions()).first()

    def rebuild(self) -> Row:
        """Projections made anew from the log; batches and statement rows stay."""
        self.verify_chain()
        manifest = self.manifest
        if manifest["log"]:
            self._project_whole(manifest, f"rebuilt-{uuid.uuid4().hex[:8]}")
            self.folder.replace("manifest.json", json.dumps(manifest, indent=1))
        return ledger.verify(self.transactions()).first()

    def why(self, name: str) -> list[Row]:
        """Steps for a transaction id, or for a statement row named batch:number and its transaction."""
        first: list[Row] = []
        batch, _, number = name.rpartition(":")
        if batch and number.lstrip("-").isdigit():
            found = events.row_step(self.table("statement_rows"), batch, int(number)).collect()
            if not found:
                raise LedgerError(f"no statement row {name}")
            first, name = [Row(seq=0, kind=found[0].kind, summary=found[0].summary)], found[0].transaction_id
            if name is None:
                return first
        steps = events.why(self.table("log"), self.transactions(), name).collect()
        if not steps:
            raise LedgerError(f"no events reference transaction {name}")
        return first + steps

    def export(self, form: str, out: str) -> int:
        """Writes an export to a file; the number of transactions in it."""
        if form not in export.EXPORTERS:
            raise LedgerError(f"unknown format '{form}' (json|beancount|csv)")
        guard_path(out)
        with open(out, "w", encoding="utf-8", newline="") as f:
            f.writelines(export.export_parts(self.transactions(), form))
        return ledger.active(self.transactions()).count()
