"""The event log: sealing, verifying, replaying up to a point, and explaining a transaction.

Each event holds the hash of the one before, so sealing is a sequence. The few events of a command are sealed on the driver;
rows of a table are sealed where they lie, a block after the other. All that reads the log is distributed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..types import PAYLOADS, TRANSACTION

#: Events in a block of the chain check: a block is one window, and blocks are joined at their ends.
BLOCK = 1 << 20
#: Events that are sealed by one task, about.
SEALED = 1 << 16

_EVENT = pa.schema([("seq", pa.int64()), *((c, pa.string()) for c in ("id", "at", "kind", "payload_json", "content_hash", "prev_hash"))])


def uuid7() -> str:
    """A time-ordered UUID; made once, on the driver."""
    raw = int(time.time() * 1000).to_bytes(6, "big") + uuid.uuid4().bytes[6:]
    number = int.from_bytes(raw, "big")
    number = number & ~(0xF << 76) | 7 << 76
    return str(uuid.UUID(int=number & ~(3 << 62) | 2 << 62))


def seal(payloads: Iterable[tuple[str, str]], tip_seq: int, tip_hash: str) -> list[tuple]:
    """Rows of the log for (kind, payload as JSON), chained to its tip."""
    out = []
    for kind, payload in payloads:
        if kind not in PAYLOADS:
            raise ValueError(f"unknown event kind {kind}")
        tip_seq += 1
        name, at = uuid7(), datetime.now(timezone.utc).isoformat()
        lines = ("v1", f"prev={tip_hash}", f"id={name}", f"at={at}", f"kind={kind}", f"payload={payload}")
        new = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((tip_seq, name, at, kind, payload, new, tip_hash))
        tip_hash = new
    return out


def sealing(tip_seq: int, tip_hash: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (kind, payload_json) of one partition, in order: rows of the log, chained to its tip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, last = tip_seq, tip_hash
        for batch in batches:
            sealed = seal(zip(*(batch.column(c).to_pylist() for c in ("kind", "payload_json")), strict=True), seq, last)
            if sealed:
                seq, last = sealed[-1][0], sealed[-1][5]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*sealed, strict=True), _EVENT, strict=True)], schema=_EVENT)

    return run


def payloads(kind: str, rows: DataFrame, place: str) -> DataFrame:
    """place, kind and payload_json of an event for each row, whose columns are the payload's fields; place is its order."""
    names = [f.split()[0] for f in PAYLOADS[kind].split(", ")]
    body = F.struct(F.lit(kind).alias("type"), *names)
    return rows.select(F.col(place).alias("place"), F.lit(kind).alias("kind"), F.to_json(body, {"ignoreNullFields": "false"}).alias("payload_json"))


def payload(kind: str, **fields) -> tuple[str, str]:
    return kind, json.dumps({"type": kind, **fields}, separators=(",", ":"), ensure_ascii=False)


def through(events: DataFrame, seq: int | None) -> DataFrame:
    return events if seq is None else events.where(F.col("seq") <= seq)


def tip(events: DataFrame) -> DataFrame:
    """One row: seq and hash of the last event; 0 and zeros for an empty log."""
    last = events.agg(F.max("seq").alias("seq"), F.max_by("content_hash", "seq").alias("content_hash"))
    return last.select(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("content_hash", F.lit(S.GENESIS)).alias("content_hash"))


def with_previous(events: DataFrame, value: str = "content_hash", start: str = S.GENESIS, block: int = BLOCK) -> DataFrame:
    """events with `expected_prev`, the value of the one before by seq.

    Blocks of seq are windows of their own; the last of each block goes to the next with rows. So no task sorts the log.
    """
    numbered = events.withColumn("_block", F.floor(F.col("seq") / block))
    own = Window.partitionBy("_block").orderBy("seq")
    ends = numbered.groupBy("_block").agg(F.max_by(value, "seq").alias("_end"))
    ends = ends.select("_block", F.lag("_end", 1, start).over(Window.orderBy("_block")).alias("_before"))  # a row for each block
    joined = numbered.withColumn("_prev", F.lag(value, 1).over(own)).withColumn("_first", F.row_number().over(own) == 1).join(ends, "_block")
    return joined.withColumn("expected_prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_prev"))).drop("_block", "_prev", "_first", "_before")


def broken(events: DataFrame) -> DataFrame:
    """seq and reason of events that don't follow the one before or whose hash isn't that of what they hold."""
    hashed = S.event_hash(F.col("prev_hash"), F.col("id"), F.col("at"), F.col("kind"), F.col("payload_json"))
    hashes = events.select("seq", "prev_hash", "content_hash", (hashed != F.col("content_hash")).alias("changed"))  # payloads stay where they lie
    why = F.when(F.col("prev_hash") != F.col("expected_prev"), "prev_hash mismatch").when(F.col("changed"), "content_hash mismatch")
    return with_previous(hashes).withColumn("reason", why).where("reason is not null").select("seq", "reason")


def decoded(events: DataFrame, kind: str) -> DataFrame:
    """Events of a kind with their payload's fields."""
    own = events.where(F.col("kind") == kind)
    return own.withColumn("p", F.from_json("payload_json", PAYLOADS[kind])).select("seq", "p.*")


def checked_kinds(events: DataFrame) -> DataFrame:
    """events; one of an unknown kind is an error when it is read."""
    known = F.col("kind").isin(*PAYLOADS)
    return events.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind "), F.col("kind")))))


def _last(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """The fields of the last row by seq for each key."""
    return rows.groupBy(F.col(key).alias("id")).agg(F.max_by(F.struct(*fields), "seq").alias("v")).select("id", *(F.col(f"v.{f}").alias(f"_{f}") for f in fields))


def replay(events: DataFrame, seq: int | None = None) -> DataFrame:
    """The transactions as of an event: posted ones, with the last link and the last category of each laid over."""
    log = through(checked_kinds(events), seq)
    posted = decoded(log, "posted").select("seq", F.from_json("transaction", TRANSACTION).alias("t"))
    posted = posted.groupBy("t.id").agg(F.max_by("t", "seq").alias("t")).select("t.*")
    links = _last(decoded(log, "deduped"), "duplicate_id", "survivor_id")
    tags = _last(decoded(log, "categorized"), "transaction_id", "category")
    laid = posted.join(links, "id", "left").join(tags, "id", "left")
    tagged = F.when(F.col("_category").isNotNull(), S.replace_category(F.col("tags"), F.col("_category"))).otherwise(F.col("tags"))
    return laid.withColumn("duplicate_of", F.coalesce("_survivor_id", "duplicate_of")).withColumn("tags", tagged).select(*posted.columns)


def posted(events: DataFrame) -> DataFrame:
    """The transactions of the events that post one, as they were posted."""
    return decoded(events, "posted").select(F.from_json("transaction", TRANSACTION).alias("t")).select("t.*")


def changes(events: DataFrame) -> DataFrame:
    """seq and id of what each later event lays over a transaction: the one that it repeats, or a category."""
    none = F.lit(None).cast("string")
    links = decoded(events, "deduped").select("seq", F.col("duplicate_id").alias("id"), F.col("survivor_id").alias("duplicate_of"), none.alias("category"))
    tags = decoded(events, "categorized").select("seq", F.col("transaction_id").alias("id"), none.alias("duplicate_of"), "category")
    return links.unionByName(tags)


def laid(transactions: DataFrame, changed: DataFrame, few: bool) -> DataFrame:
    """transactions with the last link and the last category of each laid over. few: the changes fit into each task."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    own = changed.groupBy("id").agg(last("duplicate_of"), last("category"))
    both = transactions.join(F.broadcast(own) if few else own, "id", "left")
    tagged = F.when(F.col("_category").isNotNull(), S.replace_category(F.col("tags"), F.col("_category"))).otherwise(F.col("tags"))
    return both.withColumn("duplicate_of", F.coalesce("_duplicate_of", "duplicate_of")).withColumn("tags", tagged).select(*transactions.columns)


def accounts(events: DataFrame, seq: int | None = None) -> DataFrame:
    """The accounts as of an event: the last state of each."""
    rows = decoded(through(events, seq), "account_upserted").select("seq", "account.*")
    return rows.groupBy("id").agg(F.max_by(F.struct("account_type", "commodity", "name"), "seq").alias("a")).select("id", "a.*")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either ledger that the other hasn't got."""
    canon = lambda d: d.select("id", F.sha2(F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}), 256).alias("hash"))
    both = canon(left).withColumn("n", F.lit(1)).unionByName(canon(right).withColumn("n", F.lit(-1)))  # each is made once
    left_over = both.groupBy("id", "hash").agg(F.sum("n").alias("n")).where("n <> 0")
    copies = F.explode(F.array_repeat(F.when(F.col("n") > 0, "left").otherwise("right"), F.abs("n").cast("int")))
    return left_over.select("id", "hash", copies.alias("side"))


def _step(rows: DataFrame, kind: str, summary: Column) -> DataFrame:
    return rows.select("seq", F.lit(kind).alias("kind"), summary.alias("summary"))


def why(events: DataFrame, transactions: DataFrame, transaction_id: str) -> DataFrame:
    """seq, kind and summary of the events that made a transaction what it is.

    A proof of an account counts if the transaction has a posting to it and isn't later; the commodity isn't looked at.
    """
    tx = transactions.where(F.col("id") == transaction_id).first()
    text = lambda form, *cols: F.format_string(form, *cols)
    posted = decoded(events, "posted").select("seq", F.from_json("transaction", TRANSACTION).alias("t")).where(F.col("t.id") == transaction_id)
    steps = [_step(posted, "posted", text("posted payee=%s date=%s postings=%d", F.col("t.payee"), F.col("t.date").cast("string"), F.size("t.postings")))]
    if tx is not None and tx.import_batch_id:
        own = decoded(events, "imported").where(F.col("batch_id") == tx.import_batch_id)
        steps.append(_step(own, "imported", text("imported batch=%s source=%s sha256=%s rows=%d", F.col("batch_id"), F.col("source_path"), F.col("source_sha256"), F.col("row_count"))))
    own = decoded(events, "normalized").where(F.col("transaction_id") == transaction_id)
    steps.append(_step(own, "normalized", F.concat(F.lit("normalized reasons="), F.array_join("reasons", ";"))))
    own = decoded(events, "deduped").where((F.col("duplicate_id") == transaction_id) | (F.col("survivor_id") == transaction_id))
    steps.append(_step(own, "deduped", text("deduped %s -> %s (%s) %s", F.col("duplicate_id"), F.col("survivor_id"), F.col("strategy"), F.col("explanation"))))
    own = decoded(events, "categorized").where(F.col("transaction_id") == transaction_id)
    steps.append(_step(own, "categorized", text("categorized %s rule=%s conf=%d reasons=%s", F.col("category"), F.col("rule_id"), F.col("confidence"), F.array_join("reasons", ";"))))
    own = decoded(events, "manual_edit").where(F.col("transaction_id") == transaction_id)
    steps.append(_step(own, "manual_edit", F.concat(F.lit("manual_edit "), F.col("summary"))))
    if tx is not None:
        proofs = decoded(events, "reconciled").where(F.col("account").isin(sorted({p.account for p in tx.postings})))
        proofs = proofs.where(F.try_to_date(F.col("as_of"), "yyyy-MM-dd") >= F.lit(str(tx.date)).cast("date"))
        steps.append(_step(proofs, "reconciled", F.concat(F.lit("reconciled account="), F.col("account"), F.lit(" as_of="), F.col("as_of"))))
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.orderBy("seq")


def row_step(statement_rows: DataFrame, batch_id: str, row_number: int) -> DataFrame:
    """The step of a statement row, before those of its transaction."""
    own = statement_rows.where((F.col("batch_id") == batch_id) & (F.col("row_number") == row_number))
    dash = lambda c: F.coalesce(F.col(c), F.lit("-"))
    text = F.format_string("id=%s batch=%s row=%d status=%s fingerprint=%s tx=%s", F.concat_ws(":", "batch_id", F.col("row_number").cast("string")), F.col("batch_id"), F.col("row_number"), F.col("parse_status"), dash("fingerprint"), dash("transaction_id"))
    return own.select(F.lit(0).cast("long").alias("seq"), F.lit("statement_row").alias("kind"), text.alias("summary"), "transaction_id")
