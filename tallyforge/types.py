"""Schemas of the ledger. Amounts are exact decimals, with the text they were written as beside them."""

from __future__ import annotations

AMOUNT = "decimal(38,10)"

POSTING = f"struct<account:string,amount:{AMOUNT},amount_text:string,commodity:string,memo:string>"

RAW_ROW = "row_number int, date_raw string, amount_raw string, currency_raw string, description_raw string, balance_raw string, source_refs array<string>, parse_error string"

TRANSACTION = f"id string, date date, payee string, narration string, import_batch_id string, duplicate_of string, tags array<string>, row_fingerprint string, postings array<{POSTING}>"

STATEMENT_ROW = (
    "batch_id string, adapter string, account_id string, row_number long, date_raw string, amount_raw string, currency_raw string, "
    "description_raw string, balance_raw string, source_refs array<string>, fingerprint string, parse_status string, error string, transaction_id string"
)

BATCH = "id string, adapter string, account_id string, source_path string, source_sha256 string, imported_at timestamp, row_count long"

ACCOUNT = "id string, account_type string, commodity string, name string"

EVENT = "seq long, id string, at string, kind string, payload_json string, content_hash string, prev_hash string"

#: What later events lay over transactions.
CHANGE = "seq long, id string, duplicate_of string, category string"

#: Kinds of events, and the fields of the payload of each.
PAYLOADS = {
    "account_upserted": f"account struct<{ACCOUNT.replace(' ', ':').replace(',:', ',')}>",
    "posted": "transaction string",
    "imported": "batch_id string, source_path string, source_sha256 string, row_count long",
    "normalized": "transaction_id string, reasons array<string>",
    "deduped": "duplicate_id string, survivor_id string, strategy string, explanation string",
    "categorized": "transaction_id string, category string, rule_id string, confidence int, reasons array<string>",
    "reconciled": "account string, as_of string, ending_balance string, matched long, unmatched long, unexplained_delta string, report_path string",
    "manual_edit": "transaction_id string, summary string",
}
