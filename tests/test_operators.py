import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import dedupe, ledger, rules
from tallyforge.types import TRANSACTION


def tx(name, date, payee, amount="1.00", narration=None, memo=None, account="assets:a", other="expenses:b", dup=None, tags=(), code="USD"):
    n = Decimal(amount)
    legs = [(account, n, amount, code, memo), (other, -n, str(-n), code, None)]
    return (name, date, payee, narration, None, dup, list(tags), None, legs)


def frame(spark, rows):
    return spark.createDataFrame(rows, TRANSACTION)


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(n)


def brute_links(rows, w):
    def key(r):
        return (r[8][0][0], r[8][0][2], r[8][0][3], r[3] or r[2].lower())

    refs = lambda r: r[8][0][4] or ""
    rows = sorted((r for r in rows if r[5] is None), key=lambda r: (r[1], r[0]))
    links, first, rest = {}, {}, []
    for r in rows:
        k = (r[1], *key(r), refs(r))
        if k in first:
            links[r[0]] = (first[k], "exact")
        else:
            first[k] = r[0]
            rest.append(r)
    for j, b in enumerate(rest):
        for a in rest[:j]:
            gap = (b[1] - a[1]).days
            if w >= 0 and key(a) == key(b) and gap <= w and not (gap == 0 and refs(a) and refs(b) and refs(a) != refs(b)):
                links[b[0]] = (a[0], "near_window")
                break
    return links


def test_dedupe_against_loops(spark):
    rng = random.Random(3)
    for w in (-1, 0, 1, 2, 5):
        rows = [tx(f"id{rng.randrange(10**6):06d}", day(rng.randrange(12)), rng.choice(["cafe", "shop"]), rng.choice(["1.00", "1.0", "2.00"]), rng.choice([None, "", "cafe"]), rng.choice([None, "", "r1", "r2"]), rng.choice(["assets:a", "assets:b"]), dup=rng.choice([None] * 9 + ["x"])) for _ in range(120)]
        rows = list({r[0]: r for r in rows}.values())
        got = {r.duplicate_id: (r.survivor_id, r.strategy) for r in dedupe.plan(frame(spark, rows), w).collect()}
        assert got == brute_links(rows, w), w


def test_dedupe_scores(spark):
    cases = [("CAFE", "CAFE", 0, "12.00", True), ("CAFE", "CAFE", 1, "12.00", True), ("CAFE", "SHOP", 0, "12.00", False), ("CAFE", "CAFE", 0, "12.01", False)]
    cases += [(f"CAFE {i}", f"CAFE {i}", 0, "12.00", True) for i in range(24)] + [(f"CAFE {i}", f"SHOP {i}", 0, "12.00", False) for i in range(24)]
    rows = []
    for i, (a, b, gap, amount, _) in enumerate(cases):
        rows += [tx(f"a{i:03d}", day(0), a, "12.00", account=f"assets:c{i}"), tx(f"b{i:03d}", day(gap), b, amount, account=f"assets:c{i}")]
    found = {r.duplicate_id[1:] for r in dedupe.plan(frame(spark, rows)).collect()}
    judged = spark.createDataFrame([(c[4], f"{i:03d}" in found) for i, c in enumerate(cases)], "expected boolean, found boolean")
    r = dedupe.scores(judged).first()
    assert (r.precision, r.recall, r.tp) == (1.0, 1.0, 26)
    assert dedupe.scores(judged.limit(0)).first().precision == 1.0


def test_invariants(spark):
    rows = [tx("ok", day(0), "x"), ("one", day(0), "x", None, None, None, [], None, [("a", Decimal(5), "5", "USD", None)]), ("none", day(0), "x", None, None, None, [], None, []), ("two", day(0), "x", None, None, None, [], None, [("a", Decimal("1.5"), "1.5", "USD", None), ("b", Decimal(2), "2", "EUR", None)])]
    got = {r.transaction_id: r.message for r in ledger.unbalanced(frame(spark, rows)).collect()}
    assert got == {
        "one": "transaction one does not balance: USD residual=5",
        "none": "transaction none does not balance: transaction requires at least two postings",
        "two": "transaction two does not balance: EUR residual=2; USD residual=1.5",
    }
    assert ledger.verify(frame(spark, rows)).first().unbalanced_count == 3


def test_hash_depends_on_content_only(spark):
    rows = [tx(f"t{i}", day(i % 3), "x") for i in range(20)]
    h = lambda r: ledger.ledger_hash(frame(spark, r)).first()[0]
    assert h(rows) == h(rows[::-1]) != h(rows[:-1])


def test_rules(spark):
    found = rules.load(
        """
rules:
  - {id: a, priority: 1, category: "x:a", payee_regex: "cafe"}
  - {id: b, priority: 1, category: "x:b", payee_regex: "cafe blue"}
  - {id: c, category: "x:c", account_regex: "^expenses:rent$", max_amount: 500}
  - {id: d, priority: 9, category: "x:d", payee_regex: "("}
  - {id: e, priority: 9, category: "x:e"}
  - {id: f, priority: 2, category: "x:f", merchant_regex: "uber", min_amount: "10.00", extra: 1}
"""
    )
    rows = [
        tx("1", day(0), "cafe"),
        tx("2", day(0), "cafe blue"),
        tx("3", day(0), "flat", "500", other="expenses:rent"),
        tx("4", day(0), "flat", "501", other="expenses:rent"),
        tx("5", day(0), "UBER", "-10", ),
        tx("6", day(0), "UBER", "-10", narration=""),
        tx("7", day(0), "cafe", dup="1"),
        tx("8", day(0), "cafe", tags=["category:z"]),
    ]
    seen = rules.evaluate(frame(spark, rows), found)
    assert {r.id: r.outcome for r in seen.collect()} == {"1": "applied", "2": "conflict", "3": "applied", "4": "unmatched", "5": "applied", "6": "unmatched", "7": "duplicate", "8": "skipped"}
    assert [r.message for r in rules.conflicts(seen).collect()] == ["tx 2 priority 1 conflict: a=>x:a, b=>x:b"]
    got = {r.transaction_id: (r.category, r.confidence, r.reasons) for r in rules.applied(seen).collect()}
    assert got["5"] == ("x:f", 80, ["merchant_regex=uber", "min_amount=10.00"]) and got["3"][2] == ["account_regex=^expenses:rent$", "max_amount=500"]
    assert rules.counts(rules.evaluate(frame(spark, rows), [])).first().unmatched == 6
    assert rules.load('{"rules": [{"id": "a", "category": "b", "payee_regex": "c"}]}', "json")[0].confidence == 80


def test_snapshot_round_trip(spark):
    t = frame(spark, [tx(f"t{i}", day(i), "x", memo=f"m{i}") for i in range(5)])
    back = ledger.with_postings(t.drop("postings"), ledger.postings(t)).select(*t.columns)
    assert back.exceptAll(t).count() == t.exceptAll(back).count() == 0
    assert t.select(S.refs_key(F.col("postings")).alias("r")).where("r = 'm3'").count() == 1
