"""Category rules. A rule set is compiled to one expression for each transaction: no join, and patterns are constants.

A rule is a conjunction of predicates; one without any never matches, nor does one with a pattern or a number that can't be
read. Of the rules that match, the highest priority decides; if these name several categories, it is a conflict and nothing
is tagged; else the first of them, in the file's order, tags.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.patterns import java_pattern
from ..types import AMOUNT

_NUMBER = re.compile(r"[+-]?(\d+\.?\d{0,10}|\.\d{1,10})")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    priority: int = 0
    merchant_regex: str | None = None
    payee_regex: str | None = None
    account_regex: str | None = None
    min_amount: str | None = None
    max_amount: str | None = None
    confidence: int = 80


def load(text: str, form: str = "yaml") -> list[Rule]:
    """Rules of a YAML or JSON document with a list `rules`. Unknown fields are ignored."""
    if form == "json":
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text)
    known = Rule.__dataclass_fields__
    text_of = lambda k, v: v if v is None or k in ("priority", "confidence") else str(v)
    return [Rule(**{k: text_of(k, v) for k, v in r.items() if k in known}) for r in (data or {}).get("rules") or []]


def load_file(path: str) -> list[Rule]:
    with open(path, encoding="utf-8") as f:
        return load(f.read(), "json" if path.lower().endswith(".json") else "yaml")


def _pattern(text: str) -> str | None:
    """The pattern as Spark is given it, or null if it isn't one. It is compiled once, on the driver."""
    spark = SparkSession.getActiveSession()

    def compiles(pattern: str) -> bool:
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except (Py4JJavaError, PySparkException):
            return False
        return True

    return java_pattern(text, compiles)


def _number(text: str) -> Decimal | None:
    plain = text.strip().replace(",", "")
    return Decimal(plain) if _NUMBER.fullmatch(plain) else None


def _match(rule: Rule) -> tuple[Column, list[str]] | None:
    """The predicate of a rule and its reasons, or null if it never matches."""
    tests: list[Column] = []
    reasons: list[str] = []
    size = F.abs(F.get("postings", F.lit(0))["amount"])
    for name, on in (
        ("merchant_regex", lambda p: S.rule_text(F.col("narration"), F.col("payee")).rlike(p)),
        ("payee_regex", lambda p: F.col("payee").rlike(p)),
        ("account_regex", lambda p: F.exists("postings", lambda x: x["account"].rlike(p))),
    ):
        given = getattr(rule, name)
        if given is not None:
            pattern = _pattern(given)
            if pattern is None:
                return None
            tests.append(on(pattern))
            reasons.append(f"{name}={given}")
    for name, on in (("min_amount", lambda n: size >= n), ("max_amount", lambda n: size <= n)):
        given = getattr(rule, name)
        if given is not None:
            number = _number(given)
            if number is None:
                return None
            tests.append(on(F.lit(number).cast(AMOUNT)))
            reasons.append(f"{name}={given}")
    if not tests:
        return None
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False)), reasons


_HIT = "struct<at:int,priority:int,id:string,category:string,confidence:int,reasons:array<string>>"


def hits(rules: list[Rule]) -> Column:
    """The rules that a transaction matches, in the file's order."""
    found = []
    for at, rule in enumerate(rules):
        test = _match(rule)
        if test is not None:
            found.append(F.when(test[0], F.struct(F.lit(at), F.lit(rule.priority), F.lit(rule.id), F.lit(rule.category), F.lit(rule.confidence), F.array(*map(F.lit, test[1])).cast("array<string>")).cast(_HIT)))
    return F.array_compact(F.array(*found).cast(f"array<{_HIT}>")) if found else F.array().cast(f"array<{_HIT}>")


def evaluate(transactions: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every transaction with outcome (duplicate, skipped, unmatched, conflict or applied), hits and the deciding ones (top)."""
    top = F.filter("hits", lambda h: h["priority"] == F.array_max(F.transform("hits", lambda x: x["priority"])))
    seen = transactions.withColumn("hits", hits(rules)).withColumn("top", top)
    outcome = (
        F.when(F.col("duplicate_of").isNotNull(), "duplicate")
        .when(S.is_categorized(F.col("tags")), "skipped")
        .when(F.size("hits") == 0, "unmatched")
        .when(F.size(F.array_distinct(F.transform("top", lambda h: h["category"]))) > 1, "conflict")
        .otherwise("applied")
    )
    return seen.withColumn("outcome", outcome)


def applied(evaluated: DataFrame) -> DataFrame:
    """transaction_id, category, rule_id, confidence and reasons of what is to be tagged."""
    first = F.get("top", F.lit(0))
    return evaluated.where("outcome = 'applied'").select(F.col("id").alias("transaction_id"), first["category"].alias("category"), first["id"].alias("rule_id"), first["confidence"].alias("confidence"), first["reasons"].alias("reasons"))


def conflicts(evaluated: DataFrame) -> DataFrame:
    """transaction_id and message of conflicts."""
    first = F.get("top", F.lit(0))
    pairs = F.array_join(F.transform("top", lambda h: F.concat(h["id"], F.lit("=>"), h["category"])), ", ")
    text = F.concat(F.lit("tx "), F.col("id"), F.lit(" priority "), first["priority"].cast("string"), F.lit(" conflict: "), pairs)
    return evaluated.where("outcome = 'conflict'").select(F.col("id").alias("transaction_id"), text.alias("message"))


def counts(evaluated: DataFrame) -> DataFrame:
    """One row: applied, conflicts, unmatched and skipped. Duplicates are in none of them."""
    names = (("applied", "applied"), ("conflict", "conflicts"), ("unmatched", "unmatched"), ("skipped", "skipped"))
    return evaluated.agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in names))


def tag(transactions: DataFrame, chosen: DataFrame) -> DataFrame:
    """transactions with the category of chosen (transaction_id, category) among their tags."""
    new = chosen.select(F.col("transaction_id").alias("id"), F.col("category").alias("_c"))
    tagged = F.when(F.col("_c").isNotNull(), S.replace_category(F.col("tags"), F.col("_c"))).otherwise(F.col("tags"))
    return transactions.join(new, "id", "left").withColumn("tags", tagged).select(*transactions.columns)


def scores(cases: DataFrame) -> DataFrame:
    """One row for cases (expected, found: category or null). A wrong category is a false positive only."""
    e, f = F.col("expected"), F.col("found")
    counted = cases.agg(
        F.count_if(f.isNotNull() & f.eqNullSafe(e)).alias("tp"),
        F.count_if(f.isNotNull() & ~f.eqNullSafe(e)).alias("fp"),
        F.count_if(f.isNull() & e.isNotNull()).alias("fn"),
    )
    ratio = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    return counted.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
