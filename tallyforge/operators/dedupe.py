"""Duplicates: links from a transaction to the one that it repeats. Nothing is deleted.

Exact: equal date, account, amount as written, commodity, merchant and source references; all link to the first by date and
id. Near: of those left, equal account, amount, commodity and merchant within some days; each links to the earliest one
before it that is near, unless both are of one day and have different references.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

EXACT, NEAR = ("exact", 100), ("near_window", 85)


def candidates(transactions: DataFrame) -> DataFrame:
    """Transactions that may be linked, with the parts of their keys. The first posting is the primary one."""
    first = F.get("postings", F.lit(0))
    return transactions.where(F.col("duplicate_of").isNull() & (F.size("postings") > 0)).select(
        "id",
        "date",
        first["account"].alias("account"),
        first["amount_text"].alias("amount_text"),
        first["commodity"].alias("commodity"),
        S.near_merchant(F.col("narration"), F.col("payee")).alias("merchant"),
        S.refs_key(F.col("postings")).alias("refs"),
    )


_NEAR_KEY = ("account", "amount_text", "commodity", "merchant")


def firsts(rows: DataFrame) -> DataFrame:
    """The keys of exact groups, with the smallest id of each. Only sums leave a task, however large a group is."""
    return rows.groupBy("date", *_NEAR_KEY, "refs").agg(F.min("id").alias("survivor_id"))


def exact_links(rows: DataFrame) -> DataFrame:
    first = firsts(rows).toDF(*(f"f_{c}" for c in ("date", *_NEAR_KEY, "refs")), "survivor_id")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("date", *_NEAR_KEY, "refs")))
    text = F.concat(F.lit("same date+account+amount+commodity+merchant+source_refs as "), F.col("survivor_id"))
    return _links(rows.join(first, same).where("id <> survivor_id"), EXACT, text)


def near_links(rows: DataFrame, days: int = 1) -> DataFrame:
    """Links among the first of each exact group, without pairs.

    A key's first ids by day say all: the earliest of the days before, within the window, is the survivor; if there is none,
    one of the same day is, whose references are equal or missing. So the window goes over one row for each key and day,
    however many rows a key has. A window below zero links nothing.
    """
    one = firsts(rows).withColumnRenamed("survivor_id", "id").where(F.lit(days >= 0))
    by_day = one.groupBy(*_NEAR_KEY, "date").agg(F.min("id").alias("first"), F.min(F.when(F.col("refs") == "", F.col("id"))).alias("bare"))
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    before = Window.partitionBy(*_NEAR_KEY).orderBy("_day").rangeBetween(-max(days, 1), -1)
    earlier = by_day.withColumn("_day", day).withColumn("_e", F.min(F.struct("date", F.col("first").alias("id"))).over(before))
    if days < 1:
        earlier = earlier.withColumn("_e", F.lit(None).cast("struct<date:date,id:string>"))
    met = one.join(earlier.drop("_day"), [*_NEAR_KEY, "date"])
    own = F.when(F.col("refs") == "", F.col("first")).otherwise(F.col("bare"))
    same_day = F.when(own < F.col("id"), F.struct("date", own.alias("id")))
    linked = met.withColumn("_s", F.coalesce("_e", same_day)).where("_s is not null").select("id", "date", F.col("_s.id").alias("survivor_id"), F.col("_s.date").alias("e_date"))
    text = F.concat(F.lit("same account+amount+merchant; dates "), F.col("e_date").cast("string"), F.lit(" and "), F.col("date").cast("string"), F.lit(f" within {days} day(s)"))
    return _links(linked, NEAR, text)


def _links(rows: DataFrame, strategy: tuple[str, int], text) -> DataFrame:
    return rows.select(F.col("id").alias("duplicate_id"), "survivor_id", F.lit(strategy[0]).alias("strategy"), F.lit(strategy[1]).alias("confidence"), text.alias("explanation"))


def plan(transactions: DataFrame, days: int = 1) -> DataFrame:
    """All links. Near ones are looked for among what exact ones leave."""
    rows = candidates(transactions)
    return exact_links(rows).unionByName(near_links(rows, days))


def already_linked(transactions: DataFrame) -> DataFrame:
    return transactions.agg(F.count_if(F.col("duplicate_of").isNotNull()).alias("already_linked"))


def apply(transactions: DataFrame, links: DataFrame) -> DataFrame:
    """transactions with duplicate_of set by links."""
    known = links.select(F.col("duplicate_id").alias("id"), F.col("survivor_id").alias("_s"))
    return transactions.join(known, "id", "left").withColumn("duplicate_of", F.coalesce("duplicate_of", "_s")).drop("_s").select(*transactions.columns)


def invalid(links: DataFrame, transactions: DataFrame) -> DataFrame:
    """Links that may not be made, and why: to itself, to or from what isn't there, or from what is linked."""
    ids = transactions.select("id", F.col("duplicate_of").isNotNull().alias("linked"))
    a = ids.select(F.col("id").alias("duplicate_id"), F.col("linked").alias("_linked"), F.lit(True).alias("_a"))
    b = ids.select(F.col("id").alias("survivor_id"), F.lit(True).alias("_b"))
    met = links.join(a, "duplicate_id", "left").join(b, "survivor_id", "left")
    why = (
        F.when(F.col("duplicate_id") == F.col("survivor_id"), "a transaction can't repeat itself")
        .when(F.col("_a").isNull(), "no such duplicate")
        .when(F.col("_b").isNull(), "no such survivor")
        .when(F.col("_linked"), "already linked")
    )
    return met.withColumn("reason", why).where("reason is not null").select("duplicate_id", "survivor_id", "reason")


def scores(cases: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, precision and recall for cases (expected, found: boolean). An empty denominator gives 1."""
    both, e, f = F.col("expected") & F.col("found"), F.col("expected"), F.col("found")
    counts = cases.agg(F.count_if(both).alias("tp"), F.count_if(~e & f).alias("fp"), F.count_if(e & ~f).alias("fn"))
    ratio = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
