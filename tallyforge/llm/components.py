"""Connected components of a graph of links, by alternating large and small stars.

Each round links every node to the smallest node it knows of (Kiveris et al., 2014), which takes a logarithmic number
of rounds in practice. A round is two aggregations with map-side combine and two joins on a node; a node with very many
links is split by skew-join handling, never gathered. Each round's links are written to the shared folder and read
again, so the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(links: DataFrame) -> DataFrame:
    """links (a > b) after one large and one small star."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    moved = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component for every node of links (a, b, both long): the smallest node that is reachable.

    Loops and repeated links do no harm; nulls are dropped. No links give no rows.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state or new[0] == 0:
            break
        state = new
        last, now = now, written(_star(now), "links")
        discard(links.sparkSession, last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
