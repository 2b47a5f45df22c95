"""Sharding: resharding by minimum-cost flow.

Rows lie in old shards; new shards have capacities, in bytes. A minimum-cost flow from old sizes to new capacities, in
which staying costs nothing and moving costs a unit for each byte, tells how many bytes go from where to where with the
fewest bytes moved. The flow is then cut out of the old shards: an old shard is a sequence of blocks (hash buckets of
rows) and of rows in a block, and each of its flows takes the next piece of that sequence. Sizes of blocks are summed
where they lie; only these sums, of a bounded number of blocks, reach the driver. There are so many blocks that one has
about BLOCK_BYTES. A row's block is told by a hash of all its columns, so rows of one doc_id, or without one, are in many.

Cuts fall between rows. A row belongs to the piece in which its middle lies, so a cut is off by half a row at most, and a
new shard's size differs from its capacity by half its largest row for each cut, of which there are few. What is still
uneven is repaired: shards that are too large hand over rows to shards that are too small, chosen on the driver among a
fixed number of rows of each shard around what has to move.

Files of shards whose rows stay the same are kept; the others are rewritten.

Nulls: a null text has no bytes, and a row's size is its UTF-8 bytes plus 8; a null old shard counts as shard 0, a null
doc_id is hashed like any other. Empty texts have size 8. A very long text is one row and can't be divided: its shard may
exceed its capacity by it. Repeated rows and ties: rows that are wholly equal are interchangeable and in one block. Empty
table: no rows. Other columns are kept, but for those named like a column of the result, which it replaces.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shared_dir, written

#: Bytes of a block, about, and most blocks in all: so many sums reach the driver. Beyond it blocks grow.
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 1 << 20
#: Bytes that a row counts besides its text.
ROW_BYTES = 8

def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _before(table: pa.Table, group: str, n: str) -> pa.Array:
    """For each row of a table sorted by group, what n adds up to in the rows of its group before it."""
    at, counts = table.column(group).to_numpy(), table.column(n).to_numpy()
    sums = np.cumsum(counts) - counts
    new = np.append(True, at[1:] != at[:-1])[: len(at)]
    return pa.array(sums - np.maximum.accumulate(np.where(new, sums, 0)) if len(at) else sums, pa.int64())


def near_equal(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Units to send from each old to each new shard at least cost: successive shortest paths with potentials.

    cost defaults to 0 where both are the same shard and 1 elsewhere. What supplies and capacities add up to must be equal.
    """
    if sum(supply.values()) != sum(capacity.values()):
        raise ValueError("supply and capacity differ")
    price = (lambda i, j: int(i != j)) if cost is None else (lambda i, j: cost[i, j])
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = dict(supply), dict(capacity)
    potential: dict[tuple[str, int], int] = defaultdict(int)
    while any(left.values()):
        distance = {("old", i): 0 - potential["old", i] for i, n in left.items() if n}
        least = min(distance.values())
        distance = {k: d - least for k, d in distance.items()}
        origin: dict = dict.fromkeys(distance)
        heap = [(d, k) for k, d in distance.items()]
        heapq.heapify(heap)
        done = set()
        while heap:
            d, at = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            side, i = at
            if side == "old":
                steps = [(("new", j), price(i, j)) for j in capacity]
            else:
                steps = [(("old", k), -price(k, i)) for k in supply if flow[k, i]]
            for to, c in steps:
                new = d + c + potential[at] - potential[to]
                if to not in distance or new < distance[to]:
                    distance[to] = new
                    origin[to] = at
                    heapq.heappush(heap, (new, to))
        ends = [(distance["new", j] + potential["new", j], j) for j, n in room.items() if n]
        _, j = min(ends)
        path = [("new", j)]
        while origin[path[-1]] is not None:
            path.append(origin[path[-1]])
        path.reverse()
        amount = min([left[path[0][1]], room[j]] + [flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "new"])  # noqa: B905
        for a, b in zip(path, path[1:]):  # noqa: B905
            if a[0] == "old":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[path[0][1]] -= amount
        room[j] -= amount
        furthest = max(distance.values())
        for k in [("old", i) for i in supply] + [("new", j) for j in capacity]:
            potential[k] += distance.get(k, furthest)
    return {k: n for k, n in flow.items() if n}


def _pieces(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old, new, start, stop): an old shard's bytes in order, those that stay first."""
    out = []
    for old in sorted({i for i, _ in flow}):
        at = 0
        for new in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):
            out.append((old, new, at, at + flow[old, new]))
            at += flow[old, new]
    return out


def _repair(sizes: dict[int, int], capacity: dict[int, int], rows: dict[int, list[tuple[int, object]]]) -> list[tuple[int, int, object]]:
    """(from, to, row): moves that bring sizes nearer to capacities, each the best that the rows at hand allow."""
    over = {k: sizes[k] - capacity[k] for k in capacity}
    moves = []
    for _ in range(16 * len(over)):
        high, low = max(over, key=lambda k: (over[k], k)), min(over, key=lambda k: (over[k], k))
        gap = over[high] - over[low]
        fit = [x for x in rows.get(high, []) if x[0] < gap]
        if not fit:
            break
        best = min(fit, key=lambda x: abs(gap - 2 * x[0]))
        rows[high].remove(best)
        over[high] -= best[0]
        over[low] += best[0]
        moves.append((high, low, best[1]))
    return moves


_ADDED = ("old_shard", "size", "shard", "slot")
_ORDER = ("hash", "other")


class Resharding:
    """Where each row goes. Sizes are read once, into a narrow table; all that is summed is summed over that."""

    def __init__(self, rows: DataFrame, old: Column, capacities: dict[int, int] | int):
        self.spark = rows.sparkSession
        self.names = {f"c{k}": c for k, c in enumerate(c for c in rows.columns if c not in _ADDED)}  # none clashes with those made here
        own = {n: F.col("`" + c.replace("`", "``") + "`") for n, c in self.names.items()}
        hashed = [own[n] for n, c in self.names.items() if "map<" not in rows.schema[c].dataType.simpleString()]
        place = [F.coalesce(old, F.lit(0)).cast("int").alias("old"), row_size(F.col("text")).alias("size"), F.xxhash64(*hashed).alias("hash"), F.xxhash64(F.lit(1), *hashed).alias("other")]
        self.keyed = rows.select(*(c.alias(n) for n, c in own.items()), *place)
        narrow = written(rows.select(*place), "sizes")
        totals = {r["old"]: r["n"] for r in narrow.groupBy("old").agg(F.sum("size").alias("n")).collect()}
        self.blocks = max(1, min(-(-max(totals.values(), default=0) // BLOCK_BYTES), MOST_BLOCKS // max(1, len(totals))))
        self.capacities = dict(enumerate(near_equal(sum(totals.values()), capacities))) if isinstance(capacities, int) else capacities
        self.flow = min_cost_flow(totals, self.capacities)
        narrow = self._blocked(narrow)
        sums = narrow.groupBy("old", "block").agg(F.sum("size").alias("n")).toArrow().sort_by([("old", "ascending"), ("block", "ascending")])
        self.starts = sums.select(["old", "block"]).append_column("start", _before(sums, "old", "n"))
        self.moves: list[tuple] = []
        self.moves = self._repair(self._placed(narrow))
        counted = self._placed(narrow).groupBy("shard", "old", "block").agg(F.count("*").alias("n")).toArrow()  # blocks, cuts and moves
        counted = counted.sort_by([(c, "ascending") for c in ("shard", "old", "block")])
        self.firsts = counted.select(["shard", "old", "block"]).append_column("first", _before(counted, "shard", "n"))
        pairs = {(r["shard"], r["old"]) for r in counted.group_by(["shard", "old"]).aggregate([]).to_pylist()}
        #: New shards with rows, and shards that get or lose rows.
        self.shards, self.changed = sorted({shard for shard, _ in pairs}), sorted({k for pair in pairs if pair[0] != pair[1] for k in pair})
        discard(self.spark, narrow)

    def _blocked(self, keyed: DataFrame) -> DataFrame:
        return keyed.withColumn("block", F.pmod("hash", F.lit(self.blocks)).cast("int"))

    def _placed(self, blocked: DataFrame) -> DataFrame:
        """Rows with shard, and their place in their block (nth)."""
        start_of = self.spark.createDataFrame(self.starts) if len(self.starts) else self.spark.createDataFrame([], "old int, block int, start long")
        by_old: dict[int, list] = defaultdict(list)
        for i, j, _, stop in _pieces(self.flow):
            by_old[i].append((stop, j))
        shard = F.lit(None).cast("int")
        for i, cuts in by_old.items():
            inside = F.lit(cuts[-1][1])
            for stop, j in reversed(cuts[:-1]):
                inside = F.when(F.col("middle") < 2 * stop, F.lit(j)).otherwise(inside)
            shard = F.when(F.col("old") == i, inside).otherwise(shard)
        running = Window.partitionBy("old", "block").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = blocked.join(F.broadcast(start_of), ["old", "block"])  # bounded by MOST_BLOCKS
        placed = placed.withColumn("middle", 2 * (F.col("start") + F.sum("size").over(running)) - F.col("size")).withColumn("nth", F.row_number().over(running))
        placed = placed.withColumn("shard", shard).drop("start", "middle")
        if not self.moves:
            return placed
        moved = self.spark.createDataFrame(self.moves, "old int, block int, nth int, to int")
        return placed.join(F.broadcast(moved), ["old", "block", "nth"], "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")

    def _repair(self, placed: DataFrame) -> list[tuple]:
        """(old shard, block, place in it, new shard) of rows to move, so that sizes come nearer to capacities.

        Each shard offers two rows of each power of two of sizes, so that small and large gaps can be closed.
        """
        row = F.struct(F.xxhash64("old", "block", "nth").alias("h"), "size", "old", "block", "nth")
        kinds = placed.groupBy("shard", F.floor(F.log2("size")).cast("int").alias("kind")).agg(F.sum("size").alias("n"), F.min(row).alias("one"), F.max(row).alias("two")).collect()
        sizes = dict.fromkeys(self.capacities, 0)
        at_hand: dict[int, list] = defaultdict(list)
        for r in kinds:
            sizes[r["shard"]] += r["n"]
            at_hand[r["shard"]] += [(x[1], x[2:]) for x in {tuple(r["one"]), tuple(r["two"])}]
        for x in at_hand.values():
            x.sort()
        final: dict[tuple, int] = {}
        for _, to, key in _repair(sizes, self.capacities, at_hand):
            final[key] = to
        return [(*key, to) for key, to in final.items()]

    def assigned(self) -> DataFrame:
        """The rows with old_shard, size, shard and slot (gapless from 0 in each shard).

        Blocks that follow each other are dealt to one task, so its rows are of few shards.
        """
        first_of = self.spark.createDataFrame(self.firsts) if len(self.firsts) else self.spark.createDataFrame([], "shard int, old int, block int, first long")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        within = Window.partitionBy("old", "block", "shard").orderBy("nth")
        dealt = self._blocked(self.keyed).repartitionByRange(parts, "old", "block")
        placed = self._placed(dealt).join(F.broadcast(first_of), ["shard", "old", "block"])  # bounded like counted
        out = placed.withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
        return out.select(*(F.col(n).alias(c) for n, c in self.names.items()), F.col("old").alias("old_shard"), "size", "shard", "slot")

    def rewrite(self, path: str) -> DataFrame:
        """Writes the shards whose rows changed below path, one directory each, and returns all shards' rows.

        A shard that keeps just its rows is not written: its rows are returned from where they are.
        """
        every = self.assigned()
        affected = every.where(F.col("shard").isin(self.changed)) if self.changed else every.where("false")
        affected.write.partitionBy("shard").parquet(path)
        back = self.spark.read.schema(every.schema).option("basePath", path).parquet(path)
        back = back.toDF(*(f"c{k}" for k in range(len(back.columns))))
        place = {c: f"c{k}" for k, c in enumerate([*(c for c in every.columns if c != "shard"), "shard"])}  # a directory's column comes last
        back = back.select(*(F.col(place[c]).alias(c) for c in every.columns))
        if len(self.changed) == len(self.shards):
            return back
        return back.unionByName(every.where(~F.col("shard").isin(self.changed)) if self.changed else every)


def reshard(rows: DataFrame, old: Column, capacities: dict[int, int] | int) -> DataFrame:
    """rows (with doc_id and text) with old_shard, size, shard and slot.

    capacities: bytes of each new shard, or their number for near equal ones. Given capacities must add up to the rows'
    sizes.
    """
    return Resharding(rows, old, capacities).assigned()


def reshard_documents(docs: DataFrame, old: Column, shards: int) -> DataFrame:
    """docs dealt to `shards` near equal shards, written to the shared folder and read again."""
    return Resharding(docs, old, shards).rewrite(shared_dir(docs.sparkSession, "shards"))
