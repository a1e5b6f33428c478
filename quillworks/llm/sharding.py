"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows of equal text form a group, which no shard boundary may cut. Groups fall into cells of nearly equal size (1/64
apart) and of a hash; only the cells' counts and sums, a number of rows bounded by ``CELLS``, reach the driver. There
the cells enter bins from the largest size down, each item into the bin with the least room that still takes it; bins
stand in a balanced search tree by room. The capacity is the least that needs no more than the wanted shards.
A group over the capacity takes a shard alone. The plan gives each cell's ranks to shards; ranks and slots are counted
within cells and blocks, so that no task holds a whole shard or the rows of a hot text.

A null text counts as an empty one. Repeated rows get a slot each. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillworks.llm.common import store

STEPS = 64
SALTS = 16
#: Sizes run to 2**40 bytes: no more cells than this can exist.
CELLS = 40 * STEPS * SALTS
BLOCKS = 512
ROW_OVERHEAD = 8


class RoomTree:
    """Bins ordered by room in a treap: the tightest bin that takes a size is found in logarithmic time."""

    def __init__(self) -> None:
        self.root = None
        self.seed = 1

    def insert(self, room: float, bin_no: int) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, (room, bin_no))
        self.root = self._merge(self._merge(low, [(room, bin_no), self.seed >> 20, None, None]), high)

    def pop_tightest(self, size: float) -> tuple[float, int] | None:
        """Removes and returns the bin of least room that is at least ``size``."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node, parent = high, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            high = node[3]
        else:
            parent[2] = node[3]
        self.root = self._merge(low, high)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(items: list[tuple[float, int]], capacity: float, limit: int | None = None) -> list[list[tuple[int, int]]] | None:
    """Runs (bin, count) for each (size, count) of ``items``, sizes falling; None once more than ``limit`` bins are open.

    A bin that takes an item stays the tightest while it still fits, so equal items enter in runs.
    """
    tree, bins, plan = RoomTree(), 0, []
    for size, count in items:
        runs = []
        while count:
            found = tree.pop_tightest(size)
            if found is None:
                if limit is not None and bins >= limit:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            room, at = found
            n = min(count, max(1, int(room // size)))
            runs.append((at, n))
            count -= n
            tree.insert(room - n * size, at)
        plan.append(runs)
    return plan


def pack(items: list[tuple[float, int]], shards: int) -> list[list[tuple[int, int]]]:
    """The plan of least capacity (to a part in 10,000) that opens no more than ``shards`` bins."""
    total, largest = sum(s * n for s, n in items), max((s for s, _ in items), default=1)
    low, high = total / shards, total / shards + largest
    while best_fit_decreasing(items, high, shards) is None:
        high *= 1.1
    best = best_fit_decreasing(items, high, shards)
    while high - low > low / 10_000:
        middle = (low + high) / 2
        if (plan := best_fit_decreasing(items, middle, shards)) is None:
            low = middle
        else:
            best, high = plan, middle
    return best


def assign(docs: DataFrame, shards: int, text: str = "text", size: str = "size", shard: str = "shard") -> DataFrame:
    """``docs`` with their shard; rows of equal text stay together. ``size`` names a column of bytes."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    groups = keyed.groupBy("__key").agg(F.sum(size).alias("bytes"))
    cell = [F.floor(F.log2(F.greatest("bytes", F.lit(1))) * STEPS).cast("int").alias("step"), F.pmod(F.xxhash64("__key"), F.lit(SALTS)).cast("int").alias("salt")]
    groups = store(groups.select("__key", "bytes", *cell), "groups")
    cells = groups.groupBy("step", "salt").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    if len(cells) > CELLS:
        raise ValueError("a group is over 2**40 bytes")
    cells.sort(key=lambda c: (-c["step"], c["salt"]))
    plan = pack([(c["bytes"] / c["n"], c["n"]) for c in cells], shards) if cells else []
    rows = []
    for c, runs in zip(cells, plan, strict=True):
        ends = [*accumulate(n for _, n in runs)]
        rows.append((c["step"], c["salt"], ends, [at for at, _ in runs]))
    planned = spark.createDataFrame(rows, "step int, salt int, ends array<long>, bins array<int>")
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("step", "salt").orderBy(F.desc("bytes"), "__key")))
    placed = ranked.join(planned, ["step", "salt"]).select("__key", F.expr("element_at(bins, 1 + size(filter(ends, e -> e < rank)))").alias(shard))
    return keyed.join(placed, "__key").drop("__key")


def slots(docs: DataFrame, shard: str = "shard", order: str = "doc_id", slot: str = "slot") -> DataFrame:
    """``docs`` with gapless places from 0 within each shard, counted by blocks of hashed ``order``."""
    docs = docs.withColumn("__block", F.pmod(F.xxhash64(order), F.lit(BLOCKS)).cast("int"))
    counts = docs.groupBy(shard, "__block").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(shard, "__block", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(shard, "__block").orderBy(order))
    return docs.withColumn("__rank", within).join(counts, [shard, "__block"]).withColumn(slot, F.col("__before") + F.col("__rank") - 1).drop("__block", "__rank", "__before")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law places rows by what else there is)."""
    sized = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("size", F.octet_length("text").cast("long") + ROW_OVERHEAD).withColumn("text_crc32", F.crc32(F.encode("text", "UTF-8")))
    placed = store(assign(sized, shards).drop("text"), "placed")
    return slots(placed).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
