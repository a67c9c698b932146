"""Sharding by a minimax contiguous partition of ordered atomic groups.

Groups of equal texts are atomic and stand in the order of their 64-bit hash. The smallest capacity is sought for which a greedy walk, that
fills each shard up to the last group that fits, needs no more than the given number of shards. No shard is larger; within this bound the
groups are cut near equal shares of what is left, wherever the walk shows that the rest still fits.

The walk only asks for the last group boundary at or below a size, so the groups themselves stay in Spark. The driver holds boundaries of
hash ranges, coarse at first. With them the binary search gives two capacities: one that surely suffices (cuts at known boundaries only) and one below
which none can (as if groups could be cut anywhere inside an unknown range). The ranges in which a cut can fall for any capacity between
the two are split again and summed by Spark, until both agree. One huge group keeps the two far apart until it stands alone, and then every
range is open; a round therefore splits the ``MOST_OPEN`` largest of them, so the driver's list grows by a fixed number of ranges a round,
whatever the groups.

Rows learn their shard by comparing hashes with the cuts. Their slots come from counts per (shard, bucket of the id), so no shard, and no
group of copies, is numbered in one task.

Defined cases: a null text has size 0 and is a group apart from the empty text; ids may be null or repeat (rows that agree in everything
share their slots in any order); fewer groups than shards leave shards empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tripscope.llm.common import documents, written
from tripscope.plans.registry import Book

BOOK = Book()
BITS = 64
FIRST_BITS = 10
FANOUT_BITS = 6
MOST_OPEN = 256
ROWS_PER_BUCKET = 100_000


class Ranges:
    """Ordered hash ranges with their summed sizes; ``whole`` marks those that are one group."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)  # (first key, bits of the range, size, whole)
        self.ends, total = [], 0
        for _, _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def surely(self, limit: int) -> int:
        """The last known boundary at or below a size."""
        i = bisect_right(self.ends, limit)
        return self.ends[i - 1] if i else 0

    def perhaps(self, limit: int) -> int:
        """Where a boundary could be at best: inside a range that is not one group, anywhere."""
        i = bisect_right(self.ends, limit)
        if i == len(self.rows) or self.rows[i][3]:
            return self.ends[i - 1] if i else 0
        return limit

    def open_between(self, low: int, high: int) -> set[int]:
        """Numbers of the ranges, other than whole ones, that hold sizes from ``low`` to ``high``."""
        i, j = bisect_right(self.ends, low), bisect_right(self.ends, high)
        return {k for k in range(i, min(j + 1, len(self.rows))) if not self.rows[k][3]}


def walk(step: Callable[[int], int], capacity: int, shards: int, at: int = 0) -> list[int]:
    """Ends of the shards that a greedy walk from a place on fills to a capacity."""
    ends = []
    for _ in range(shards):
        at = step(at + capacity)
        ends.append(at)
    return ends


def smallest(step: Callable[[int], int], total: int, shards: int) -> int:
    """The smallest capacity whose walk reaches the end, by binary search."""
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        if walk(step, middle, shards)[-1] >= total:
            high = middle
        else:
            low = middle + 1
    return low


def even_ends(ranges: Ranges, capacity: int, shards: int) -> list[int]:
    """Ends of shards that no capacity is exceeded by and that are as even as known boundaries allow.

    Each shard is cut at the boundary nearest to an equal share of what is left, or at the first one after it from which a greedy walk
    still places the rest. The last boundary within the capacity is always such a one, since the walk came through it.
    """
    known, total = [0, *ranges.ends], ranges.total
    ends, at = [], 0

    def fits(end: int, left: int) -> bool:
        return walk(ranges.surely, capacity, left, end)[-1] >= total if left else end >= total

    for left in range(shards - 1, -1, -1):
        goal = at - (at - total) // (left + 1)
        last = bisect_right(known, at + capacity) - 1
        below = min(bisect_right(known, goal) - 1, last)
        low = below + 1 if below < last and known[below + 1] - goal < goal - known[below] else below
        # A shard stays empty only when all groups are placed.
        low, high = min(max(low, bisect_right(known, at)), last), last
        while low < high:
            middle = (low + high) // 2
            if fits(known[middle], left):
                high = middle
            else:
                low = middle + 1
        at = known[low]
        ends.append(at)
    return ends


def _summed(groups: DataFrame, parts: list[tuple[int, int]] | None) -> list[tuple[int, int, int, bool]]:
    """Sizes of the ranges into which ``parts`` (first key, bits) are split; without parts, of the coarsest ranges."""
    bits = F.lit(BITS - FIRST_BITS)
    if parts is not None:
        # One look-up for each width of range, not one condition for each range.
        widths = [
            F.when(F.expr(f"shiftleft(shiftright(key, {w}), {w})").isin([first for first, had in parts if had == w]), F.lit(max(0, w - FANOUT_BITS)))
            for w in sorted({had for _, had in parts})
        ]
        bits = F.coalesce(*widths)
    keyed = groups.withColumn("bits", bits).filter("bits IS NOT NULL").withColumn("first", F.expr("shiftleft(shiftright(key, bits), bits)"))
    rows = keyed.groupBy("first", "bits").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return [(r["first"], r["bits"], r["size"], r["n"] == 1) for r in rows]


def cuts(groups: DataFrame, shards: int) -> list[int | None]:
    """Last key of each shard but the last (None: nothing so far), for ``groups(key, size)`` in the order of their keys; a key is never cut."""
    ranges = Ranges(_summed(groups, None))
    while True:
        high = smallest(ranges.surely, ranges.total, shards)
        low = smallest(ranges.perhaps, ranges.total, shards)
        open_: set[int] = set()
        for a, b in zip(walk(ranges.surely, low, shards), walk(ranges.perhaps, high, shards)):
            open_ |= ranges.open_between(a, b)
        if low == high or not open_:
            break
        open_ = set(sorted(open_, key=lambda k: (-ranges.rows[k][2], k))[:MOST_OPEN])
        finer = _summed(groups, [ranges.rows[k][:2] for k in sorted(open_)])
        ranges = Ranges([r for k, r in enumerate(ranges.rows) if k not in open_] + finer)
    keys = []
    for end in even_ends(ranges, high, shards)[:-1]:
        i = bisect_right(ranges.ends, end)
        keys.append(ranges.rows[i - 1][0] + (1 << ranges.rows[i - 1][1]) - 1 if i else None)
    return keys


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, size, text_crc32, shard, slot)."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = written(
        docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("key")), "sized"
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    number = F.lit(0)
    for last in cuts(groups, shards):
        number = number + (F.lit(0) if last is None else (F.col("key") > F.lit(last)).cast("int"))
    count = rows.count()
    spark = docs.sparkSession
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards, count // (shards * ROWS_PER_BUCKET), 1)
    placed = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("id", "key"), F.lit(buckets)).cast("int"))
    counted = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counted.withColumn("before", before).select("shard", "bucket", "before")
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "key", "size"))
    return placed.withColumn("nth", nth).join(offsets, ["shard", "bucket"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))


@BOOK.query("op2_minimax_sharding")
def minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in eight shards of nearly equal bytes, equal texts together."""
    out = shard(documents(spark, sf_dir), 8)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
