"""Exact positions in a global or per-group order without pulling a group into one task.

Rows are range-partitioned on (group, order), numbered inside their partition, and shifted by the rows of the same group
that earlier partitions hold. A group of any size is spread over as many partitions as it fills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.session import ensure_checkpoint_dir


#: A range holds about this many bytes of rows.
RANGE_BYTES = 128 << 20


def _row_bytes(df: DataFrame) -> int:
    """Width of a row from its types; a text counts as 20 characters, a nested value as 64 bytes."""
    width = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "string": 20}
    return 8 + sum(width.get(kind, 64) for _, kind in df.dtypes)


def _ranges(df: DataFrame) -> int:
    """As many ranges as the rows fill, at least the session's number of shuffle partitions.

    A plan that Catalyst expects to be small is not counted; its estimate is one from above.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected <= least * RANGE_BYTES:
        return least
    return max(least, -(-df.count() * _row_bytes(df) // RANGE_BYTES))


def with_position(df: DataFrame, group: list[str], order: list[Column], out: str = "position", partitions: int | None = None) -> DataFrame:
    """Adds the 1-based place of each row in its group (the whole table when ``group`` is empty).

    ``order`` has to be unique within the group. The ranged rows are checkpointed because the range bounds are sampled
    afresh on every evaluation and the counts have to see the same partitions as the rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = partitions or _ranges(df)
    keys = [F.col(g) for g in group]
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    local = W.partitionBy("__part", *group).orderBy(*order)
    counts = ranged.groupBy("__part", *group).agg(F.count("*").alias("__rows"))
    earlier = W.partitionBy(*(group or [F.lit(1)])).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # Only the first group of a partition can continue from an earlier one: at most one row per partition is kept.
    offsets = (
        counts.withColumn("__before", F.sum("__rows").over(earlier))
        .filter("__before > 0")
        .select("__part", *[F.col(g).alias(f"__g_{g}") for g in group], "__before")
    )
    match = F.col("r.__part") == F.col("o.__part")
    for g in group:
        match = match & F.col(f"r.{g}").eqNullSafe(F.col(f"o.__g_{g}"))
    numbered = ranged.withColumn("__local", F.row_number().over(local))
    joined = numbered.alias("r").join(F.broadcast(offsets).alias("o"), match, "left")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("__local") + F.coalesce(F.col("o.__before"), F.lit(0))).cast("bigint").alias(out)
    )


def tile(position: Column, total: Column, k: int) -> Column:
    """The ``ntile(k)`` bucket of a position: the first ``total % k`` buckets are one row longer."""
    size = F.floor(total / k)
    longer = total - size * k
    head = longer * (size + 1)
    in_tail = longer + F.ceil((position - head) / F.nullif(size, F.lit(0)))
    return F.when(position <= head, F.ceil(position / (size + 1))).otherwise(in_tail).cast("int")


def with_tile(df: DataFrame, order: list[Column], k: int, out: str = "tile") -> DataFrame:
    """Adds the global ``ntile(k)`` of each row; the row count is read back as a scalar."""
    placed = with_position(df, [], order, "__pos")
    total = placed.agg(F.max("__pos")).scalar()
    return placed.withColumn("__total", total).withColumn(out, tile(F.col("__pos"), F.col("__total"), k)).drop("__pos", "__total")
