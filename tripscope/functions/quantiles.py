"""Exact interpolated percentiles per group for continuous columns, by distributed radix selection.

The built-in exact percentile keeps every distinct value of a group in one buffer. That is right for whole minutes; for money and ratios
a hot group would not fit. Here a first pass counts values per cell of a logarithmic scale, map-side first, and finds the cell that holds
each wanted rank, with its smallest and largest value. The next pass splits only these cells evenly into 65,536, and so on. A cell spans
a factor of 2^(1/16), so it has fewer than 2^48 doubles and a few passes end at one value; two are usual. No values are ever ordered: the
largest group of any window has 65,536 counters. A pass reads keys and values alone, which are written once, and compares a row with the
few open cells of its group, which come by a join on the group alone; the expressions stay small enough to be compiled to machine code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.session import delete_folder, ensure_checkpoint_dir, shared_dir

SPLIT = 65_536
#: Groups with open cells (one short row each) are broadcast up to this many and joined by shuffle beyond it.
BROADCAST_GROUPS = 100_000


def ordered_bits(v: Column) -> Column:
    """A long of the same order as the double: its IEEE bits, negated for negative values.

    Exponent and mantissa come from divisions by powers of two, which are exact. Both zeros are 0; NaN is above infinity.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    # The logarithm may be rounded across a power of two. 2^1024 is infinity, so the comparison holds at the upper end too.
    exponent = F.greatest(guess - F.when(power(guess) > a, 1).otherwise(0) + F.when(power(guess + 1) <= a, 1).otherwise(0), F.lit(-1022))
    fraction = ((a / power(exponent) - 1.0) * float(2**52)).cast("long")
    bits = (exponent + 1023).cast("long") * F.lit(2**52) + fraction
    whole = F.when(F.isnan(v), F.lit(0x7FF8 << 48)).when(a == float("inf"), F.lit(0x7FF0 << 48)).when(a == 0.0, F.lit(0)).otherwise(bits)
    return F.when(v < 0, -whole).otherwise(whole)


def first_digit(v: Column) -> Column:
    """A small int of the same order as the double: its place on a logarithmic scale, 16 steps to a doubling. Zero, infinity and NaN stand alone."""
    steps = F.floor(F.least(F.log2(F.abs(v)) * 16, F.lit(40_000.0))).cast("int") + 20_000
    return F.when(F.isnan(v), F.lit(70_000)).when(v == 0.0, F.lit(0)).otherwise(F.when(v < 0, -steps).otherwise(steps))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """Columns: the keys, ``n`` non-null values, and ``p<100p>`` for every p in ``ps``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Each pass reads the rows: keys and values are written once, so that joins and expressions behind them are not done again.
    path = f"{shared_dir(spark)}/percentiles-{uuid.uuid4().hex}"
    df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null").write.parquet(path)
    rows = spark.read.parquet(path)
    first = rows.groupBy(*keys, first_digit(F.col("__v")).alias("__at")).agg(*_counters())
    n = F.sum("__c").over(W.partitionBy(*(keys or [F.lit(1)])))
    spots = [(F.col("n") - 1) * F.lit(p) for p in ps]
    # The value below and, where the spot lies between two, the value above.
    ranks = F.array(*[_rank(i, side, F.floor(spot) + (F.when(spot > F.floor(spot), 1).otherwise(0) if side else 0)) for i, spot in enumerate(spots) for side in (0, 1)])
    found = _followed(first.withColumn("n", n).withColumn("__ranks", ranks), keys, []).checkpoint()
    done = found.filter("__low = __high")
    most = 2 * len(ps)
    while True:
        left = found.filter("__low <> __high")
        inside = left.groupBy(*keys, "n", F.col("__low").alias("__in"), F.col("__high").alias("__end")).agg(F.collect_list(F.struct("__i", "__side", "__rank")).alias("__ranks"))
        cells = F.array_sort(F.collect_list(F.struct("__in", "__end"))).alias("__cells")
        grouped = inside.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(cells, F.count("*").alias("__n_cells"))
        size = grouped.agg(F.count("*"), F.coalesce(F.max("__n_cells"), F.lit(0))).first()
        if not size[1]:
            break
        places = range(min(most, size[1]))
        narrow = grouped.select(*[f"__k_{k}" for k in keys], *[F.get("__cells", F.lit(j))[side].alias(f"{side}{j}") for j in places for side in ("__in", "__end")])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        held = rows.join(F.broadcast(narrow) if size[0] <= BROADCAST_GROUPS else narrow, same)
        within = [F.col("__v").between(F.col(f"__in{j}"), F.col(f"__end{j}")) for j in places]
        low, high = [F.coalesce(*[F.when(w, F.col(f"{side}{j}")) for j, w in zip(places, within)]) for side in ("__in", "__end")]
        below = held.select(*keys, "__v", low.alias("__in"), high.alias("__end")).filter("__in is not null")
        at = F.floor((F.col("__v") - F.col("__in")) / (F.col("__end") - F.col("__in")) * (SPLIT - 1)).cast("int")
        counted = below.groupBy(*keys, "__in", at.alias("__at")).agg(*_counters())
        match = F.col("c.__in") == F.col("o.__in")
        for k in keys:
            match = match & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
        known = counted.alias("c").join(inside.alias("o"), match).select(*[F.col(f"c.{k}") for k in keys], "c.__in", "c.__at", "c.__c", "c.__low", "c.__high", "o.n", "o.__ranks")
        found = _followed(known, keys, ["__in"]).checkpoint()
        done = done.unionByName(found.filter("__low = __high"))
    delete_folder(spark, path)
    values = [F.max(F.when((F.col("__i") == i) & (F.col("__side") == side), F.col("__low"))) for i in range(len(ps)) for side in (0, 1)]
    picked = done.groupBy(*keys, "n").agg(*[v.alias(f"__q{j}") for j, v in enumerate(values)])

    def between(i: int, spot: Column) -> Column:
        low, part = F.col(f"__q{2 * i}"), spot - F.floor(spot)
        return low + F.when(part > 0, part * (F.col(f"__q{2 * i + 1}") - low)).otherwise(0.0)

    return picked.select(*keys, "n", *[between(i, spot).alias(f"p{round(p * 100)}") for i, (p, spot) in enumerate(zip(ps, spots))])


def _counters() -> list[Column]:
    return [F.count("*").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]


def _rank(i: int, side: int, rank: Column) -> Column:
    return F.struct(F.lit(i).alias("__i"), F.lit(side).alias("__side"), rank.cast("long").alias("__rank"))


def _followed(cells: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """One row per wanted rank: the digit that holds it and its rank among the values of that digit."""
    group = [F.col(c) for c in (*keys, *within)] or [F.lit(1)]
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*group).orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    held = cells.withColumn("__before", before)
    mine = F.filter("__ranks", lambda r: (r["__rank"] >= F.col("__before")) & (r["__rank"] < F.col("__before") + F.col("__c")))
    spread = held.select(*keys, "n", "__at", "__low", "__high", "__before", F.inline(mine))
    return spread.withColumn("__rank", F.col("__rank") - F.col("__before")).drop("__before")
