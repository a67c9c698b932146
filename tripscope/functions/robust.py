"""Median-based statistics as native expressions: over an array column, or over a window of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

# Normal-consistency factors of the two spread measures, and the smallest spread treated as non-zero.
MAD_SCALE = 0.6745
MEAN_DEVIATION_SCALE = 1.2533
EPSILON = 1e-12


def finite(a: Column) -> Column:
    """The array without nulls, NaN and infinities."""
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` with the value computed once, so nested statistics stay linear in size."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _middle(s: Column) -> Column:
    """Median of an already sorted array."""
    n = F.size(s)
    lower = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    upper = F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def array_median(a: Column) -> Column:
    """Average of the middle two finite values; null for an empty array."""
    return let(F.array_sort(finite(a)), _middle)


def array_mad(a: Column, median: Column | None = None) -> Column:
    """Median of the absolute deviations from the median, unscaled."""

    def around(xs: Column, med: Column) -> Column:
        return let(F.array_sort(F.transform(xs, lambda x: F.abs(x - med))), _middle)

    if median is not None:
        return around(finite(a), median)
    return let(finite(a), lambda xs: let(let(F.array_sort(xs), _middle), lambda med: around(xs, med)))


def robust_z(x: Column, median: Column, mad: Column, mean_deviation: Column | None = None) -> Column:
    """Scaled distance from the median; mean deviation stands in where the MAD vanishes; 0 where both do."""
    by_mean = F.lit(0.0)
    if mean_deviation is not None:
        by_mean = F.when(mean_deviation > EPSILON, (x - median) / (F.lit(MEAN_DEVIATION_SCALE) * mean_deviation)).otherwise(0.0)
    return F.when(mad > EPSILON, F.lit(MAD_SCALE) * (x - median) / mad).otherwise(by_mean)


def array_robust_z(x: Column, sample: Column) -> Column:
    """Robust z of ``x`` against an array; 0 for an empty or constant one."""

    def scaled(xs: Column, med: Column, gaps: Column) -> Column:
        mean_gap = F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(gaps), F.lit(0))
        return let(_middle(gaps), lambda mad: let(mean_gap, lambda dev: robust_z(x, med, mad, dev)))

    z = let(
        F.array_sort(finite(sample)),
        lambda xs: let(
            _middle(xs),
            lambda med: let(F.array_sort(F.transform(xs, lambda v: F.abs(v - med))), lambda gaps: scaled(xs, med, gaps)),
        ),
    )
    return F.when(x.isNotNull(), F.coalesce(z, F.lit(0.0)))


def with_cohort_z(df: DataFrame, x: str, cohort: WindowSpec, out: str) -> DataFrame:
    """Adds ``out``: the robust z of ``x`` among the rows of ``cohort`` (itself included).

    Cohorts are the entities of one grain in one period: aggregated rows, a few thousand at most.
    """
    med, mad, gap = (f"__{out}_{p}" for p in ("med", "mad", "gap"))
    return (
        df.withColumn(med, F.median(x).over(cohort))
        .withColumn(gap, F.abs(F.col(x) - F.col(med)))
        .withColumn(mad, F.median(gap).over(cohort))
        .withColumn(out, robust_z(F.col(x), F.col(med), F.col(mad), F.avg(gap).over(cohort)))
        .drop(med, mad, gap)
    )


def ewma(a: Column, alpha: float) -> Column:
    """Exponentially weighted mean of an oldest-first array; NaN when empty."""
    start = F.struct(F.lit(None).cast("double").alias("e"))
    folded = F.aggregate(
        finite(a),
        start,
        lambda acc, x: F.struct(F.when(acc["e"].isNull(), x).otherwise(F.lit(alpha) * x + F.lit(1 - alpha) * acc["e"]).alias("e")),
    )
    return F.coalesce(folded["e"], F.lit(float("nan")))
