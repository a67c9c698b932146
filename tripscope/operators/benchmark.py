"""Reference frames for every slice: trend, target, peers, industry, and the severity they add up to.

Everything here works on the slices table (aggregated rows). Windows are partitioned by one entity's periods or by one
grain's entities in a period, so no window grows with the number of trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.functions import robust
from tripscope.operators import metrics as M
from tripscope.operators import policy

# Fixed values of the benchmark contract.
HISTORY_LOOKBACK = 12
MIN_TEMPORAL_DELTAS = 3
MIN_COHORT_FOR_Z = 5
MIN_COHORT_FOR_PEER = 2
Z_SATURATION = 3.0
FAVOURABLE_WEIGHT = 0.35

_ENTITY = ("metric_id", "grain", "entity")
_COHORT = ("metric_id", "grain", "period")


def adverse(delta: Column, specs: dict[str, M.MetricSpec]) -> Column:
    """Whether a movement goes the wrong way for its metric."""
    higher = M.per_metric(specs, "higher_is_better", "boolean")
    return F.when(higher, delta < 0).otherwise(delta > 0)


def with_trend(slices: DataFrame, months: int) -> DataFrame:
    """Prior value of the calendar-previous period and the delta, where both are measured."""
    w = W.partitionBy(*_ENTITY).orderBy("period")
    is_previous = F.lag("period").over(w) == M.previous(F.col("period"), months)
    return slices.withColumns(
        {"prior": F.when(is_previous, F.lag("value").over(w)), "prior_n": F.when(is_previous, F.lag("n").over(w))}
    ).withColumn("delta", F.col("value") - F.col("prior"))


def with_step_history(trended: DataFrame) -> DataFrame:
    """Adds ``steps``: earlier changes between measured periods, the latest change left out, at most ten of them."""
    measured = F.col("value").isNotNull()
    w = W.partitionBy(*_ENTITY, measured).orderBy("period")
    return trended.withColumn("__step", F.when(measured, F.col("value") - F.lag("value").over(w))).withColumn(
        "steps", F.when(measured, F.collect_list("__step").over(w.rowsBetween(-(HISTORY_LOOKBACK - 2), -1)))
    ).drop("__step")


def observe(slices: DataFrame, specs: dict[str, M.MetricSpec], months: int = 1) -> DataFrame:
    """Every slice with its four frames, severity and confidence."""
    df = with_step_history(with_trend(slices, months))
    df = df.withColumn("z_time", robust.array_robust_z(F.col("delta"), F.col("steps")))
    cohort = W.partitionBy(*_COHORT)
    df = robust.with_cohort_z(df, "delta", cohort, "z_cohort").withColumn("__siblings", F.count("delta").over(cohort))
    temporal = F.size("steps") >= MIN_TEMPORAL_DELTAS
    sideways = (F.col("grain") != M.GLOBAL) & (F.col("__siblings") >= MIN_COHORT_FOR_Z)
    moved = F.col("delta").isNotNull()
    df = df.withColumns(
        {
            "robust_z": F.when(moved & temporal, F.col("z_time")).when(moved & sideways, F.col("z_cohort")),
            "z_basis": F.when(moved, F.when(temporal, "temporal").when(sideways, "cohort").otherwise("none")),
        }
    ).drop("steps", "z_time", "z_cohort", "__siblings")
    df = with_peers(with_target(df, specs), specs).withColumn("industry", M.per_metric(specs, "industry", "double"))
    return df.withColumns({"severity": severity(specs), "confidence": M.quality(specs)["confidence"]})


def with_target(df: DataFrame, specs: dict[str, M.MetricSpec]) -> DataFrame:
    """Target, signed gap and breach; all null or false where the metric has no target."""
    rule = policy.RuleColumns.for_specs(specs)
    return df.withColumns({"sla_target": rule.target, "sla_gap": rule.gap(F.col("value"))}).withColumn(
        "sla_breached", F.coalesce(F.col("sla_gap") > 0, F.lit(False))
    )


def with_peers(df: DataFrame, specs: dict[str, M.MetricSpec]) -> DataFrame:
    """Median, place and percentile among the measured siblings of the same grain and period."""
    cohort = W.partitionBy(*_COHORT)
    higher = M.per_metric(specs, "higher_is_better", "boolean")
    best_first = F.when(higher, -F.col("value")).otherwise(F.col("value"))
    place = F.row_number().over(cohort.orderBy(best_first.asc_nulls_last(), F.col("entity")))
    size = F.count("value").over(cohort)
    framed = (F.col("grain") != M.GLOBAL) & (F.col("peer_size") >= MIN_COHORT_FOR_PEER)
    return (
        df.withColumns({"peer_median": F.median("value").over(cohort), "peer_rank": place, "peer_size": size})
        .withColumns(
            {
                "peer_median": F.when(framed, F.col("peer_median")),
                "peer_rank": F.when(framed & F.col("value").isNotNull(), F.col("peer_rank")),
                "peer_size": F.when(framed, F.col("peer_size")),
            }
        )
        .withColumn(
            "peer_percentile", (F.col("peer_size") - F.col("peer_rank")) / F.nullif(F.col("peer_size") - 1, F.lit(0)) * 100
        )
    )


def severity(specs: dict[str, M.MetricSpec]) -> Column:
    """Noisy-or of the trend score and the target score, 0..1."""
    size = F.least(F.abs("robust_z") / Z_SATURATION, F.lit(1.0))
    scored = F.when(adverse(F.col("delta"), specs), size).otherwise(size * FAVOURABLE_WEIGHT)
    trend = F.when(F.col("robust_z").isNull(), 0.0).otherwise(scored)
    rule = policy.RuleColumns.for_specs(specs)
    relative = F.least(rule.relative_gap(F.col("value")) / policy.CRITICAL_GAP, F.lit(1.0))
    binding = F.col("sla_breached") & ~M.per_metric(specs, "sla_advisory", "boolean")
    target = F.when(binding, relative).otherwise(0.0)
    joined = 1 - (1 - trend) * (1 - target)
    return F.when(F.col("value").isNull(), 0.0).otherwise(F.least(F.greatest(joined, F.lit(0.0)), F.lit(1.0)))


def with_band(observations: DataFrame) -> DataFrame:
    """Severity band of the target gap."""
    relative = F.col("sla_gap") / F.abs("sla_target")
    return observations.withColumn("band", policy.band(F.coalesce(relative, F.lit(0.0))))


def recheck_latest(observations: DataFrame) -> DataFrame:
    """Measured observations in each metric's latest period; unmeasured slices give no row."""
    latest = W.partitionBy("metric_id")
    last = F.max(F.when(F.col("grain") == M.GLOBAL, F.col("period"))).over(latest)
    return observations.withColumn("__last", last).filter("period = __last and value is not null").drop("__last")
