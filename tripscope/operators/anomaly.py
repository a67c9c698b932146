"""Movement scan, ranking and standing outliers over the observations table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.functions import robust
from tripscope.operators import metrics as M
from tripscope.operators.benchmark import adverse

# Fixed values of the scan and ranking contract.
Z_THRESHOLD = 2.0
MATERIAL_POINTS = 1.0
MATERIAL_CHANGE = 0.10
HISTORY_LOOKBACK = 12
MIN_HISTORY = 4
MIN_MOVEMENTS = 3
INSTRUMENTATION_Z = 8.0
MIN_EFFECT = 0.5
SCORE_FLOOR = 1e-6
SATURATION = 5000
COVERAGE_FLOOR = 0.6
PERSISTENCE_BASE = 0.7
PERSISTENCE_STEP = 0.15
STANDING_Z = 3.5
STANDING_COHORT = 5
STANDING_RATE_GAP = 0.01
STANDING_RELATIVE_GAP = 0.25
TOP_N = 20

# Weight of a finding by the dimension it sits on (fixed values); other dimensions take the default.
ACTIONABILITY = {
    "vendor_id": 1.0,
    "office": 1.0,
    "route_source": 1.0,
    "product_type": 1.0,
    "business_unit": 0.9,
    "contract": 0.85,
    "shift_type": 0.8,
    "trip_direction": 0.8,
    "delay_reason": 0.7,
    "trip_nodal": 0.6,
    "slab_name": 0.5,
    "global": 0.5,
    "actual_cab_fuel_type": 0.3,
    "gender": 0.05,
}
DEFAULT_ACTIONABILITY = 0.5


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.when(c.isNull() | (F.trim(c) == ""), "na").otherwise(s)


def points(delta: Column, specs: dict[str, M.MetricSpec]) -> Column:
    """Percentage points for rates, the plain difference otherwise."""
    return F.when(M.per_metric(specs, "rate_metric", "boolean"), delta * 100.0).otherwise(delta)


def movements(observations: DataFrame, specs: dict[str, M.MetricSpec], floor: int = 500) -> DataFrame:
    """Slices measured now and one period before with a full sample on both sides, scored but not yet judged.

    The gate comes before any statistic, so small slices cannot stretch the distribution they are compared with.
    """
    measured = F.col("value").isNotNull()
    past = W.partitionBy("metric_id", "grain", "entity", measured).orderBy("period").rowsBetween(-(HISTORY_LOOKBACK - 1), -1)
    gate = F.greatest(M.per_metric(specs, "min_sample", "bigint"), F.lit(floor))
    moved = observations.withColumn("__past", F.when(measured, F.collect_list("value").over(past))).filter(
        F.col("delta").isNotNull() & (F.col("n") >= gate) & (F.col("prior_n") >= gate)
    )
    # The array statistic goes below the cohort windows: above them, later filters would repeat it.
    moved = moved.withColumns(
        {"z_time": robust.array_robust_z(F.col("value"), F.col("__past")), "__known": F.size("__past")}
    ).drop("__past")
    cohort = W.partitionBy("metric_id", "grain", "period")
    moved = robust.with_cohort_z(moved, "delta", cohort, "z_cross").withColumn("__size", F.count("*").over(cohort))
    cross = F.when(F.col("__size") >= MIN_MOVEMENTS, F.col("z_cross")).otherwise(0.0)
    temporal = F.when(F.col("__known") >= MIN_HISTORY, F.col("z_time")).otherwise(0.0)
    return moved.withColumns(
        {
            "z": F.when(F.abs(temporal) >= F.abs(cross), temporal).otherwise(cross),
            "points": points(F.col("delta"), specs),
            "adverse": adverse(F.col("delta"), specs),
        }
    ).drop("__known", "__size", "z_cross", "z_time")


def significant(specs: dict[str, M.MetricSpec]) -> Column:
    base = F.abs("prior")
    material = F.when(M.per_metric(specs, "rate_metric", "boolean"), F.abs("points") >= MATERIAL_POINTS).otherwise(
        (base > 1e-12) & (F.abs("delta") >= base * MATERIAL_CHANGE)
    )
    return (F.abs("z") >= Z_THRESHOLD) | (F.col("adverse") & material)


def findings(observations: DataFrame, specs: dict[str, M.MetricSpec], floor: int = 500) -> DataFrame:
    """Significant movements with a stable id."""
    label = F.date_format("period", "yyyy-MM")
    return (
        movements(observations, specs, floor)
        .filter(significant(specs))
        .withColumn("finding_id", F.concat_ws(":", slug(F.col("metric_id")), slug(F.col("grain")), slug(F.col("entity")), slug(label)))
    )


def worth_surfacing() -> Column:
    """Favourable movements only when they look like instrumentation; trivial ones only when breaching."""
    loud = F.col("adverse") | (F.abs("z") >= INSTRUMENTATION_Z)
    big = (F.abs("points") >= MIN_EFFECT) | F.col("sla_breached")
    return loud & big


def ranking_severity() -> Column:
    size = F.least(F.abs("z") / 5.0, F.lit(1.0))
    return F.when(F.col("severity") > 0, _unit(F.col("severity"))).otherwise(F.when(F.col("adverse"), size).otherwise(size * 0.5))


def confidence() -> Column:
    sample = _unit(F.log1p(F.col("n").cast("double")) / F.log1p(F.lit(float(SATURATION))))
    return sample * (COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * _unit(F.col("coverage")))


def actionability() -> Column:
    """Weight of the grain; case and separators in its name do not matter."""
    bare = {re.sub("[^a-z0-9]", "", k.lower()): v for k, v in ACTIONABILITY.items()}
    return F.coalesce(M.lookup(F.regexp_replace(F.lower("grain"), "[^a-z0-9]", ""), bare, "double"), F.lit(DEFAULT_ACTIONABILITY))


def persistence(specs: dict[str, M.MetricSpec]) -> Column:
    """From the remembered streak, else 2 when the prior value also missed the target, else 1."""
    higher = M.per_metric(specs, "higher_is_better", "boolean")
    prior_missed = F.when(higher, F.col("prior") < F.col("sla_target") - 1e-9).otherwise(F.col("prior") > F.col("sla_target") + 1e-9)
    derived = F.when(F.col("sla_breached") & F.coalesce(prior_missed, F.lit(False)), 2).otherwise(1)
    known = F.col("known_streak")
    streak = F.when(known.isNotNull(), F.greatest(known, F.lit(1))).otherwise(derived)
    return _unit(PERSISTENCE_BASE + PERSISTENCE_STEP * (streak - 1))


def rank(found: DataFrame, specs: dict[str, M.MetricSpec], top_n: int | None = TOP_N) -> DataFrame:
    """Composite score per finding and its place within its period.

    ``known_streak`` and ``suppression`` come from memory where present. Findings are a small aggregated table.
    """
    for name, kind, default in (("known_streak", "int", None), ("suppression", "double", 0.0)):
        if name not in found.columns:
            found = found.withColumn(name, F.lit(default).cast(kind))
    scored = (
        found.filter(worth_surfacing())
        .withColumns(
            {
                "rank_severity": ranking_severity(), "rank_confidence": confidence(), "actionability": actionability(),
                "persistence": persistence(specs),
            }
        )
        .withColumn(
            "score",
            F.col("rank_severity") * F.col("rank_confidence") * F.col("actionability") * F.col("persistence")
            * (1 - F.coalesce("suppression", F.lit(0.0))),
        )
        .filter(F.col("score") > SCORE_FLOOR)
    )
    order = W.partitionBy("period").orderBy(F.col("score").desc(), F.abs("points").desc(), F.col("finding_id"))
    placed = scored.withColumn("place", F.row_number().over(order))
    return placed if top_n is None else placed.filter(F.col("place") <= top_n)


def memory_context(found: DataFrame, evidence: DataFrame, suppressed_ids: DataFrame) -> DataFrame:
    """Adds ``suppression`` and ``known_streak`` from open incidents of other periods and from suppressed findings.

    ``evidence`` holds one row per open incident and cited (metric_id, entity) with its period and streak.
    """
    seen = evidence.select("metric_id", "entity", F.col("period").alias("__p"), F.greatest("streak", F.lit(1)).alias("__depth"))
    hits = (
        found.select("finding_id", "metric_id", "entity", "period")
        .join(seen, ["metric_id", "entity"])
        .filter("__p <> period")
        .groupBy("finding_id")
        .agg(F.max("__depth").alias("__depth"))
    )
    muted = suppressed_ids.select("finding_id").distinct().withColumn("__muted", F.lit(True))
    joined = found.join(hits, "finding_id", "left").join(muted, "finding_id", "left")
    is_muted = F.coalesce("__muted", F.lit(False))
    return joined.withColumns(
        {
            "suppression": F.when(is_muted, 1.0).when(F.col("__depth").isNotNull(), 0.6).otherwise(0.0),
            "known_streak": F.when(~is_muted, F.col("__depth") + 1).cast("int"),
        }
    ).drop("__depth", "__muted")


def standing_outliers(slices: DataFrame, specs: dict[str, M.MetricSpec], limit: int | None = TOP_N) -> DataFrame:
    """Entities far on the wrong side of their peers within one period, largest distance first, per period."""
    cohort = W.partitionBy("metric_id", "grain", "period")
    higher = M.per_metric(specs, "higher_is_better", "boolean")
    best_first = F.when(higher, -F.col("value")).otherwise(F.col("value"))
    df = (
        slices.filter((F.col("grain") != M.GLOBAL) & F.col("value").isNotNull())
        .withColumns(
            {
                "peers": F.count("*").over(cohort), "median": F.median("value").over(cohort),
                "rank": F.row_number().over(cohort.orderBy(best_first, F.col("entity"))),
            }
        )
        .withColumn("gap", F.abs(F.col("value") - F.col("median")))
        .withColumn("mad", F.median("gap").over(cohort))
        .filter((F.col("peers") >= STANDING_COHORT) & (F.col("mad") > 0))
        .withColumn("z", robust.robust_z(F.col("value"), F.col("median"), F.col("mad")))
    )
    base = F.abs("median")
    material = F.when(M.per_metric(specs, "rate_metric", "boolean"), F.col("gap") >= STANDING_RATE_GAP).otherwise(
        F.when(base < 1e-9, F.col("gap") > 1e-9).otherwise(F.col("gap") >= base * STANDING_RELATIVE_GAP)
    )
    wrong_side = F.when(higher, F.col("z") < 0).otherwise(F.col("z") > 0)
    kept = df.filter(wrong_side & (F.abs("z") >= STANDING_Z) & material)
    order = W.partitionBy("period").orderBy(F.abs("z").desc(), "metric_id", "grain", "entity")
    kept = kept.withColumn("place", F.row_number().over(order))
    return (kept if limit is None else kept.filter(F.col("place") <= limit)).drop("gap")
