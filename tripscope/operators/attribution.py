"""Exact rate/mix decomposition of a movement, for every metric, grain and period in one pass.

A slice serves its own period as "now" and the next one as "before"; grouping on that pair replaces a self-join of the
slices table. All windows run over the entities of one grain in one period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.operators import metrics as M

# Fixed values of the attribution contract.
TOP_K = 3
DISPERSION_FLOOR = 0.25
EPSILON = 1e-12
API_TOLERANCE = 0.005
MIX_NEGLIGIBLE = 0.10
# Sizes that differ only by the order of a floating-point sum count as tied and go by name.
NOISE_PLACES = 9


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def clean_weight(w: Column) -> Column:
    """Missing, non-finite and negative weights count as zero."""
    return F.when(_finite(w), F.greatest(w.cast("double"), F.lit(0.0))).otherwise(0.0)


def clean_rate(r: Column) -> Column:
    return F.when(_finite(r), r).otherwise(0.0)


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def decompose(sides: DataFrame, keys: list[str]) -> DataFrame:
    """Rate and mix effect per entity from columns entity, r0, w0, r1, w1 (null where an entity is absent).

    Adds the shares, the period rates ``base_rate`` and ``current_rate``, and each entity's place by size of effect.
    """
    group = W.partitionBy(*keys)
    df = sides.withColumns(
        {"r0": clean_rate(F.col("r0")), "r1": clean_rate(F.col("r1")), "w0": clean_weight(F.col("w0")), "w1": clean_weight(F.col("w1"))}
    ).withColumns({"__t0": F.sum("w0").over(group), "__t1": F.sum("w1").over(group)})
    share = {
        f"w{i}_share": F.when(F.col(f"__t{i}") > EPSILON, F.col(f"w{i}") / F.col(f"__t{i}")).otherwise(0.0) for i in (0, 1)
    }
    df = df.withColumns(share).withColumns(
        {
            "base_rate": F.when(F.col("__t0") > EPSILON, F.sum(F.col("w0") * F.col("r0")).over(group) / F.col("__t0")).otherwise(0.0),
            "current_rate": F.when(F.col("__t1") > EPSILON, F.sum(F.col("w1") * F.col("r1")).over(group) / F.col("__t1")).otherwise(0.0),
        }
    )
    df = df.withColumns(
        {
            "rate_effect": F.col("w1_share") * (F.col("r1") - F.col("r0")),
            "mix_effect": (F.col("w1_share") - F.col("w0_share")) * (F.col("r0") - F.col("base_rate")),
        }
    ).withColumn("total", F.col("rate_effect") + F.col("mix_effect"))
    place = F.row_number().over(group.orderBy(F.round(F.abs("total"), NOISE_PLACES).desc(), F.col("entity")))
    return df.withColumn("place", place).drop("__t0", "__t1")


def reconciliation(contributions: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of effects against the implied movement, per group."""
    return contributions.groupBy(*keys).agg(
        F.sum("total").alias("explained"),
        (F.first("current_rate") - F.first("base_rate")).alias("implied_delta"),
        F.abs(F.sum("total") - (F.first("current_rate") - F.first("base_rate"))).alias("error"),
    )


def paired(slices: DataFrame, months: int) -> DataFrame:
    """Each slice beside its calendar predecessor, kept where either side exists."""
    here = F.struct(F.col("period").alias("at"), F.lit(True).alias("now"))
    ahead = F.struct(F.add_months("period", months).alias("at"), F.lit(False).alias("now"))
    rows = slices.select("metric_id", "grain", "entity", "value", "n", F.inline(F.array(here, ahead)))
    now, before = F.col("now"), ~F.col("now")
    return rows.groupBy("metric_id", "grain", "entity", F.col("at").alias("period")).agg(
        F.max(F.when(now, F.col("value"))).alias("value"),
        F.max(F.when(now, F.col("n"))).alias("n"),
        F.max(F.when(before, F.col("value"))).alias("prior"),
        F.max(F.when(before, F.col("n"))).alias("prior_n"),
    )


GROUP = ["metric_id", "grain", "period"]


def contributions(slices: DataFrame, specs: dict[str, M.MetricSpec], months: int = 1, floor: int = 500) -> DataFrame:
    """Decomposition of every metric whose total is measured in both periods, over every grain with two entities or more.

    An entity enters when its larger sample reaches the gate; a side below the metric's own gate is left out.
    """
    pairs = paired(slices, months)
    whole = W.partitionBy("metric_id", "period")
    pairs = pairs.withColumn(
        "actual_delta", F.max(F.when(F.col("grain") == M.GLOBAL, F.col("value") - F.col("prior"))).over(whole)
    )
    gate = F.greatest(M.per_metric(specs, "min_sample", "bigint"), F.lit(floor))
    eligible = pairs.filter(
        (F.col("grain") != M.GLOBAL)
        & F.col("actual_delta").isNotNull()
        & (F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("prior_n", F.lit(0))) >= gate)
        & (F.col("value").isNotNull() | F.col("prior").isNotNull())
    ).withColumn("n_entities", F.count("*").over(W.partitionBy(*GROUP)))
    sides = eligible.filter("n_entities >= 2").select(
        *GROUP, "entity", "actual_delta", "n_entities",
        F.col("prior").alias("r0"), F.when(F.col("prior").isNotNull(), F.col("prior_n")).alias("w0"),
        F.col("value").alias("r1"), F.when(F.col("value").isNotNull(), F.col("n")).alias("w1"),
        (F.col("value").isNotNull() & F.col("prior").isNotNull()).alias("in_both"),
    )
    return decompose(sides, GROUP)


def attribution(contrib: DataFrame) -> DataFrame:
    """One row per metric, grain and period: how much of the movement the grain explains, and its rank among grains."""
    weight = F.when(F.col("in_both"), F.col("w1")).otherwise(0.0)
    step = F.when(F.col("in_both"), F.col("r1") - F.col("r0")).otherwise(0.0)
    top = F.col("place") <= TOP_K
    rows = contrib.groupBy(*GROUP).agg(
        F.first("actual_delta").alias("delta"),
        F.count("*").alias("n_entities"),
        F.sum(F.when(top, F.col("total")).otherwise(0.0)).alias("explained_delta"),
        F.sum("total").alias("__sum"),
        F.sum(F.abs("total")).alias("gross_total"),
        F.sum(F.abs("mix_effect")).alias("gross_mix"),
        F.sum(F.when(top, F.abs("total")).otherwise(0.0)).alias("__top"),
        F.sum(weight).alias("__w"),
        F.sum(weight * F.abs(step - F.col("actual_delta"))).alias("__dev"),
        F.sum(weight * F.abs(step)).alias("__move"),
        F.sum("w1").cast("bigint").alias("sample_size"),
        F.min_by("entity", "place").alias("leader"),
    )
    delta = F.abs("delta")
    scale = F.greatest(F.col("__move") / F.nullif(F.col("__w"), F.lit(0.0)), delta)
    rows = rows.withColumns(
        {
            "concentration": F.when(F.col("gross_total") > EPSILON, _unit(F.col("__top") / F.col("gross_total"))).otherwise(0.0),
            "explained": F.when(delta > EPSILON, _unit(F.abs("explained_delta") / delta)).otherwise(0.0),
            "dispersion": F.when(
                (F.col("__w") > EPSILON) & (scale > EPSILON), _unit(F.col("__dev") / F.col("__w") / scale)
            ).otherwise(0.0),
            "reconciliation_error": F.abs(F.col("__sum") - F.col("delta")),
            "mix_fraction": F.when(F.col("gross_total") > 0, F.col("gross_mix") / F.col("gross_total")),
        }
    ).withColumn(
        "power", F.col("explained") * F.col("concentration") * (DISPERSION_FLOOR + (1 - DISPERSION_FLOOR) * F.col("dispersion"))
    )
    order = W.partitionBy("metric_id", "period").orderBy(F.round("power", NOISE_PLACES).desc(), F.col("grain"))
    return rows.withColumns(
        {
            "grain_rank": F.row_number().over(order),
            "verdict": F.when(F.col("mix_fraction") < MIX_NEGLIGIBLE, "rate").when(F.col("mix_fraction").isNotNull(), "mix"),
        }
    ).drop("__sum", "__top", "__w", "__dev", "__move")


def owner_evidence(attributed: DataFrame) -> DataFrame:
    """Per metric and period: the winning grain, its leading entity, and how much vendors explain."""
    best = F.col("grain_rank") == 1
    return attributed.groupBy("metric_id", "period").agg(
        F.max(F.when(best, F.col("grain"))).alias("winner"),
        F.max(F.when(best, F.col("leader"))).alias("winner_entity"),
        F.max(F.when(F.col("grain").isin("vendor", "vendor_id"), F.col("power"))).alias("vendor_power"),
    )


def two_period(rows: DataFrame, period: str, entity: str, value: str, months: int = 1) -> DataFrame:
    """Decomposition of a per-row average straight from detail rows: aggregate once, then pair the periods."""
    agg = rows.groupBy(F.col(period).alias("period"), F.col(entity).alias("entity")).agg(
        F.avg(value).alias("value"), F.count(value).alias("n")
    )
    sides = paired(agg.withColumns({"metric_id": F.lit(value), "grain": F.lit(entity)}), months)
    both = W.partitionBy("period")
    sides = sides.withColumns({"__now": F.count("n").over(both), "__before": F.count("prior_n").over(both)}).filter(
        "__now > 0 and __before > 0"
    )
    return decompose(
        sides.select("period", "entity", F.col("prior").alias("r0"), F.col("prior_n").alias("w0"), F.col("value").alias("r1"), F.col("n").alias("w1")),
        ["period"],
    )


def counterfactual(rows: DataFrame, period: str, stratum: str, numerator: str, exposure: str, months: int = 1) -> DataFrame:
    """Change of a ratio of sums split into rate and mix by repricing today's exposure at yesterday's stratum rates."""
    agg = rows.groupBy(F.col(period).alias("period"), F.col(stratum).alias("stratum")).agg(
        F.sum(numerator).alias("num"), F.sum(exposure).alias("e")
    )
    here = F.struct(F.col("period").alias("at"), F.lit(True).alias("now"))
    ahead = F.struct(F.add_months("period", months).alias("at"), F.lit(False).alias("now"))
    pairs = (
        agg.select("stratum", "num", "e", F.inline(F.array(here, ahead)))
        .groupBy(F.col("at").alias("period"), "stratum")
        .agg(
            F.max(F.when(F.col("now"), F.col("num"))).alias("num1"), F.max(F.when(F.col("now"), F.col("e"))).alias("e1"),
            F.max(F.when(~F.col("now"), F.col("num"))).alias("num0"), F.max(F.when(~F.col("now"), F.col("e"))).alias("e0"),
        )
        .filter("num1 is not null and num0 is not null and e0 > 0 and e1 > 0")
    )
    return (
        pairs.groupBy("period")
        .agg(
            (F.sum("num1") / F.sum("e1")).alias("rate_now"),
            (F.sum(F.col("num0") / F.col("e0") * F.col("e1")) / F.sum("e1")).alias("repriced"),
            (F.sum("num0") / F.sum("e0")).alias("rate_before"),
        )
        .withColumns({"rate_effect": F.col("rate_now") - F.col("repriced"), "mix_effect": F.col("repriced") - F.col("rate_before")})
    )
