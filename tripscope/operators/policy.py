"""Target rules: lookup by metric name, signed gaps, bands and breach streaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.operators.metrics import lookup

# Band limits on the relative gap, and the breaches in a row that permit an escalation.
MAJOR_GAP = 0.02
CRITICAL_GAP = 0.05
ESCALATION_STREAK = 2
NO_RULE = "SLA-NONE-000"

# Rule id, metric, direction, unit, target, and the names that resolve to the rule.
RULES = [
    ("SLA-OTA-001", "ota", "higher", "ratio", 0.95, ["ota", "on_time_arrival", "on_time_arrival_rate", "ota_rate"]),
    ("SLA-OTD-001", "otd", "higher", "ratio", 0.95, ["otd", "on_time_departure", "on_time_departure_rate"]),
    ("SLA-ESCORT-001", "escort_compliance", "higher", "ratio", 1.0,
     ["escort_compliance", "escort", "night_escort_compliance", "escort_rate"]),
    ("SLA-ACK-001", "alert_ack_minutes", "lower", "absolute", 15.0,
     ["alert_ack_minutes", "ack_minutes", "alert_acknowledgement_minutes", "alert_ack_time", "acknowledgement_minutes"]),
    ("SLA-CPK-001", "cost_per_km", "lower", "absolute", 85.0, ["cost_per_km", "cost_per_kilometre", "cpk"]),
]


def canonical(metric: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    flat = F.regexp_replace(F.lower(F.trim(metric)), "[^a-z0-9]+", "_")
    return F.regexp_replace(flat, "^_|_$", "")


@dataclass(frozen=True)
class RuleColumns:
    """Rule fields as columns of the row's metric; null where no rule applies."""

    rule_id: Column
    higher: Column
    ratio: Column
    target: Column

    @classmethod
    def of(cls, metric: Column) -> RuleColumns:
        key = canonical(metric)
        names = [(alias, r) for r in RULES for alias in r[5]]
        return cls(
            lookup(key, {a: r[0] for a, r in names}, "string"),
            lookup(key, {a: r[2] == "higher" for a, r in names}, "boolean"),
            lookup(key, {a: r[3] == "ratio" for a, r in names}, "boolean"),
            lookup(key, {a: r[4] for a, r in names}, "double"),
        )

    @classmethod
    def for_specs(cls, specs) -> RuleColumns:
        """Only metrics that declare a target; the target is the spec's own."""
        key = F.col("metric_id")
        bound = {k: s for k, s in specs.items() if s.sla_target is not None}
        return cls(
            key,
            lookup(key, {k: s.higher_is_better for k, s in bound.items()}, "boolean"),
            lookup(key, {k: s.rate_metric for k, s in bound.items()}, "boolean"),
            lookup(key, {k: s.sla_target for k, s in bound.items()}, "double"),
        )

    def rescaled(self, value: Column) -> Column:
        """A ratio reported in percent is brought back to 0..1."""
        percent = self.ratio & (self.target <= 1.0 + 1e-9) & (value > 1.0 + 1e-9)
        return F.when(percent, value / 100.0).otherwise(value)

    def gap(self, value: Column) -> Column:
        """Positive when the target is missed."""
        v = self.rescaled(value)
        return F.when(self.higher, self.target - v).when(~self.higher, v - self.target)

    def relative_gap(self, value: Column) -> Column:
        size = F.abs(self.target)
        return F.when(size < 1e-9, self.gap(value)).otherwise(self.gap(value) / size)

    def breached(self, value: Column) -> Column:
        return F.coalesce((self.gap(value) > 0) & ~F.isnan(value), F.lit(False))


def band(relative_gap: Column) -> Column:
    return (
        F.when(relative_gap <= 0, "NONE").when(relative_gap < MAJOR_GAP, "MINOR").when(relative_gap < CRITICAL_GAP, "MAJOR")
        .otherwise("CRITICAL")
    )


def decide(df: DataFrame, metric: str = "metric_id", value: str = "value", prior: str = "prior", known_streak: str | None = None) -> DataFrame:
    """Rule id, breach, streak, escalation and band per row.

    The streak continues from ``known_streak`` where memory has one, else from whether the prior value breached.
    """
    rule = RuleColumns.of(F.col(metric))
    before = F.when(rule.breached(F.col(prior)), 1).otherwise(0)
    if known_streak:
        known = F.col(known_streak)
        before = F.when(known.isNotNull(), F.greatest(known - 1, F.lit(0))).otherwise(before)
    gap = rule.relative_gap(F.col(value))
    relative = F.when(gap.isNull() | F.isnan(gap), F.lit(0.0)).otherwise(gap)  # an unusable value is no breach
    return (
        df.withColumns(
            {"rule_id": F.coalesce(rule.rule_id, F.lit(NO_RULE)), "breached": relative > 0, "band": band(relative), "__before": before}
        )
        .withColumn("streak", F.when(F.col("breached"), F.col("__before") + 1).otherwise(0).cast("int"))
        .withColumn("escalation_permitted", F.col("breached") & (F.col("streak") >= ESCALATION_STREAK))
        .drop("__before")
    )


def breach_streaks(observations: DataFrame, months: int = 1) -> DataFrame:
    """Running count of breaching periods in a row per slice; an unmeasured or missing period ends the run."""
    entity = W.partitionBy("metric_id", "grain", "entity")
    slot = F.months_between("period", F.lit("1970-01-01").cast("date")).cast("int") / months
    hits = observations.filter("sla_breached").withColumn(
        "__island", slot.cast("int") - F.row_number().over(entity.orderBy("period"))
    )
    island = W.partitionBy("metric_id", "grain", "entity", "__island").orderBy("period")
    return hits.withColumn("streak", F.row_number().over(island)).drop("__island").withColumn(
        "escalation_permitted", F.col("streak") >= ESCALATION_STREAK
    )
