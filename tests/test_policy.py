import pytest
from pyspark.sql import functions as F

from tripscope.operators import incidents as I
from tripscope.operators import policy


def rule_frame(spark, rows):
    return spark.createDataFrame(rows, "metric_id string, value double, prior double, known int")


@pytest.mark.parametrize("value,band", [(0.96, "NONE"), (0.95, "NONE"), (0.9469, "MINOR"), (0.933, "MINOR"), (0.929, "MAJOR"), (0.9246, "MAJOR"), (0.90, "CRITICAL")])
def test_bands(spark, value, band):
    got = policy.decide(rule_frame(spark, [("ota", value, None, None)])).first()
    assert got.band == band and got.breached == (band != "NONE")


def test_streak_and_escalation(spark):
    rows = [("ota", 0.92, 0.97, None), ("ota", 0.92, 0.93, None), ("ota", 0.96, 0.93, None), ("ota", 0.92, 0.97, 3)]
    got = [(r.streak, r.escalation_permitted) for r in policy.decide(rule_frame(spark, rows), known_streak="known").collect()]
    assert got == [(1, False), (2, True), (0, False), (3, True)]


def test_percent_values_are_rescaled(spark):
    r = policy.RuleColumns.of(F.col("metric_id"))
    got = rule_frame(spark, [("ota", 95.31, None, None), ("cost_per_km", 86.0, None, None)]).select(r.rescaled(F.col("value")).alias("v"), r.breached(F.col("value")).alias("b")).collect()
    assert got[0].v == pytest.approx(0.9531) and not got[0].b
    assert got[1].v == 86.0 and got[1].b


@pytest.mark.parametrize("name,rule", [("On-Time Arrival", "SLA-OTA-001"), ("ota_rate", "SLA-OTA-001"), ("COST PER KM", "SLA-CPK-001"), ("cpk", "SLA-CPK-001"),
                                       ("On Time Departure", "SLA-OTD-001"), ("escort", "SLA-ESCORT-001"), ("ack_minutes", "SLA-ACK-001"), ("occupancy", None)])
def test_aliases(spark, name, rule):
    assert spark.range(1).select(policy.RuleColumns.of(F.lit(name)).rule_id.alias("r")).first().r == rule


def test_missing_and_nan_values_do_not_breach(spark):
    rows = rule_frame(spark, [("ota", None, None, None), ("ota", float("nan"), None, None), ("unknown", 0.1, 0.1, None)])
    assert [(r.breached, r.streak) for r in policy.decide(rows).collect()][0] == (False, 0)
    assert policy.decide(rows).collect()[2].rule_id == policy.NO_RULE
    r = policy.RuleColumns.of(F.col("metric_id"))
    assert [x.b for x in rows.select(r.breached(F.col("value")).alias("b")).collect()] == [False, False, False]


def test_streaks_break_at_gaps(spark):
    rows = [("ota", "global", "ALL", p, True) for p in ("2026-01-01", "2026-02-01", "2026-04-01", "2026-05-01", "2026-06-01")]
    df = spark.createDataFrame(rows, "metric_id string, grain string, entity string, p string, sla_breached boolean").withColumn("period", F.to_date("p"))
    assert [r.streak for r in policy.breach_streaks(df).orderBy("period").collect()] == [1, 2, 1, 2, 3]


def _actions(spark, streak, winner, power, metric="ota"):
    owner = I.route(F.lit(metric), F.lit(winner).cast("string"), F.lit("08:00"), F.lit("e"))
    df = spark.range(1).select(owner["recipient"].alias("recipient"), owner["desk"].alias("desk"), owner["persona"].alias("persona"),
        I.vendor_evidence(F.lit(winner).cast("string"), F.lit(power).cast("double")).alias("ev"), F.lit(streak).alias("streak"))
    row = df.withColumn("actions", I.permitted_actions(F.col("streak"), F.col("ev"), F.col("recipient"), F.col("desk"))).first()
    return row, {a.type: a.permitted for a in row.actions}


def test_vendor_escalation_needs_streak_and_evidence(spark):
    assert _actions(spark, 2, "vendor", 0.1)[1] == {"notify": True, "vendor_escalation": True, "review_allocation": False, "auto_reallocate": False}
    assert not _actions(spark, 1, "vendor", 0.9)[1]["vendor_escalation"]
    assert not _actions(spark, 5, "office", 0.24)[1]["vendor_escalation"]
    assert _actions(spark, 2, "office", 0.25)[1]["vendor_escalation"]
    assert not _actions(spark, 2, None, None)[1]["vendor_escalation"]


def test_routing(spark):
    assert _actions(spark, 0, "vendor", 0.5)[0].desk == "vendor"
    assert _actions(spark, 0, "vendor", 0.5, "escort_compliance")[0].desk == "safety"
    assert _actions(spark, 0, "shift_type", 0.1)[0].recipient == "Line manager — 08:00"
    assert _actions(spark, 0, "office", 0.1)[0].recipient == "Routing desk"
