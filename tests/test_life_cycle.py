"""The fold of an incident's events."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripscope.operators import incidents as I
from tripscope.operators import life_cycle

D = dt.date.fromisoformat
PERIODS = [D(f"2026-0{m}-01") for m in range(1, 8)]


@pytest.fixture(scope="module")
def lives(spark):
    # On-time rates by month; the target is 0.95.
    series = {"a": [0.9, 0.9, 0.9, None, 0.8, 0.99, 0.5], "b": [0.9, 0.99, 0.5, 0.5, 0.5, 0.5, 0.5], "c": [0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9], "d": [0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0.9], "e": [0.9, None, None, None, None, None, None]}
    seen = spark.createDataFrame([("ota", "unit", e, p, v) for e, vs in series.items() for p, v in zip(PERIODS, vs)], "metric_id string, grain string, entity string, period date, value double")
    opened = [(f"inc-{e}-2026-01", "ota", "unit", e, PERIODS[0], s) for e, s in (("a", 1), ("b", 0), ("c", 2), ("d", 1), ("e", None), ("gone", 1))] + [("inc-late-2026-07", "ota", "unit", "c", PERIODS[6], 1)]
    done = [("inc-c-2026-01", D("2026-04-15"), life_cycle.DISMISS), ("inc-d-2026-01", D("2026-02-01"), life_cycle.PURGE), ("inc-d-2026-01", D("2026-03-01"), life_cycle.DISMISS)]
    out = life_cycle.folded(
        spark.createDataFrame(opened, "incident_id string, metric_id string, grain string, entity string, period date, streak int"), life_cycle.measured_series(seen, 1),
        life_cycle.operator_events(spark.createDataFrame(done, "incident_id string, at date, kind int")),
    )
    return {r.incident_id: r for r in out.collect()}


@pytest.mark.parametrize("incident, status, escalations, waiting, closed, last", [
    ("inc-a-2026-01", I.RESOLVED, 3, 1, "2026-07-01", "inc-a-2026-01-esc3"),  # two breaches, a gap, a breach, then back; what follows no longer counts
    ("inc-b-2026-01", I.RESOLVED, 0, 0, "2026-03-01", None),
    ("inc-c-2026-01", I.DISMISSED, 2, 0, "2026-04-15", "inc-c-2026-01-esc3"),  # depth went on from its streak until an operator closed it
    ("inc-d-2026-01", I.UNRESOLVED, 0, 0, "2026-02-01", None),
    ("inc-e-2026-01", I.OPEN, 0, 6, None, None),
    ("inc-gone-2026-01", I.OPEN, 0, 0, None, None),
    ("inc-late-2026-07", I.OPEN, 0, 0, None, None),
])
def test_end_state(lives, incident, status, escalations, waiting, closed, last):
    r = lives[incident]
    assert (r.status, r.escalations, r.waiting, r.closed_on, r.last_escalation) == (status, escalations, waiting, closed and D(closed), last)
    assert [s.depth for s in r.steps] == sorted(s.depth for s in r.steps) and len(r.steps) == escalations


def test_first_step_equals_the_follow_up_chain(spark):
    """On the first re-check, the fold and the chain of single operators agree."""
    values = [("u", 0.9), ("v", 0.99), ("w", None)]
    seen = spark.createDataFrame([("ota", "unit", e, p, x) for e, v in values for p, x in ((PERIODS[0], 0.9), (PERIODS[1], v))], "metric_id string, grain string, entity string, period date, value double").withColumn("n", F.lit(500))
    stored = spark.createDataFrame([(f"inc-{e}-2026-01", "ota", "unit", e, PERIODS[0], 1, I.OPEN, D("2026-02-01")) for e, _ in values],
                                   "incident_id string, metric_id string, grain string, entity string, period date, streak int, status string, detected_on date")
    asked = I.schedule(stored).withColumn("override", F.add_months("origin", 1))
    latest = spark.createDataFrame([("ota", PERIODS[1])], "metric_id string, latest_period date")
    chain = {r.incident_id: r.state for r in I.outcome(I.recheck_period(asked, latest), stored, seen).collect()}
    fold = life_cycle.folded(stored, life_cycle.measured_series(seen, 1), life_cycle.operator_events(stored.limit(0).select("incident_id", F.col("detected_on").alias("at"), F.lit(0).alias("kind"))))
    got = {r.incident_id: I.ESCALATED if r.escalations else {I.RESOLVED: I.RECOVERED, I.OPEN: I.PENDING}[r.status] for r in fold.collect()}
    assert got == chain
