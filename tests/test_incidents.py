import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripscope.operators import grounding
from tripscope.operators import incidents as I

def today():
    return F.lit("2026-07-08").cast("date")


def follow_ups(spark, ids, metric="ota", due="2026-07-08", origin="2026-06-01"):
    rows = [(i, metric, "office", "a", dt.date.fromisoformat(origin), dt.date.fromisoformat(due), "PENDING", None) for i in ids]
    return spark.createDataFrame(rows, "incident_id string, metric_id string, grain string, entity string, origin date, due_on date, state string, note string")


def memory(spark, rows):
    data = [(i, s, "ota office a down", p, k, "SLA-OTA-001", ["f1"], [("claim", "ota", "a")], "transport_manager", "Routing desk", "routing", False) for i, s, p, k in rows]
    return spark.createDataFrame(data, "incident_id string, status string, title string, priority int, streak int, rule_id string, finding_ids array<string>, evidence array<struct<claim:string,metric_id:string,entity:string>>, persona string, recipient string, desk string, vendor_supported boolean")


def observations(spark, value):
    return spark.createDataFrame([("ota", "office", "a", dt.date(2026, 7, 1), value, 900)], "metric_id string, grain string, entity string, period date, value double, n bigint")


def outcomes(spark, value, status="OPEN", latest="2026-07-01"):
    fu = follow_ups(spark, ["inc-ota-down-2026-06"])
    late = spark.createDataFrame([("ota", dt.date.fromisoformat(latest))], "metric_id string, latest_period date")
    mem = memory(spark, [("inc-ota-down-2026-06", status, 2, 1)]) if status else memory(spark, [("other", "OPEN", 1, 1)])
    return I.outcome(I.recheck_period(fu, late), mem, observations(spark, value)), mem


@pytest.mark.parametrize("value,status,latest,state", [
    (0.97, "OPEN", "2026-07-01", "RECOVERED"), (0.90, "OPEN", "2026-07-01", "ESCALATED"), (None, "OPEN", "2026-07-01", "PENDING"),
    (0.90, "OPEN", "2026-06-01", "PENDING"), (0.90, "DISMISSED", "2026-07-01", "RECOVERED"), (0.90, "resolved", "2026-07-01", "RECOVERED"), (0.90, None, "2026-07-01", "UNRESOLVED")])
def test_follow_up_outcomes(spark, value, status, latest, state):
    assert outcomes(spark, value, status, latest)[0].first().state == state


def test_escalation_chain(spark):
    oc, mem = outcomes(spark, 0.90)
    got = I.escalations(oc, mem, today()).first()
    assert got.incident_id == "inc-ota-down-2026-06-esc1" and got.priority == 1 and got.streak == 2 and got.incident_band == "CRITICAL"
    assert got.title == "ESCALATED: ota office a down" and len(got.evidence) == 2 and str(got.follow_up_on) == "2026-07-15"
    # A second round keeps the root id and the single prefix, and the priority stays at 1.
    second = spark.createDataFrame([(got.incident_id, "OPEN", got.title, 1, 2, "SLA-OTA-001", ["f1"], [("c", "ota", "a")], "p", "r", "vendor", True)], mem.schema)
    oc2 = oc.withColumn("incident_id", F.lit(got.incident_id))
    again = I.escalations(oc2, second, today()).first()
    assert again.incident_id == "inc-ota-down-2026-06-esc2" and again.title == got.title and again.priority == 1 and again.streak == 3


def test_escalations_have_actions_and_follow_ups(spark):
    oc, mem = outcomes(spark, 0.90)
    escalated = I.escalations(oc, mem, today())
    assert {r.type: r.state for r in I.outbox(escalated).collect()} == {"notify": "SENT", "vendor_escalation": "BLOCKED", "auto_reallocate": "BLOCKED"}
    follow = I.schedule(escalated).first()
    assert follow.incident_id.endswith("-esc1") and str(follow.due_on) == "2026-07-15" and str(follow.origin) == "2026-06-01"


def test_recovery_resolves_only_open_incidents(spark):
    for value, status, after in ((0.97, "OPEN", "RESOLVED"), (0.97, "DISMISSED", "DISMISSED"), (0.90, "OPEN", "OPEN"), (None, "OPEN", "OPEN")):
        oc, mem = outcomes(spark, value, status)
        assert I.settled(mem, oc).first().status == after
        assert I.follow_up_audit(oc).first().stage == "follow_up"


def test_triage_leaves_nothing_out_unless_told(spark):
    rows = [(dt.date(2026, 6, 1), f"f{i}", f"m{i % 7}", "office", "a", 1.0, 0.5, 1.0, 9, 2.0, 1.0 - i / 100, 0.5, 1.0, "HIGH", 0, i + 1) for i in range(70)]
    ranked = spark.createDataFrame(rows, "period date, finding_id string, metric_id string, grain string, entity string, value double, prior double, points double, n bigint, z double, score double, severity double, coverage double, confidence string, known_streak int, place int")
    drafts = I.triage(ranked).collect()
    assert len(drafts) == 7 and all(len(d.finding_ids) == d.n_members == 10 for d in drafts)
    cut = I.triage(ranked, max_incidents=5, max_members=6).collect()
    assert len(cut) == 5 and all(len(d.finding_ids) == 6 and d.n_members == 10 for d in cut)


def test_due_and_mark_due(spark):
    fu = follow_ups(spark, ["a", "b"], due="2026-08-01")
    assert I.due(fu, today()).count() == 0
    marked = I.mark_due(fu, spark.createDataFrame([("a",)], "incident_id string"), today())
    assert [r.incident_id for r in I.due(marked, today()).collect()] == ["a"]


def test_schedule_reads_the_origin_from_the_id(spark):
    rows = spark.createDataFrame([("inc-ota-down-2026-06", "ota", "g", "e", dt.date(2026, 7, 1)), ("inc-ota-down-2026-06-esc1", "ota", "g", "e", dt.date(2026, 7, 8))], "incident_id string, metric_id string, grain string, entity string, detected_on date")
    assert {str(r.origin) for r in I.schedule(rows).collect()} == {"2026-06-01"}


def test_dismiss_writes_a_wildcard_suppression_and_cancels(spark):
    mem, fu = memory(spark, [("x", "OPEN", 1, 1)]), follow_ups(spark, ["x", "y"])
    closed, muted, cancelled = I.dismiss(mem, fu, spark.createDataFrame([("x",)], "incident_id string"), "known", today())
    assert closed.first().status == "DISMISSED"
    s = muted.first()
    assert (s.metric_id, s.grain, s.entity, s.expires_on) == ("ota", "*", "a", None)
    assert [(r.incident_id, r.state) for r in cancelled.collect()] == [("x", "RECOVERED")]


@pytest.mark.parametrize("sup,hit", [(("OTA", "*", "A", None), True), ((None, None, None, None), True), (("ota", "vendor", "a", None), False), (("*", "office", "*", "2026-07-09"), True), (("*", "office", "*", "2026-07-08"), False)])
def test_suppression_patterns(spark, sup, hit):
    found = spark.createDataFrame([("f", "ota", "office", "a")], "finding_id string, metric_id string, grain string, entity string")
    rules = spark.createDataFrame([sup], "metric_id string, grain string, entity string, e string").withColumn("expires_on", F.to_date("e"))
    assert (I.suppressed(found, rules, today()).count() == 1) == hit


def test_refresh_keeps_closed_status(spark):
    fresh = spark.createDataFrame([("a", "OPEN"), ("b", "OPEN"), ("c", "OPEN")], "incident_id string, status string")
    old = spark.createDataFrame([("a", "DISMISSED"), ("b", "OPEN")], "incident_id string, status string")
    assert {r.incident_id: r.status for r in I.keep_operator_status(fresh, old).collect()} == {"a": "DISMISSED", "b": "OPEN", "c": "OPEN"}


def test_triage_limits_and_order(spark):
    rows = [(f"f{m}{i}", f"m{m}", dt.date(2026, 6, 1), -1.0, 1.0 - m / 10 - i / 100, m * 10 + i) for m in range(7) for i in range(8)]
    cols = "finding_id string, metric_id string, period date, points double, score double, place int"
    df = spark.createDataFrame(rows, cols)
    for c, t in (("grain", "string"), ("entity", "string"), ("value", "double"), ("prior", "double"), ("n", "bigint"), ("z", "double"), ("severity", "double"), ("coverage", "double"), ("confidence", "string"), ("known_streak", "int")):
        df = df.withColumn(c, F.lit(None).cast(t))
    got = I.triage(df, max_incidents=5, max_members=6).orderBy("priority").collect()
    assert [g.priority for g in got] == [1, 2, 3, 4, 5] and got[0].cluster_key == "m0:down"
    assert got[0].n_members == 8 and got[0].finding_ids == [f"f0{i}" for i in range(6)]


@pytest.mark.parametrize("text,ok,bad", [
    ("OTA fell to 92.46% from 0.95 over 1,234 trips in 2026-06", True, []), ("OTA fell to 91.2%", False, ["91.2"]), ("vendor V07 is at 0.925", True, []),
    ("no figures here", True, []), ("a drop of -2.5 points, or 2.5", True, []), ("it took 17 and 17 and 18", False, ["17", "18"])])
def test_grounding(spark, text, ok, bad):
    df = spark.createDataFrame([(text, [0.9246, 0.95, 1234.0, -2.5], ["V07", "2026-06", None])], "t string, v array<double>, l array<string>")
    got = grounding.ground(df, "t", "v", "l").first()
    assert got.grounded == ok and got.offending == bad
