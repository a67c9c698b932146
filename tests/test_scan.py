import pytest
from pyspark.sql import functions as F

from tripscope.operators import anomaly as A
from tripscope.operators import benchmark, metrics as M

OTA = {"ota": M.DEFAULT_CATALOG["ota"]}


def observed(slices, specs=OTA):
    return benchmark.observe(slices, specs)


def pair(grain, entity, before, now, n, n0=None, metric="ota"):
    return [(metric, grain, entity, "2026-05-01", before, n0 or n), (metric, grain, entity, "2026-06-01", now, n)]


def test_small_slices_are_gated(spark, slices_of):
    rows = pair("trip_nodal", "SHUTTLE", 0.98, 0.714, 81, 82) + [r for i in range(4) for r in pair("trip_nodal", f"n{i}", 0.95, 0.95, 9000)]
    assert A.findings(observed(slices_of(rows)), OTA).count() == 0


def test_cross_sectional_outlier_is_flagged(spark, slices_of):
    rows = [r for i in range(8) for r in pair("office", f"o{i}", 0.95, 0.945, 20000)] + pair("office", "bad", 0.95, 0.87, 20000)
    got = A.findings(observed(slices_of(rows)), OTA).collect()
    assert [g.entity for g in got] == ["bad"]
    assert got[0].finding_id == "ota:office:bad:2026_06" and got[0].points == pytest.approx(-8.0) and got[0].z < -2


def test_prior_is_the_calendar_month_not_the_last_measured(spark, slices_of):
    rows = [("ota", "office", "a", "2026-04-01", 0.95, 900), ("ota", "office", "a", "2026-06-01", 0.90, 900)]
    got = {str(r.period): r.prior for r in observed(slices_of(rows)).collect()}
    assert got["2026-06-01"] is None


def test_temporal_z_needs_three_earlier_steps(spark, slices_of):
    values = [0.95, 0.94, 0.95, 0.945, 0.80]
    rows = [("ota", "global", "ALL", f"2026-0{i + 1}-01", v, 9000) for i, v in enumerate(values)]
    got = {str(r.period): r for r in observed(slices_of(rows)).collect()}
    assert got["2026-05-01"].z_basis == "temporal" and got["2026-05-01"].robust_z < -3
    assert got["2026-04-01"].z_basis == "none" and got["2026-04-01"].robust_z is None


def test_severity_without_a_z_score_comes_from_the_target_alone(spark, slices_of):
    rows = pair("global", "ALL", 0.97, 0.9246, 9000)
    got = {str(r.period): r for r in observed(slices_of(rows)).collect()}
    assert got["2026-06-01"].robust_z is None
    assert got["2026-06-01"].severity == pytest.approx((0.95 - 0.9246) / 0.95 / 0.05)
    assert got["2026-05-01"].severity == 0.0


def test_advisory_target_does_not_score(spark, slices_of):
    specs = {"escort_compliance": M.DEFAULT_CATALOG["escort_compliance"]}
    rows = pair("global", "ALL", 0.5, 0.45, 9000, metric="escort_compliance")
    got = [r for r in observed(slices_of(rows), specs).collect() if str(r.period) == "2026-06-01"][0]
    assert got.sla_breached and got.severity == 0.0


def test_peer_rank_is_best_first_and_ties_go_by_name(spark, slices_of):
    rows = [("ota", "office", e, "2026-06-01", v, 900) for e, v in (("c", 0.9), ("a", 0.95), ("b", 0.95))]
    got = {r.entity: (r.peer_rank, r.peer_percentile) for r in observed(slices_of(rows)).collect()}
    assert got == {"a": (1, 100.0), "b": (2, 50.0), "c": (3, 0.0)}


def _found(slices_of):
    rows = [r for i in range(8) for r in pair("office", f"o{i}", 0.95, 0.945, 20000)]
    rows += pair("office", "bad", 0.95, 0.87, 20000) + pair("office", "worse", 0.95, 0.80, 20000) + pair("office", "better", 0.90, 0.96, 20000)
    return A.findings(observed(slices_of(rows)), OTA)


def test_ranking_puts_the_worst_first_and_drops_quiet_improvements(spark, slices_of):
    got = A.rank(_found(slices_of), OTA).orderBy("place").collect()
    names = [g.entity for g in got]
    assert names[:2] == ["worse", "bad"] or got[0].score >= got[1].score
    assert {"bad", "worse"} <= set(names)


def test_suppression_and_memory_change_the_score(spark, slices_of):
    found = _found(slices_of)
    plain = {r.entity: r.score for r in A.rank(found, OTA).collect()}
    evidence = spark.createDataFrame([("ota", "bad", "2026-05-01", 1)], "metric_id string, entity string, p string, streak int").select(
        "metric_id", "entity", F.to_date("p").alias("period"), "streak"
    )
    muted = found.filter("entity = 'worse'").select("finding_id")
    remembered = {r.entity: r for r in A.rank(A.memory_context(found, evidence, muted), OTA).collect()}
    assert "worse" not in remembered and remembered["bad"].known_streak == 2
    assert remembered["bad"].score == pytest.approx(plain["bad"] / plain_persistence(found, "bad") * 0.85 * 0.4)


def plain_persistence(found, entity):
    return A.rank(found, OTA).filter(F.col("entity") == entity).first().persistence


def test_persistence_without_memory_uses_the_prior_breach(spark, slices_of):
    rows = pair("global", "ALL", 0.94, 0.90, 9000) + pair("business_unit", "u", 0.97, 0.90, 9000)
    got = {r.grain: r.persistence for r in A.rank(A.findings(observed(slices_of(rows)), OTA), OTA).collect()}
    assert got == {"global": pytest.approx(0.85), "business_unit": pytest.approx(0.7)}


def test_standing_outlier(spark, slices_of):
    rows = [("ota", "vendor", f"v{i}", "2026-06-01", 0.95 + i * 0.001, 900) for i in range(8)] + [("ota", "vendor", "low", "2026-06-01", 0.80, 900)]
    got = A.standing_outliers(slices_of(rows), OTA).collect()
    assert [(g.entity, g.rank, g.peers) for g in got] == [("low", 9, 9)]
    assert A.standing_outliers(slices_of(rows[:3] + rows[-1:]), OTA).count() == 0
