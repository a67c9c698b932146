import random

import pytest
from pyspark.sql import functions as F

from tripscope.operators import attribution as T
from tripscope.operators import metrics as M

SCHEMA = "g string, entity string, r0 double, w0 double, r1 double, w1 double"


def run(spark, rows):
    return T.decompose(spark.createDataFrame([("g", *r) for r in rows], SCHEMA), ["g"])


def check_exact(spark, rows):
    got = T.reconciliation(run(spark, rows), ["g"]).first()
    assert got.error <= 1e-9
    return got


def test_two_entities_reconcile(spark):
    got = check_exact(spark, [("LOGIN", 0.9340, 46800.0, 0.8823, 47270.0), ("LOGOUT", 0.9700, 53200.0, 0.9623, 52730.0)])
    r0 = (0.9340 * 46800 + 0.97 * 53200) / 100000
    r1 = (0.8823 * 47270 + 0.9623 * 52730) / 100000
    assert got.explained == pytest.approx(r1 - r0, abs=1e-9)


def test_pure_mix_has_no_rate_effect(spark):
    rows = run(spark, [("AUTO", 0.965, 70000.0, 0.965, 55000.0), ("MANUAL", 0.905, 30000.0, 0.905, 45000.0)]).collect()
    assert all(abs(r.rate_effect) < 1e-12 for r in rows) and sum(r.mix_effect for r in rows) < 0


def test_pure_rate_has_no_mix_effect(spark):
    rows = run(spark, [("BUS", 0.9420, 40000.0, 0.8795, 40000.0), ("CAB", 0.9600, 60000.0, 0.9380, 60000.0)]).collect()
    assert all(abs(r.mix_effect) < 1e-12 for r in rows)


@pytest.mark.parametrize(
    "rows",
    [
        [("a", 0.9, 100.0, 0.8, 100.0), ("b", 0.7, 50.0, 0.75, 60.0), ("new", None, None, 0.5, 30.0)],
        [("a", 0.9, 100.0, 0.8, 100.0), ("b", 0.7, 50.0, 0.75, 60.0), ("gone", 0.4, 30.0, None, None)],
        [("only before", 0.9, 100.0, None, None), ("only now", None, None, 0.6, 80.0)],
    ],
)
def test_new_departed_and_disjoint_entities(spark, rows):
    check_exact(spark, rows)


@pytest.mark.parametrize("bad", [-6.63, float("nan")])
def test_bad_weights_count_as_zero(spark, bad):
    rows = {r.entity: r for r in run(spark, [("a", 0.9, bad, 0.8, 10.0), ("b", 0.7, 50.0, 0.75, 60.0)]).collect()}
    assert rows["a"].w0 == 0.0 and rows["b"].w0_share == 1.0


def test_large_cohort_reconciles(spark):
    rng = random.Random(7)
    rows = [(f"e{i}", rng.random(), rng.randint(1, 5000) * 1.0, rng.random(), rng.randint(1, 5000) * 1.0) for i in range(2000)]
    check_exact(spark, rows)


def _dimensions(slices_of):
    rows = [("ota", "global", "ALL", "2026-05-01", 0.9531, 100000), ("ota", "global", "ALL", "2026-06-01", 0.9246, 100000)]
    split = {
        "trip_direction": [("LOGIN", 0.934, 0.880), ("LOGOUT", 0.972, 0.969)],
        "route_source": [("AUTO", 0.956, 0.930), ("MANUAL", 0.950, 0.919)],
        "vendor": [(f"V{i:02d}", 0.9531, 0.9246) for i in range(23)],
    }
    for grain, members in split.items():
        for e, a, b in members:
            n = 100000 // len(members)
            rows += [("ota", grain, e, "2026-05-01", a, n), ("ota", grain, e, "2026-06-01", b, n)]
    return slices_of(rows)


def test_uniform_dimension_ranks_last_and_concentrated_first(spark, slices_of):
    got = T.attribution(T.contributions(_dimensions(slices_of), M.DEFAULT_CATALOG)).orderBy("grain_rank").collect()
    assert [r.grain for r in got][0] == "trip_direction" and [r.grain for r in got][-1] == "vendor"
    assert got[0].power > 5 * got[-1].power and got[-1].dispersion < 1e-9
    assert got[0].verdict == "rate" and got[0].leader == "LOGIN"


def test_gate_needs_either_period_and_skips_single_entities(spark, slices_of):
    rows = [
        ("ota", "global", "ALL", "2026-05-01", 0.95, 5000), ("ota", "global", "ALL", "2026-06-01", 0.93, 5000),
        ("ota", "office", "a", "2026-05-01", 0.95, 600), ("ota", "office", "a", "2026-06-01", None, 100),
        ("ota", "office", "b", "2026-05-01", 0.95, 600), ("ota", "office", "b", "2026-06-01", 0.90, 600),
        ("ota", "office", "c", "2026-05-01", None, 400), ("ota", "office", "c", "2026-06-01", None, 400),
        ("ota", "vendor", "v", "2026-05-01", 0.95, 600), ("ota", "vendor", "v", "2026-06-01", 0.95, 600),
    ]
    got = T.contributions(slices_of(rows), M.DEFAULT_CATALOG).collect()
    assert {(r.grain, r.entity) for r in got} == {("office", "a"), ("office", "b")}
    assert [r.w1 for r in got if r.entity == "a"] == [0.0]


def test_counterfactual_adds_up(spark):
    rows = spark.createDataFrame(
        [("2026-05-01", "x", 10.0, 2.0), ("2026-05-01", "y", 30.0, 3.0), ("2026-06-01", "x", 12.0, 2.0), ("2026-06-01", "y", 44.0, 4.0)], "p string, s string, num double, e double"
    ).withColumn("p", F.to_date("p"))
    got = T.counterfactual(rows, "p", "s", "num", "e").first()
    assert got.rate_effect + got.mix_effect == pytest.approx(got.rate_now - got.rate_before)
    assert got.repriced == pytest.approx((5 * 2 + 10 * 4) / 6)
