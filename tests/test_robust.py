import math

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.functions import robust


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


@pytest.mark.parametrize("xs,want", [((3, 1, 2), 2.0), ((4, 1, 3, 2), 2.5), ((), None), ((1, float("nan"), 3, float("inf")), 2.0)])
def test_median(spark, xs, want):
    assert one(spark, robust.array_median(arr(*xs))) == want


@pytest.mark.parametrize("xs,want", [((1, 2, 3, 4, 5), 1.0), ((4, 4, 4, 4), 0.0)])
def test_mad(spark, xs, want):
    assert one(spark, robust.array_mad(arr(*xs))) == want


def test_robust_z_goldens(spark):
    z = robust.robust_z(F.lit(5.0), F.lit(3.0), F.lit(1.0))
    assert one(spark, z) == pytest.approx(1.349)
    assert one(spark, robust.robust_z(F.lit(5.0), F.lit(3.0), F.lit(0.0))) == 0.0
    assert one(spark, robust.array_robust_z(F.lit(4.0), arr(4, 4, 4))) == 0.0
    assert one(spark, robust.array_robust_z(F.lit(4.0), arr())) == 0.0


def test_mean_deviation_stands_in_for_a_zero_mad(spark):
    # Median and MAD 1 and 0; mean absolute deviation 9/5.
    got = one(spark, robust.array_robust_z(F.lit(10.0), arr(1, 1, 1, 1, 10)))
    assert got == pytest.approx(9 / (1.2533 * 1.8))


def test_window_form_agrees_with_array_form(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 3, 50)] + [("b", 7.0)] * 4, "g string, x double")
    whole = df.groupBy("g").agg(F.collect_list("x").alias("xs"))
    rows = robust.with_cohort_z(df, "x", W.partitionBy("g"), "zw").join(whole, "g").withColumn("za", robust.array_robust_z(F.col("x"), F.col("xs"))).collect()
    assert len(rows) == 9
    for r in rows:
        assert r.zw == pytest.approx(r.za)


def test_ewma(spark):
    assert one(spark, robust.ewma(arr(1, 2, 3), 0.5)) == pytest.approx(2.25)
    assert math.isnan(one(spark, robust.ewma(arr(), 0.5)))
