"""Monthly state adds up to the slices of the whole, and a refresh reads only what changed."""

import datetime as dt
import random
import shutil
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripscope.operators import metrics as M
from tripscope.operators import monthly

SPECS = [replace(s, min_sample=3) for s in M.DEFAULT_CATALOG.values() if s.source == "bills"]
DELAY = [replace(M.DEFAULT_CATALOG[k], min_sample=3) for k in ("ota", "delay_p90", "noshow_rate")]


def bills(spark, months, seed=1, n=120):
    rng = random.Random(seed)
    rows = [
        (dt.date(2026, m, 1), rng.choice([None, *range(40)]), rng.randint(-20, 400) / 4, rng.choice([None, 0.0, rng.randint(1, 99) / 4]), rng.choice(["DISTANCE_BASED", "FIXED_RATE"]), rng.choice("UV"),
         rng.choice(["O1", "O2", None]), rng.choice(["v1", "v2", "v3"]), rng.choice(["c1", "c2"]), rng.choice(["s1", None]))
        for m in months for _ in range(n)
    ]
    return spark.createDataFrame(rows, "month date, trip_id bigint, trip_cost double, total_trip_km double, billing_regime string, business_unit string, office string, vendor string, contract string, slab_name string")


def trips(spark, months, n=150):
    rng = random.Random(5)
    pick = lambda: rng.choice(["a", "b", None])
    rows = [(dt.date(2026, m, 1), rng.choice([None, 0.0, 3.0, 9.0, 30.0, 41.0]), rng.randint(0, 1), rng.randint(1, 4), rng.randint(0, 1), *[pick() for _ in range(9)], pick()) for m in months for _ in range(n)]
    cols = "business_unit office vendor_id product_type trip_direction shift_type trip_nodal route_source delay_reason actual_cab_fuel_type".split()
    return spark.createDataFrame(rows, "month date, delay_minutes double, on_time int, emp_planned int, noshow int, " + ", ".join(f"{c} string" for c in cols))


def table(df):
    return sorted((r.metric_id, r.grain, r.entity, r.period, None if r.value is None else round(r.value, 9), r.n, r.covered, round(r.coverage, 9)) for r in df.collect())


@pytest.mark.parametrize("period", ["month", "quarter"])
def test_state_adds_up_to_the_slices(spark, period):
    for df, specs in ((bills(spark, [4, 5, 6, 7]), SPECS), (trips(spark, [4, 5, 6, 7]), DELAY)):
        df = df.withColumn("quarter", F.trunc("month", "QUARTER"))
        want = table(M.slices({specs[0].source: df}, {s.id: s for s in specs}, period))
        assert want and table(monthly.merged(monthly.partials(df, specs), specs, F.trunc("month", "QUARTER") if period == "quarter" else None)) == want


def test_a_new_month_is_read_and_old_ones_are_not(spark, tmp_path):
    source, store = str(tmp_path / "bills"), str(tmp_path / "state")
    bills(spark, [4, 5]).write.partitionBy("month").parquet(source)
    assert monthly.refresh(spark, source, store, SPECS) == ["2026-04-01", "2026-05-01"]
    assert monthly.refresh(spark, source, store, SPECS) == []
    bills(spark, [6], 2).write.mode("append").partitionBy("month").parquet(source)
    # What stands in the old months' files no longer matters: they are damaged, with name, size and time as they were.
    import os

    for month in ("2026-04-01", "2026-05-01"):
        for f in (tmp_path / "bills" / f"month={month}").glob("*.parquet"):
            was = f.stat()
            f.write_bytes(b"\0" * was.st_size)
            os.utime(f, ns=(was.st_atime_ns, was.st_mtime_ns))
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert monthly.refresh(spark, source, store, SPECS) == ["2026-06-01"]
    whole = bills(spark, [4, 5]).unionByName(bills(spark, [6], 2))
    want = table(M.slices({"bills": whole}, {s.id: s for s in SPECS}, "month"))
    assert table(monthly.merged(monthly.stored(spark, source, store, SPECS), SPECS)) == want


def test_changed_and_dropped_months_and_definitions(spark, tmp_path):
    source, store = str(tmp_path / "bills"), str(tmp_path / "state")
    bills(spark, [4, 5, 6]).write.partitionBy("month").parquet(source)
    monthly.refresh(spark, source, store, SPECS)
    shutil.rmtree(tmp_path / "bills" / "month=2026-04-01")
    shutil.rmtree(tmp_path / "bills" / "month=2026-05-01")
    # The new May has no trip ids, so nothing overwrites its old bitmaps.
    bills(spark, [5], 9).withColumn("trip_id", F.lit(None).cast("bigint")).write.mode("append").partitionBy("month").parquet(source)
    assert monthly.refresh(spark, source, store, SPECS) == ["2026-05-01"]
    now = spark.read.parquet(source)
    assert table(monthly.merged(monthly.stored(spark, source, store, SPECS), SPECS)) == table(M.slices({"bills": now}, {s.id: s for s in SPECS}, "month"))
    other = [replace(s, min_sample=10) for s in SPECS]
    assert monthly.refresh(spark, source, store, other) == ["2026-05-01", "2026-06-01"]


def test_formulas_that_do_not_add_up_are_refused():
    spec = replace(M.DEFAULT_CATALOG["ota"], formula="percentile(delay_minutes, 0.5){f}")
    with pytest.raises(ValueError, match="does not add up"):
        monthly.decomposed(spec, spec.formula, "v")


def test_distinct_counts_with_many_entities_and_a_hot_id(spark, monkeypatch):
    """Grains past the bitmap bound take their own pass; an id with a third of all rows counts once per entity."""
    df = bills(spark, [4, 5], n=300).withColumn("trip_id", F.when(F.rand(3) < 0.34, F.lit(7)).otherwise(F.col("trip_id")))
    df = df.withColumn("contract", F.concat(F.lit("c"), F.monotonically_increasing_id() % 150)).checkpoint()
    specs = {s.id: s for s in SPECS if s.distinct}
    want = {}
    for g in SPECS[-1].grains:
        e = F.lit("ALL") if g == "global" else F.coalesce(F.col(g), F.lit("NA"))
        for r in df.groupBy("month", e.alias("e")).agg(F.expr("round(sum(trip_cost) FILTER (WHERE trip_id IS NOT NULL) / nullif(count(DISTINCT trip_id), 0), 6) AS v"), F.count("*").alias("n")).collect():
            want[g, r.e, r.month] = r.v if r.n >= 3 else None
    for limit in (1024, 2, 0):
        monkeypatch.setattr(M, "MAX_ENTITIES", limit)
        got = {(r.grain, r.entity, r.period): None if r.value is None else round(r.value, 6) for r in M.slices({"bills": df}, specs, "month").collect()}
        assert got == want
