"""Totals of cells add up to what grouping every row once for each grain gives."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tripscope.operators import metrics as M
from tripscope.sources import roles
from tests.test_monthly import bills, trips

BILLS = [replace(s, min_sample=3) for s in M.DEFAULT_CATALOG.values() if s.source == "bills"]
DELAY = [replace(M.DEFAULT_CATALOG[k], min_sample=3) for k in ("ota", "delay_p90", "noshow_rate")]


def raw(wide, specs):
    return sorted(((*r[:4], None if r.raw is None else round(r.raw, 9), r.n, r.covered) for r in M._stacked(wide, specs).collect()), key=str)


@pytest.mark.parametrize("cells", [0, 6, 256])
def test_cells_add_up_to_grouped_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(M, "CELLS", cells)
    for df, specs in ((bills(spark, [4, 5, 6]), BILLS), (trips(spark, [4, 5, 6]), DELAY)):
        column_of = M.grain_columns(specs)
        rows, flag = M.grained_rows(df, specs, "month", column_of)
        keys = [f"g_{g}" for g in column_of]
        want = raw(M._direct(rows, specs, flag, keys), specs)
        assert want and raw(M._added(rows, specs, flag, keys), specs) == want


def test_grains_of_few_entities_are_totalled_together(spark):
    rows, _ = M.grained_rows(trips(spark, [4, 5]), DELAY, "month", M.grain_columns(DELAY))
    keys = [f"g_{g}" for g in M.grain_columns(DELAY)]
    bins = M.binned(rows, keys)
    assert sorted(k for b in bins for k in b) == sorted(keys) and len(bins) <= len(keys) // 3
    wide = rows.withColumn(keys[0], F.monotonically_increasing_id().cast("string"))
    assert [keys[0]] in M.binned(wide, keys)  # a grain of many entities stays alone


def test_formulas_that_do_not_add_up_are_grouped_by_row(spark):
    ota = DELAY[0]
    assert M.adds_up(ota) and all(M.adds_up(s) for s in M.DEFAULT_CATALOG.values())
    for formula in ("percentile(delay_minutes, 0.5){f}", "count(DISTINCT on_time){f}", "sum(on_time) / max(noshow){f}", "max(on_time){f}", "sum(on_time)"):
        assert not M.adds_up(replace(ota, formula=formula))
    specs = {"ota": ota, "most": replace(ota, id="most", formula="max(delay_minutes){f} + sum(on_time){f}")}
    df = trips(spark, [4, 5])
    got = {r.period: r.value for r in M.slices({"trips": df}, specs, "month").filter("metric_id = 'most' and grain = 'global'").collect()}
    assert got == {r.month: r.v for r in df.groupBy("month").agg(F.expr("cast(max(delay_minutes) + sum(on_time) as double) AS v")).collect()}


def test_named_remainders_are_spelled_as_before(spark):
    keys = spark.createDataFrame([(k,) for k in (None, -48, -1, 0, 1, 9, 10, 22, 23, 24, 25, 10**12)], "k bigint")
    got = keys.select(F.expr(roles._vendor("k")), F.expr("concat('V', lpad(cast(k % 23 as string), 2, '0'))"), F.expr(roles._numbered("k", 25, "concat('NATION_', k % 25)", "NATION_{}".format)), F.expr("concat('NATION_', k % 25)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got) and sum(r[0] is None for r in got) == 1
