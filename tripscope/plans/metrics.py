"""Metric-layer and benchmark-frame queries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.operators import benchmark, metrics as M, monthly
from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.session import ensure_checkpoint_dir, input_mark, shared_dir
from tripscope.sources import roles

BOOK = Book()

# The generated tables hold a few hundred trips a month, so sliced queries use quarters and a lower gate.
GATE = 20
MONTHS = 3
SPECS = M.regated(M.DEFAULT_CATALOG, GATE)

_TRIP_INPUTS = (
    "quarter", "on_time", "delay_minutes", "shift_type", "actual_escort", "noshow", "emp_planned", "emp_actual", "cab_capacity",
    "is_driver_nc", "is_cab_nc", "business_unit", "office", "vendor_id", "product_type", "trip_direction", "trip_nodal",
    "route_source", "actual_cab_fuel_type", "delay_reason",
)
_BILL_INPUTS = (
    "quarter", "trip_id", "trip_cost", "total_trip_km", "billing_regime", "business_unit", "office", "vendor", "contract", "slab_name",
)


def slices_for(spark: SparkSession, sf: str, specs=SPECS, grains=None) -> DataFrame:
    sources = {s.source for s in specs.values()}
    relations = {}
    if "trips" in sources:
        relations["trips"] = roles.trips(spark, sf, *_TRIP_INPUTS)
    if "bills" in sources:
        relations["bills"] = roles.bills(spark, sf, *_BILL_INPUTS)
    return M.slices(relations, specs, "quarter", grains)


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A derived table computed once per application and kept as a reliable checkpoint in the shared folder."""
    key = (spark.sparkContext.applicationId, sf, name, input_mark(spark, sf))
    if key not in _KEPT:
        ensure_checkpoint_dir(spark)
        _KEPT[key] = make().checkpoint()
    return _KEPT[key]


def observations_for(spark: SparkSession, sf: str, specs=SPECS) -> DataFrame:
    """Observations of the given metrics; those of the whole catalog feed many queries and are kept."""
    if specs is SPECS:
        return kept(spark, sf, "observations", lambda: benchmark.observe(slices_for(spark, sf), SPECS, MONTHS))
    return benchmark.observe(slices_for(spark, sf, specs), specs, MONTHS)


# --- the same layer as SQL text ------------------------------------------------------------------------------------

_FORMULA = {
    "ota": ("avg(on_time)", "count(delay_minutes)", "true"),
    "delay_p90": ("quantile_cont(delay_minutes, 0.9)", "count(delay_minutes)", "delay_minutes > 0"),
    "escort_compliance": (
        "avg(CASE WHEN coalesce(actual_escort, false) THEN 1.0 ELSE 0.0 END)", "count(actual_escort)",
        "(shift_hour >= 20 OR shift_hour <= 5)",
    ),
    "noshow_rate": ("sum(noshow) / nullif(sum(emp_planned), 0)", "count(emp_planned)", "true"),
    "occupancy": ("sum(emp_actual) / nullif(sum(cab_capacity), 0)", "count(cab_capacity)", "true"),
    "driver_noncompliance": ("avg(CASE WHEN is_driver_nc THEN 1.0 ELSE 0.0 END)", "count(is_driver_nc)", "true"),
    "cab_noncompliance": ("avg(CASE WHEN is_cab_nc THEN 1.0 ELSE 0.0 END)", "count(is_cab_nc)", "true"),
    "cost_per_km": (
        "sum(trip_cost) FILTER (WHERE trip_cost >= 0) / nullif(sum(total_trip_km) FILTER (WHERE trip_cost >= 0), 0)",
        "count(total_trip_km)", "billing_regime = 'DISTANCE_BASED'",
    ),
    "cost_per_trip": (
        "sum(trip_cost) FILTER (WHERE trip_id IS NOT NULL) / nullif(count(DISTINCT trip_id), 0)", "count(trip_cost)", "true",
    ),
}


def _slice_selects(ids) -> str:
    out = []
    for mid in ids:
        spec = M.DEFAULT_CATALOG[mid]
        formula, cover, where = _FORMULA[mid]
        for g in spec.grains:
            entity = "'ALL'" if g == "global" else f"coalesce(CAST({spec.column(g)} AS VARCHAR), 'NA')"
            out.append(
                f"SELECT '{mid}' AS metric_id, '{g}' AS grain, {entity} AS entity, quarter AS period, CAST({formula} AS DOUBLE) AS raw,"
                f" count(*) AS n, {cover} AS covered FROM {spec.source} WHERE {where} GROUP BY 3, 4"
            )
    return "\nUNION ALL\n".join(out)


def slices_cte(ids=tuple(_FORMULA)) -> str:
    return (
        f"raw_slices AS (\n{_slice_selects(ids)}),\n"
        "slices AS (SELECT metric_id, grain, entity, period, "
        f"CASE WHEN n >= {GATE} AND NOT isnan(raw) AND NOT isinf(raw) THEN raw END AS value, n, covered, "
        "CAST(covered AS DOUBLE) / n AS coverage FROM raw_slices)"
    )


def sources_of(ids) -> list[str]:
    return sorted({M.DEFAULT_CATALOG[i].source for i in ids})


def sliced_sql(body: str, ids=tuple(_FORMULA), extra: str = "") -> str:
    return with_roles(body, *sources_of(ids), extra=slices_cte(ids) + (",\n" + extra if extra else ""))


_HIGHER = "metric_id IN ('ota', 'escort_compliance', 'occupancy')"
_RATE = "metric_id NOT IN ('delay_p90', 'cost_per_km', 'cost_per_trip')"
_TARGET = "CASE metric_id WHEN 'ota' THEN 0.95 WHEN 'escort_compliance' THEN 1.0 WHEN 'cost_per_km' THEN 85.0 END"

OBSERVATIONS_CTE = f"""
measured AS (SELECT *, row_number() OVER (PARTITION BY metric_id, grain, entity ORDER BY period) AS pos,
    value - lag(value) OVER (PARTITION BY metric_id, grain, entity ORDER BY period) AS step
  FROM slices WHERE value IS NOT NULL),
tr AS (SELECT s.*, p.value AS prior, p.n AS prior_n, s.value - p.value AS delta, m.pos
  FROM slices s LEFT JOIN slices p ON p.metric_id = s.metric_id AND p.grain = s.grain AND p.entity = s.entity
    AND p.period = s.period - INTERVAL {MONTHS} MONTH
  LEFT JOIN measured m ON m.metric_id = s.metric_id AND m.grain = s.grain AND m.entity = s.entity AND m.period = s.period),
hist AS (SELECT t.metric_id, t.grain, t.entity, t.period, h.step FROM tr t JOIN measured h
    ON h.metric_id = t.metric_id AND h.grain = t.grain AND h.entity = t.entity AND h.pos BETWEEN t.pos - 10 AND t.pos - 1
  WHERE t.delta IS NOT NULL AND h.step IS NOT NULL),
hmed AS (SELECT metric_id, grain, entity, period, count(*) AS hn, median(step) AS med FROM hist GROUP BY ALL),
hmad AS (SELECT h.metric_id, h.grain, h.entity, h.period, any_value(hn) AS hn, any_value(med) AS med,
    median(abs(step - med)) AS mad, avg(abs(step - med)) AS dev
  FROM hist h JOIN hmed USING (metric_id, grain, entity, period) GROUP BY 1, 2, 3, 4),
cmed AS (SELECT metric_id, grain, period, count(*) AS cn, median(delta) AS med FROM tr WHERE delta IS NOT NULL GROUP BY ALL),
cmad AS (SELECT t.metric_id, t.grain, t.period, any_value(cn) AS cn, any_value(med) AS med,
    median(abs(delta - med)) AS mad, avg(abs(delta - med)) AS dev
  FROM tr t JOIN cmed USING (metric_id, grain, period) WHERE delta IS NOT NULL GROUP BY 1, 2, 3),
zs AS (SELECT t.metric_id, t.grain, t.entity, t.period, t.value, t.n, t.covered, t.coverage, t.prior, t.prior_n, t.delta,
    CASE WHEN t.delta IS NULL THEN NULL
      WHEN h.hn >= 3 THEN CASE WHEN h.mad > 1e-12 THEN 0.6745 * (t.delta - h.med) / h.mad
        WHEN h.dev > 1e-12 THEN (t.delta - h.med) / (1.2533 * h.dev) ELSE 0 END
      WHEN t.grain <> 'global' AND c.cn >= 5 THEN CASE WHEN c.mad > 1e-12 THEN 0.6745 * (t.delta - c.med) / c.mad
        WHEN c.dev > 1e-12 THEN (t.delta - c.med) / (1.2533 * c.dev) ELSE 0 END END AS robust_z,
    CASE WHEN t.delta IS NULL THEN NULL WHEN h.hn >= 3 THEN 'temporal' WHEN t.grain <> 'global' AND c.cn >= 5 THEN 'cohort'
      ELSE 'none' END AS z_basis
  FROM tr t LEFT JOIN hmad h USING (metric_id, grain, entity, period) LEFT JOIN cmad c USING (metric_id, grain, period)),
peers AS (SELECT metric_id, grain, period, count(*) AS peer_size, median(value) AS peer_median FROM slices
  WHERE value IS NOT NULL AND grain <> 'global' GROUP BY ALL HAVING count(*) >= 2),
places AS (SELECT metric_id, grain, entity, period, row_number() OVER (PARTITION BY metric_id, grain, period
    ORDER BY CASE WHEN {_HIGHER} THEN -value ELSE value END, entity) AS peer_rank FROM slices
  WHERE value IS NOT NULL AND grain <> 'global'),
framed AS (SELECT z.*, {_TARGET.replace("metric_id", "z.metric_id")} AS sla_target,
    CASE WHEN z.metric_id = 'cost_per_km' THEN z.value - 85.0 WHEN z.metric_id = 'ota' THEN 0.95 - z.value
      WHEN z.metric_id = 'escort_compliance' THEN 1.0 - z.value END AS sla_gap,
    p.peer_median, CAST(CASE WHEN p.peer_size IS NOT NULL THEN r.peer_rank END AS INTEGER) AS peer_rank, p.peer_size,
    CASE WHEN p.peer_size IS NOT NULL AND r.peer_rank IS NOT NULL
      THEN CAST(p.peer_size - r.peer_rank AS DOUBLE) / (p.peer_size - 1) * 100 END AS peer_percentile,
    CASE z.metric_id WHEN 'ota' THEN 0.93 WHEN 'noshow_rate' THEN 0.06 END AS industry
  FROM zs z LEFT JOIN peers p USING (metric_id, grain, period) LEFT JOIN places r USING (metric_id, grain, entity, period)),
obs AS (SELECT *, coalesce(sla_gap > 0, false) AS sla_breached,
    CASE WHEN value IS NULL THEN 0 ELSE least(1, greatest(0,
      1 - (1 - CASE WHEN robust_z IS NULL THEN 0 ELSE least(abs(robust_z) / 3, 1)
             * CASE WHEN (CASE WHEN {_HIGHER} THEN delta < 0 ELSE delta > 0 END) THEN 1 ELSE 0.35 END END)
        * (1 - CASE WHEN sla_gap > 0 AND metric_id <> 'escort_compliance'
             THEN least(sla_gap / sla_target / 0.05, 1) ELSE 0 END))) END AS severity,
    CASE WHEN value IS NULL AND n < {GATE} THEN 'insufficient_sample' WHEN value IS NULL THEN 'not_computable'
      WHEN coverage >= 0.98 AND n >= {GATE * 4} THEN 'HIGH' WHEN coverage >= 0.90 THEN 'MEDIUM' ELSE 'LOW' END AS confidence
  FROM framed)"""


def observed_sql(body: str, ids=tuple(_FORMULA), extra: str = "") -> str:
    return sliced_sql(body, ids, OBSERVATIONS_CTE.strip() + (",\n" + extra if extra else ""))


def r(c: str, places: int = 6) -> str:
    return f"round(CAST({c} AS DOUBLE), {places}) AS {c.split('.')[-1]}"


SLICE_COLUMNS = f"metric_id, grain, entity, period, {r('value')}, n, covered, {r('coverage')}"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in cols})


# --- metric layer --------------------------------------------------------------------------------------------------

BOOK.add(
    "M12_all_slices",
    lambda spark, sf: rounded(slices_for(spark, sf), "value", "coverage"),
    sliced_sql(f"SELECT {SLICE_COLUMNS} FROM slices"),
)

for _i, _mid in enumerate(_FORMULA):

    def _one(spark, sf, mid=_mid):
        return rounded(slices_for(spark, sf, {mid: SPECS[mid]}), "value", "coverage").drop("metric_id")

    BOOK.add(
        f"M{13 + _i}_{_mid}",
        _one,
        sliced_sql(f"SELECT grain, entity, period, {r('value')}, n, covered, {r('coverage')} FROM slices", (_mid,)),
    )



def merged_quarters(spark: SparkSession, sf: str) -> DataFrame:
    """All slices by quarter, added up from the mergeable state of single months."""
    out = None
    for source, relation in (("trips", roles.trips(spark, sf, "month", *_TRIP_INPUTS[1:])), ("bills", roles.bills(spark, sf, "month", *_BILL_INPUTS[1:]))):
        specs = [s for s in SPECS.values() if s.source == source]
        part = monthly.merged(monthly.partials(relation, specs), specs, F.trunc("month", "QUARTER"))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "value", "coverage")


BOOK.add("M12_merged_from_months", merged_quarters, sliced_sql(f"SELECT {SLICE_COLUMNS} FROM slices"))


def loaded_slices(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of a catalog that is written out as definition files and loaded from there."""
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    texts = [(s.id, json.dumps(M.spec_to_dict(s))) for s in SPECS.values()]
    spark.createDataFrame(texts, "metric string, value string").write.partitionBy("metric").text(path)  # a file for each
    return rounded(slices_for(spark, sf, M.load_catalog(spark, path)), "value", "coverage")


BOOK.add("S6_loaded_catalog", loaded_slices, sliced_sql(f"SELECT {SLICE_COLUMNS} FROM slices"))


def production_slices(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog as it is: its own gates, targets and months."""
    relations = {"trips": roles.trips(spark, sf, "month", *_TRIP_INPUTS[1:]), "bills": roles.bills(spark, sf, "month", *_BILL_INPUTS[1:])}
    return rounded(M.slices(relations, M.DEFAULT_CATALOG, "month"), "value", "coverage")


_GATES = "CASE metric_id " + " ".join(f"WHEN '{k}' THEN {s.min_sample}" for k, s in M.DEFAULT_CATALOG.items()) + " END"
BOOK.add(
    "M12_production_gates", production_slices,
    sliced_sql(f"SELECT {SLICE_COLUMNS} FROM slices").replace("quarter AS period", "month AS period").replace(f"n >= {GATE}", f"n >= {_GATES}"),
)

_ONE = ("ota", "cost_per_trip")


def _two(spark, sf):
    return slices_for(spark, sf, {k: SPECS[k] for k in _ONE})


BOOK.add(
    "M1_gated_slices",
    lambda spark, sf: _two(spark, sf).filter("value is null").select("metric_id", "grain", "entity", "period", "n"),
    sliced_sql("SELECT metric_id, grain, entity, period, n FROM slices WHERE value IS NULL", _ONE),
)
BOOK.add(
    "M2_overall",
    lambda spark, sf: rounded(M.overall(slices_for(spark, sf, grains=[M.GLOBAL])).select("metric_id", "period", "value", "n"), "value"),
    sliced_sql(f"SELECT metric_id, period, {r('value')}, n FROM slices WHERE grain = 'global'"),
)
BOOK.add(
    "M3_history",
    lambda spark, sf: M.history(_two(spark, sf), 4).select(
        "metric_id", "grain", "entity", "period", F.size("history").alias("points"),
        F.round(F.element_at("history", 1), 6).alias("oldest"),
        F.round(F.aggregate("history", F.lit(0.0), lambda a, x: a + x), 4).alias("total"),
    ),
    sliced_sql(
        """SELECT metric_id, grain, entity, period, CAST(count(*) OVER w AS INTEGER) AS points,
  round(first_value(value) OVER w, 6) AS oldest, round(sum(value) OVER w, 4) AS total
FROM slices WHERE value IS NOT NULL
WINDOW w AS (PARTITION BY metric_id, grain, entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
        _ONE,
    ),
)
BOOK.add(
    "M4_series",
    lambda spark, sf: rounded(M.series(_two(spark, sf)), "value"),
    sliced_sql(f"SELECT metric_id, grain, entity, period, {r('value')}, n FROM slices WHERE value IS NOT NULL", _ONE),
)


def _measure(spark, sf):
    s = slices_for(spark, sf, {"ota": SPECS["ota"]})
    unit_periods = s.filter("grain = 'business_unit'").select("metric_id", "grain", "entity", F.add_months("period", 3).alias("period"))
    unknown = s.filter("grain = 'global'").select("metric_id", F.lit("no_such_grain").alias("grain"), "entity", "period")
    return rounded(M.measure(s, unit_periods.unionByName(unknown)), "value", "coverage")


BOOK.add(
    "M5_measure",
    _measure,
    sliced_sql(
        f"""SELECT a.metric_id, a.grain, a.entity, a.period, round(s.value, 6) AS value, coalesce(s.n, 0) AS n,
  round(coalesce(s.coverage, 0), 6) AS coverage
FROM (SELECT metric_id, grain, entity, CAST(period + INTERVAL 3 MONTH AS DATE) AS period FROM slices WHERE grain = 'business_unit'
      UNION ALL SELECT metric_id, 'no_such_grain', entity, period FROM slices WHERE grain = 'global') a
LEFT JOIN slices s ON s.metric_id = a.metric_id AND s.grain = a.grain AND s.entity = a.entity AND s.period = a.period""",
        ("ota",),
    ),
)
BOOK.add(
    "M6_observation_quality",
    lambda spark, sf: _two(spark, sf)
    .withColumns(M.quality(SPECS))
    .select("metric_id", "grain", "entity", "period", "n", "confidence", F.size("caveats").alias("n_caveats"), F.concat_ws("; ", "caveats").alias("caveats")),
    sliced_sql(
        f"""SELECT metric_id, grain, entity, period, n, confidence,
  CAST((c1 IS NOT NULL)::INT + (c2 IS NOT NULL)::INT + (c3 IS NOT NULL)::INT + (c4 IS NOT NULL)::INT AS INTEGER) AS n_caveats,
  concat_ws('; ', c1, c2, c3, c4) AS caveats
FROM (SELECT *, CASE WHEN value IS NULL AND n < {GATE} THEN 'insufficient_sample' WHEN value IS NULL THEN 'not_computable'
      WHEN coverage >= 0.98 AND n >= {GATE * 4} THEN 'HIGH' WHEN coverage >= 0.90 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
    CASE WHEN value IS NULL AND n < {GATE} THEN n || ' rows are below the {GATE}-row gate; no value is given' END AS c1,
    CASE WHEN value IS NULL AND n >= {GATE} THEN n || ' rows matched but the denominator is empty or zero' END AS c2,
    CASE WHEN value IS NOT NULL AND coverage < 0.98 THEN (n - covered) || ' of ' || n || ' rows carry no usable value' END AS c3,
    CASE WHEN value IS NOT NULL AND n < {GATE * 2} THEN n || ' rows only just clear the {GATE}-row gate' END AS c4
  FROM slices)""",
        _ONE,
    ),
)
BOOK.add(
    "M7_volume_gate",
    lambda spark, sf: slices_for(spark, sf).groupBy("metric_id", "grain").agg(
        F.count("*").alias("n_slices"), F.count_if(F.col("n") < GATE).alias("gated"), F.count_if(F.col("value").isNotNull()).alias("measured")
    ),
    sliced_sql(
        f"SELECT metric_id, grain, count(*) AS n_slices, count(*) FILTER (WHERE n < {GATE}) AS gated, count(value) AS measured FROM slices GROUP BY 1, 2"
    ),
)


def _guard(spark, sf):
    guarded = slices_for(spark, sf, {"cost_per_km": SPECS["cost_per_km"]})
    rows = roles.bills(spark, sf, "quarter", "billing_regime").groupBy(F.col("quarter").alias("period")).agg(
        F.count("*").alias("all_lines"), F.count_if(F.col("billing_regime") == "DISTANCE_BASED").alias("guarded_lines")
    )
    return M.overall(guarded).select("period", "n").join(rows, "period")


BOOK.add(
    "M8_segment_guard",
    _guard,
    sliced_sql(
        """SELECT s.period, s.n, b.all_lines, b.guarded_lines FROM slices s JOIN (SELECT quarter AS period, count(*) AS all_lines,
  count(*) FILTER (WHERE billing_regime = 'DISTANCE_BASED') AS guarded_lines FROM bills GROUP BY 1) b USING (period)
WHERE grain = 'global'""",
        ("cost_per_km",),
    ),
)
BOOK.add(
    "M9_null_entity",
    lambda spark, sf: slices_for(spark, sf, {"cost_per_trip": SPECS["cost_per_trip"]})
    .filter("grain = 'slab_name' and entity = 'NA'")
    .select("period", "n", F.round("value", 4).alias("value")),
    with_roles(
        f"SELECT quarter AS period, count(*) AS n, round(CASE WHEN count(*) >= {GATE} THEN {_FORMULA['cost_per_trip'][0]} END, 4) AS value"
        " FROM bills WHERE slab_name IS NULL GROUP BY 1",
        "bills",
    ),
)
BOOK.add(
    "M10_periods",
    lambda spark, sf: M.periods(slices_for(spark, sf)),
    sliced_sql(
        "SELECT metric_id, count(*) AS n_periods, min(period) AS first_period, max(period) AS latest_period FROM slices"
        " WHERE grain = 'global' GROUP BY 1"
    ),
)
BOOK.add(
    "M11_period_algebra",
    lambda spark, sf: roles.trips(spark, sf, "trip_date")
    .select(F.explode(F.array(F.date_format("trip_date", "yyyy-MM"), F.col("trip_date").cast("string"), F.concat(F.lit("Q"), F.col("trip_date").cast("string")))).alias("label"))
    .groupBy("label")
    .agg(F.count("*").alias("n"))
    .withColumn("period", M.parse_period(F.col("label")))
    .withColumn("prior_period", M.previous(F.col("period"))),
    with_roles(
        """SELECT label, count(*) AS n, CAST(CASE WHEN label LIKE 'Q%' THEN NULL ELSE date_trunc('month', CAST(substr(label || '-01', 1, 10) AS DATE)) END AS DATE) AS period,
  CAST(CASE WHEN label LIKE 'Q%' THEN NULL ELSE date_trunc('month', CAST(substr(label || '-01', 1, 10) AS DATE)) - INTERVAL 1 MONTH END AS DATE) AS prior_period
FROM (SELECT strftime(trip_date, '%Y-%m') AS label FROM trips UNION ALL SELECT CAST(trip_date AS VARCHAR) FROM trips
      UNION ALL SELECT 'Q' || CAST(trip_date AS VARCHAR) FROM trips) GROUP BY label""",
        "trips",
    ),
)

# --- benchmark frames ----------------------------------------------------------------------------------------------

KEYS = ["metric_id", "grain", "entity", "period"]
KEYS_SQL = "metric_id, grain, entity, period"


def _obs(name: str, cols: list[str], floats: list[str], where: str = "true", ids=None) -> None:
    specs = SPECS if ids is None else {k: SPECS[k] for k in ids}
    BOOK.add(
        name,
        lambda spark, sf: rounded(observations_for(spark, sf, specs).filter(where), *floats).select(*KEYS, *cols),
        observed_sql(
            f"SELECT {KEYS_SQL}, {', '.join(r(c) if c in floats else c for c in cols)} FROM obs WHERE {where}",
            tuple(_FORMULA) if ids is None else ids,
        ),
    )


_obs("B1_trend", ["value", "prior", "delta"], ["value", "prior", "delta"], ids=("ota", "noshow_rate", "cost_per_km"))
_obs("B2_temporal_z", ["delta", "robust_z"], ["delta", "robust_z"], "z_basis = 'temporal'", ids=("ota", "occupancy"))
_obs("B3_cohort_z", ["delta", "robust_z"], ["delta", "robust_z"], "z_basis = 'cohort'")
_obs("B4_sla_frame", ["value", "sla_target", "sla_gap", "sla_breached"], ["value", "sla_target", "sla_gap"], "sla_target is not null")
_obs("B5_peer_frame", ["value", "peer_median", "peer_rank", "peer_size", "peer_percentile"], ["value", "peer_median", "peer_percentile"], ids=("ota", "delay_p90", "cost_per_trip"))
_obs("B6_industry_frame", ["value", "industry"], ["value", "industry"], "industry is not null")
_obs("B7_severity", ["value", "severity"], ["value", "severity"])
_obs(
    "B8_observe_all",
    ["value", "n", "coverage", "prior", "delta", "robust_z", "z_basis", "sla_target", "sla_gap", "sla_breached", "peer_median",
     "peer_rank", "peer_size", "peer_percentile", "industry", "severity", "confidence"],
    ["value", "coverage", "prior", "delta", "robust_z", "sla_target", "sla_gap", "peer_median", "peer_percentile", "industry", "severity"],
)
BOOK.add(
    "B9_recheck",
    lambda spark, sf: rounded(benchmark.recheck_latest(observations_for(spark, sf)), "value", "severity").select(
        *KEYS, "value", "n", "sla_breached", "severity"
    ),
    observed_sql(
        f"SELECT {KEYS_SQL}, {r('value')}, n, sla_breached, {r('severity')} FROM obs o WHERE value IS NOT NULL AND period ="
        " (SELECT max(period) FROM slices s WHERE s.metric_id = o.metric_id AND s.grain = 'global')"
    ),
)


def _flagship(spark, sf):
    one = {"ota": SPECS["ota"]}
    obs = benchmark.observe(slices_for(spark, sf, one, ["business_unit"]), one, MONTHS)
    return rounded(benchmark.with_band(obs), "value", "coverage", "prior", "delta").select(
        "entity", "period", "n", "value", "coverage", "prior", "delta", "band"
    )


BOOK.add(
    "flagship_on_time_by_unit",
    _flagship,
    observed_sql(
        f"""SELECT entity, period, n, {r('value')}, {r('coverage')}, {r('prior')}, {r('delta')},
  CASE WHEN coalesce(sla_gap, 0) <= 0 THEN 'NONE' WHEN sla_gap / 0.95 < 0.02 THEN 'MINOR' WHEN sla_gap / 0.95 < 0.05 THEN 'MAJOR'
    ELSE 'CRITICAL' END AS band
FROM obs WHERE grain = 'business_unit'""",
        ("ota",),
    ),
)
