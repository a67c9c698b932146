"""Timeliness analyses over trips.

Delay is whole minutes, so the built-in exact percentile keeps at most one entry per distinct minute and group. Windows run
over daily or per-member aggregates, whose size follows the calendar, not the number of trips.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.functions.ordering import with_tile
from tripscope.plans.cost import medians
from tripscope.plans.flow import FlowBook, rel
from tripscope.plans.registry import Book

BOOK = Book()
add = FlowBook(BOOK)
trips = rel("trips")

GATE = 50
BAND = (
    "CASE WHEN shift_hour IS NULL THEN 'none' WHEN shift_hour >= 21 OR shift_hour <= 5 THEN 'night' WHEN shift_hour <= 11 THEN 'morning' "
    "WHEN shift_hour <= 16 THEN 'day' ELSE 'evening' END"
)
END_DEV = "((actual_end_epoch - planned_end_epoch) / 60)"
START_DEV = "((actual_start_epoch - planned_start_epoch) / 60)"
PLAN_RUN = "((planned_end_epoch - planned_start_epoch) / 60)"
REAL_RUN = "((actual_end_epoch - actual_start_epoch) / 60)"
BEYOND = "(CASE WHEN delay_minutes > 5 THEN delay_minutes - 5 ELSE 0 END)"


_ALL_DIMS = ["business_unit", "office", "vendor_id", "product_type", "trip_direction", "trip_nodal", "route_source", "delay_reason", "shift_type"]
add.each("L1_rate_by_dimension", trips, _ALL_DIMS, "on_time delay_minutes", GATE, rate="R(avg(on_time))", mean_delay="R(avg(delay_minutes))", with_delay="count(delay_minutes)")

# L2 three months side by side, all years together
_m = {}
for _i, _name in ((5, "may"), (6, "jun"), (7, "jul")):
    _m |= {f"n_{_name}": f"NUM(month(month) = {_i})", f"r_{_name}": f"avg(CASE WHEN month(month) = {_i} THEN on_time END)"}
for _d in ("office", "vendor_id", "product_type"):
    add(f"L2_month_pivot_{_d}", trips.agg(_d, **_m).cols(f"{_d} n_may n_jun n_jul", r_may="R(r_may)", r_jun="R(r_jun)", r_jul="R(r_jul)",
        d_jun="R(r_jun - r_may)", d_jul="R(r_jul - r_jun)"))

# L3 minute families of the shift label
_suffix = "CASE WHEN shift_type LIKE '%:%' THEN split_part(shift_type, ':', 2) ELSE 'none' END"
add("L3_minute_family", trips.agg({"suffix": _suffix}, n="count(*)", rate="R(avg(on_time))"))
add("L3_minute_family_month", trips.agg({"suffix": _suffix, "month": "month"}, n="count(*)", rate="R(avg(on_time))"))
add("L3_without_family", trips.agg("quarter", all_rate="R(avg(on_time))", without_05="R(avg(CASE WHEN shift_type NOT LIKE '%:05' THEN on_time END))",
    only_05="R(avg(CASE WHEN shift_type LIKE '%:05' THEN on_time END))"))

# L4 daily series with trailing means
_daily = trips.agg("trip_date", n="count(*)", rate="avg(on_time)")
add("L4_daily_series", _daily.plus(
    ma7="avg(rate) OVER (ORDER BY trip_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)",
    before="avg(rate) OVER (ORDER BY trip_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)").cols(
    "trip_date n", rate="R(rate)", ma7="R(ma7)", drift="R(rate - before)"))

# L5 calendar cuts
_cal = dict(n="count(*)", rate="R(avg(on_time))")
add("L5_weekday", trips.agg({"weekday": "WEEKDAY(trip_date)"}, **_cal))
add("L5_weekend", trips.agg({"weekend": "WEEKDAY(trip_date) >= 5"}, **_cal))
add("L5_week_of_month", trips.agg({"week_of_month": "cast(ceil(dayofmonth(trip_date) / 7) as int)"}, **_cal))
add("L5_iso_week", trips.agg({"week": "WEEK(trip_date)"}, **_cal))
add("L5_same_weekday", trips.agg({"month": "month", "weekday": "WEEKDAY(trip_date)"}, **_cal))
add("L5_worst_days", _daily.plus(place="row_number() OVER (ORDER BY rate, n DESC, trip_date)").where("place <= 15").cols("trip_date n place", rate="R(rate)"))

# L6 percentile profile
_pct = {f"p{int(p * 100)}": f"R(PCT(delay_minutes, {p}))" for p in (0.5, 0.75, 0.9, 0.95, 0.99)}
_prof = dict(n="count(delay_minutes)", lowest="min(delay_minutes)", highest="max(delay_minutes)", mean="R(avg(delay_minutes))", **_pct)
add("L6_percentiles_month", trips.agg("month", **_prof))
add("L6_percentiles_product", trips.agg("quarter product_type", **_prof))
add("L6_percentiles_band", trips.agg({"quarter": "quarter", "band": BAND}, **_prof))
add("L6_percentiles_late", trips.where("delay_minutes > 0").agg("month", **_prof))

# L7 tail concentration by exact thousandths of the order by delay
def _tail(df):
    tiled = with_tile(df, [F.col("delay_minutes").desc(), F.col("trip_id")], 1000)
    worst = {f"worst_{w}": F.sum(F.when(F.col("tile") <= 10 * w, F.col("delay_minutes")).otherwise(0)) / F.nullif(F.sum("delay_minutes"), F.lit(0)) for w in (1, 5, 10)}
    return tiled.agg(F.count("*").alias("n"), F.sum("delay_minutes").alias("minutes"), *[F.round(c, 6).alias(a) for a, c in worst.items()])


_tail_sql = "SELECT count(*) AS n, sum(delay_minutes) AS minutes, " + ", ".join(
    f"round(sum(CASE WHEN tile <= {10 * w} THEN delay_minutes ELSE 0 END) / nullif(sum(delay_minutes), 0), 6) AS worst_{w}" for w in (1, 5, 10)
) + " FROM (SELECT *, ntile(1000) OVER (ORDER BY delay_minutes DESC, trip_id) AS tile FROM ({src}))"
_delayed = trips.where("delay_minutes IS NOT NULL")
add("L7_tail_all", _delayed.cols("trip_id delay_minutes").via(_tail, _tail_sql))
add("L7_tail_without_product", _delayed.where("product_type <> 'BUILDING'").cols("trip_id delay_minutes").via(_tail, _tail_sql))

# L8 fixed buckets
_edges = [("none", "delay_minutes = 0"), ("to_5", "delay_minutes > 0 AND delay_minutes <= 5"), ("to_15", "delay_minutes > 5 AND delay_minutes <= 15"),
          ("to_60", "delay_minutes > 15 AND delay_minutes <= 60"), ("over_60", "delay_minutes > 60"), ("unknown", "delay_minutes IS NULL")]
add("L8_delay_buckets", trips.agg("month", n="count(*)", **{a: f"R(RATE({c}))" for a, c in _edges}))

# L9 extreme rows against the recomputed delay
_re = trips.plus(recomputed=f"CASE WHEN {END_DEV} > 0 THEN {END_DEV} ELSE 0 END", kind="CASE WHEN delay_minutes IS NULL THEN 'missing' WHEN delay_minutes > 1440 THEN 'over a day' WHEN delay_minutes > 240 THEN 'over 4 h' WHEN delay_minutes > 5 THEN 'late' ELSE 'in time' END")
add("L9_extremes_by_class", _re.agg("kind", n="count(*)", recomputed_known="count(recomputed)", mean_gap="R(avg(abs(delay_minutes - recomputed)))"))
add("L9_extremes_total", _re.agg({"scope": "'all'"}, corr_all="R(CORR(delay_minutes, recomputed))", mean_gap="R(avg(abs(delay_minutes - recomputed)))", within_1="R(RATE(abs(delay_minutes - recomputed) <= 1))"))

# L10 minutes beyond target
_b = dict(n="count(*)", minutes=f"sum({BEYOND})", per_trip=f"R(sum({BEYOND}) / count(*))", per_rider=f"R(sum({BEYOND} * emp_actual) / nullif(sum(emp_actual), 0))", hours_lost=f"R(sum({BEYOND} * emp_actual) / 60)")
add("L10_beyond_target_month", trips.agg("month", **_b))
add("L10_beyond_target_week", trips.agg({"week": "WEEK(trip_date)"}, **_b))

# L11 start or run
_parts = trips.where("actual_end_epoch IS NOT NULL AND delay_minutes > 5").plus(start_dev=START_DEV, run_dev=f"{REAL_RUN} - {PLAN_RUN}", band=BAND)
_dec = dict(n="count(*)", start_dev="R(avg(start_dev))", run_dev="R(avg(run_dev))", start_led="R(RATE(start_dev > run_dev))", run_led="R(RATE(run_dev >= start_dev))")
add("L11_start_or_run_month", _parts.cols("month start_dev run_dev").agg("month", **_dec))
add("L11_start_or_run_band", _parts.cols("quarter band start_dev run_dev").agg("quarter band", **_dec))

# L12 duration sanity
add("L12_duration_sanity", trips.agg("month", n="count(*)", negative=f"NUM({REAL_RUN} < 0)", over_4h=f"NUM({REAL_RUN} > 240)", missing=f"NUM({REAL_RUN} IS NULL)",
    overrun_p50=f"R(PCT({REAL_RUN} - {PLAN_RUN}, 0.5))", overrun_p90=f"R(PCT({REAL_RUN} - {PLAN_RUN}, 0.9))", planned_mean=f"R(avg({PLAN_RUN}))", actual_mean=f"R(avg({REAL_RUN}))"))

# L13 distance drift
_drift = dict(planned="sum(planned_km)", traveled="sum(traveled_km)", ratio="R(sum(traveled_km) / nullif(sum(planned_km), 0))")
_km = trips.where("traveled_km >= 0 AND planned_km > 0")
add.each("L13_distance_drift", _km, ["month", "office", "vendor_id", "shift_hour"], "planned_km traveled_km", **_drift)
add("L13_ratio_percentiles", _km.cols("quarter", ratio="traveled_km / planned_km").via(*medians(["quarter"], "ratio", [0.5, 0.9])).cols("quarter n", p50="R(p50)", p90="R(p90)"))
add("L13_excess_buckets", _km.plus(x="traveled_km / planned_km").agg({"bucket": "CASE WHEN x < 0.95 THEN 'short' WHEN x <= 1.05 THEN 'as planned' WHEN x <= 1.1 THEN 'to 10 %' ELSE 'over 10 %' END"}, n="count(*)", excess_km="sum(traveled_km - planned_km)"))

# L14 occupancy
_occ = dict(fill="R(sum(emp_actual) / nullif(sum(cab_capacity), 0))", solo_share="R(RATE(emp_actual = 1))", near_empty_km="sum(CASE WHEN emp_actual <= 1 THEN planned_km ELSE 0 END)", km="sum(planned_km)")
add.each("L14_occupancy", trips, ["month", "product_type", "office", "shift_hour", "cab_capacity"], "emp_actual planned_km", **_occ)

# L15 no-show cuts
_ns = dict(noshows="ISUM(noshow)", planned="ISUM(emp_planned)", rate="R(sum(noshow) / nullif(sum(emp_planned), 0))")
add.each("L15_noshow", trips, ["month", "trip_direction", "office", "shift_hour"], "noshow emp_planned", **_ns)

# L16 effect inside a stratum
add("L16_controlled", trips.agg({"band": BAND, "trip_direction": "trip_direction", "cab_capacity": "cab_capacity", "emp_actual": "emp_actual"}, n="count(*)", rate="R(avg(on_time))",
    mean_delay="R(avg(delay_minutes))").where(f"n >= {GATE}"))

# L17 reported against recomputed
_two = dict(n="count(*)", reported="R(avg(on_time))", recomputed=f"R(RATE({END_DEV} <= 5))", gap=f"R(avg(on_time) - RATE({END_DEV} <= 5))", hidden_late=f"NUM(on_time = 1 AND {END_DEV} > 5)")
_known = trips.where("actual_end_epoch IS NOT NULL")
add("L17_reported_vs_recomputed_month", _known.agg("month", **_two))
add("L17_reported_vs_recomputed_office", _known.agg("quarter office", **_two))
add("L17_reported_vs_recomputed_week", _known.agg({"week": "WEEK(trip_date)"}, **_two))

# L18 share of trips against share of minutes
add("L18_share_of_delay", trips.agg("product_type", n="count(*)", minutes="sum(coalesce(delay_minutes, 0))").cols(
    "product_type n minutes", trip_share="R(n / sum(n) OVER ())", minute_share="R(minutes / nullif(sum(minutes) OVER (), 0))"))

# L19 planned solo or became solo
_solo = trips.where("emp_actual = 1").plus(origin="CASE WHEN emp_planned = 1 THEN 'planned solo' WHEN noshow > 0 THEN 'became solo by no-show' ELSE 'became solo otherwise' END")
add("L19_solo_origin", _solo.agg("origin", n="count(*)", km="sum(planned_km)").cols("origin n km", share="R(n / sum(n) OVER ())"))
add("L19_solo_office_month", trips.agg("office quarter", n="count(*)", solo="NUM(emp_actual = 1)").where("n >= 5").cols("office quarter n solo", excess="R(solo - 0.2 * n)"))

# L20 load against rate
_day_office = trips.agg("office trip_date", n="count(*)", rate="avg(on_time)")
add("L20_load_corr", _day_office.agg("office", days="count(*)", load_corr="R(CORR(n, rate))"))
add("L20_load_quintiles", _day_office.plus(quintile="ntile(5) OVER (PARTITION BY office ORDER BY n, trip_date)").agg({"quintile": "cast(quintile as int)"}, days="count(*)", trips="ISUM(n)", rate="R(sum(rate * n) / sum(n))"))

# L21 two weekdays
_wd = trips.where("WEEKDAY(trip_date) IN (0, 4)").plus(weekday="WEEKDAY(trip_date)", band=BAND)
for _n, _d in (("total", "weekday"), ("office", "weekday office"), ("quarter", "weekday quarter"), ("band", "weekday band")):
    add(f"L21_weekday_{_n}", _wd.cols("trip_date on_time " + _d).agg(_d, n="count(*)", rate="R(avg(on_time))", per_day="R(count(*) / count(DISTINCT trip_date))"))

_every = trips.plus(weekday="WEEKDAY(trip_date)")
for _n, _d in (("total", "weekday"), ("office", "weekday office"), ("quarter", "weekday quarter")):
    add(f"L21_every_weekday_{_n}", _every.cols("trip_date on_time " + _d).agg(_d, n="count(*)", rate="R(avg(on_time))", per_day="R(count(*) / count(DISTINCT trip_date))"))

# L22 one quarter against the rest (a week holds too few of the generated trips)
add("L22_period_deep_dive", trips.plus(band=BAND, focus="quarter = date '1998-04-01'").cols("office band focus on_time").agg("office band", n_focus="NUM(focus)", n_rest="NUM(NOT focus)",
    rate_focus="R(avg(CASE WHEN focus THEN on_time END))", rate_rest="R(avg(CASE WHEN NOT focus THEN on_time END))").where("n_focus >= 3 AND n_rest >= 20"))
_cells = trips.plus(band=BAND, week="WEEK(trip_date)").cols("week office band on_time").agg("week office band", n="count(*)", hits="sum(on_time)").plus(
    all_n="sum(n) OVER (PARTITION BY office, band)", all_hits="sum(hits) OVER (PARTITION BY office, band)")
add("L22_every_week", _cells.cols("week office band n", n_rest="cast(all_n - n as bigint)", rate="R(hits / n)", rest_rate="R((all_hits - hits) / nullif(all_n - n, 0))"))

# L23 rider-hours beyond plan
_rh = dict(n="count(*)", rider_hours=f"R(sum(greatest({END_DEV}, 0) * emp_actual) / 60)", per_rider_min=f"R(sum(greatest({END_DEV}, 0) * emp_actual) / nullif(sum(emp_actual), 0))")
add("L23_rider_hours_direction", _known.agg("month trip_direction", **_rh))
add("L23_rider_hours_by_riders", _known.agg("emp_actual", **_rh))

# L24 label swap
add("L24_reclassification_month", trips.where("delay_reason IN ('1-URGENT', '2-HIGH')").agg("delay_reason month", n="count(*)", mean_delay="R(avg(delay_minutes))"))
add("L24_reclassification_office", trips.where("delay_reason IN ('1-URGENT', '2-HIGH')").agg("delay_reason quarter office", n="count(*)"))
add("L24_every_label_month", trips.agg("delay_reason month", n="count(*)", mean_delay="R(avg(delay_minutes))"))
add("L24_every_label_office", trips.agg("delay_reason quarter office", n="count(*)"))
