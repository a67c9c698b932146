"""Rating analyses. A zero is "not rated": ``*_raw`` keeps it, ``*_rating`` drops it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.plans.flow import Flow, FlowBook, rel
from tripscope.plans.registry import Book

BOOK = Book()
add = FlowBook(BOOK)
fb = rel("feedback")
DIMS = ["route", "driver", "cab", "safety", "marshal"]


def rated(fb_cols: str, trip_cols: str) -> Flow:
    """Ratings beside their trip."""
    return fb.cols("trip_id " + fb_cols).join(rel("trips").cols("trip_id " + trip_cols), "trip_id")


# F1 marginals over the whole value list, values nobody gave included; one pass of conditional counts
def _marginals(df):
    wide = df.agg(*[F.count_if(F.col(f"{d}_raw") == v).alias(f"{d}_{v}") for d in DIMS for v in range(6)])
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("value"), F.col(f"{d}_{v}").alias("n")) for d in DIMS for v in range(6)])
    return wide.select(F.inline(cells)).withColumn("share", F.round(F.col("n") / F.sum("n").over(_by_dimension()), 6))


def _by_dimension():
    from pyspark.sql import Window

    return Window.partitionBy("dimension")


_marg_sql = "SELECT dimension, value, n, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, v.value, count(s.{d}_raw) AS n FROM (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS value) v LEFT JOIN ({{src}}) s ON s.{d}_raw = v.value GROUP BY 2" for d in DIMS) + ")"
add("F1_rating_marginals", fb.cols(" ".join(f"{d}_raw" for d in DIMS)).via(_marginals, _marg_sql))

# F2 zero patterns
_flags = " || ".join(f"CASE WHEN {d}_raw = 0 THEN '0' ELSE '1' END" for d in DIMS)
_count = " + ".join(f"CASE WHEN {d}_raw = 0 THEN 1 ELSE 0 END" for d in DIMS)
add("F2_zeros_per_row", fb.agg({"zeros": f"cast({_count} as int)"}, n="count(*)").plus(share="R(n / sum(n) OVER ())"))
add("F2_zero_patterns", fb.agg({"pattern": _flags}, n="count(*)").plus(share="R(n / sum(n) OVER ())"))

# F3 means with and without zeros, and the marshal zero against the escort
add("F3_zero_semantics", fb.agg("quarter", **{f"{d}_with": f"R(avg({d}_raw))" for d in DIMS}, **{f"{d}_without": f"R(avg({d}_rating))" for d in DIMS}))
add("F3_marshal_vs_escort", rated("marshal_raw", "actual_escort").agg({"escort": "actual_escort"}, n="count(*)", marshal_zero="R(RATE(marshal_raw = 0))", marshal_mean="R(avg(CASE WHEN marshal_raw > 0 THEN marshal_raw END))"))

# F4 response
_resp = rel("trips").cols("trip_id month business_unit").join(fb.agg("trip_id").plus(answered="1"), "trip_id", "left")
for _d in ("month", "business_unit"):
    add(f"F4_response_by_{_d}", _resp.agg(_d, trips="count(*)", rated_trips="NUM(answered = 1)", response="R(RATE(answered = 1))"))
add("F4_lag_by_day", fb.agg({"lag_days": "cast(IDIV(lag_minutes, 1440) as int)"}, n="count(*)", mean_rating="R(avg(route_rating))"))

# F5 means and detractors over time
_mean = dict(n="count(*)", route="R(avg(route_rating))", driver="R(avg(driver_rating))", cab="R(avg(cab_rating))", safety="R(avg(safety_rating))", detractors="R(RATE(route_rating <= 2))", rated_rows="count(avg_rating)")
add("F5_monthly", fb.agg("month", **_mean))
add("F5_weekly", fb.agg({"week": "WEEK(trip_date)"}, **_mean))

# F6 cuts with dispersion
add.each("F6_cuts", rated("route_rating", "vendor_id office product_type shift_type shift_hour"), ["vendor_id", "office", "product_type", "shift_type", "shift_hour"], "route_rating", 20,
     mean="R(avg(route_rating))", sd="R(stddev_samp(route_rating))", detractors="R(RATE(route_rating <= 2))")

# F7 by delay bucket and reason
BUCKET = "CASE WHEN delay_minutes IS NULL THEN 'unknown' WHEN delay_minutes = 0 THEN 'none' WHEN delay_minutes <= 3 THEN 'to 3' WHEN delay_minutes <= 5 THEN 'to 5' WHEN delay_minutes <= 60 THEN 'to 60' ELSE 'longer' END"
_late = rated("route_rating", "delay_minutes delay_reason").plus(bucket=BUCKET)
_rm = dict(n="count(route_rating)", mean="R(avg(route_rating))", detractors="R(RATE(route_rating <= 2))")
add("F7_by_delay_bucket", _late.agg("bucket", **_rm))
add("F7_by_bucket_reason", _late.agg("bucket delay_reason", **_rm))
add("F7_fixed_delay", _late.where("delay_minutes > 0 AND delay_minutes <= 9").agg({"minutes": "cast(delay_minutes as int)", "delay_reason": "delay_reason"}, **_rm))
add("F7_every_minute", _late.where("delay_minutes > 0").agg({"minutes": "cast(delay_minutes as int)", "delay_reason": "delay_reason"}, **_rm))

# F8 correlations
_p4 = ["route", "driver", "cab", "safety"]
add("F8_rating_correlations", fb.agg({"scope": "'all'"}, **{f"{a}_{b}": f"R(CORR({a}_rating, {b}_rating))" for i, a in enumerate(_p4) for b in _p4[i + 1:]}))
add("F8_delay_vs_rating", rated(" ".join(f"{p}_rating" for p in _p4), "delay_minutes").where("delay_minutes < 240").agg({"scope": "'all'"}, **{p: f"R(CORR(delay_minutes, {p}_rating))" for p in _p4}))

# F9 with and without an alert
_trip_alert = rel("alerts").agg("trip_id", n_alerts="count(*)", worst="min(severity)", event_type="min(event_type)")
_rider_alert = rel("alerts").where("stwid is not null").agg("stwid", rider_alerts="count(*)")
_fa = fb.cols("trip_id stwid route_rating safety_rating").join(_trip_alert, "trip_id", "left").join(_rider_alert, "stwid", "left")
_fm = dict(n="count(*)", route="R(avg(route_rating))", safety="R(avg(safety_rating))", detractors="R(RATE(safety_rating <= 2))")
add("F9_alert_groups", _fa.agg({"trip_alert": "n_alerts IS NOT NULL", "rider_alert": "rider_alerts IS NOT NULL"}, **_fm))
add("F9_by_type", _fa.where("n_alerts IS NOT NULL").agg("event_type", **_fm))
add("F9_by_severity", _fa.where("n_alerts IS NOT NULL").agg({"severity": "coalesce(worst, 'none')"}, **_fm))

# F10 rater activity
_raters = fb.where("stwid is not null").agg("stwid", n="count(*)", low="NUM(route_rating <= 2)")
add("F10_activity", _raters.agg({"answers": "least(n, 50)"}, raters="count(*)", low="ISUM(low)"))
add("F10_activity_uncut", _raters.agg({"answers": "n"}, raters="count(*)", low="ISUM(low)"))
add("F10_chronic", _raters.agg({"scope": "'all'"}, raters="count(*)", chronic="NUM(n >= 5 AND low * 2 >= n)", complaints="ISUM(low)",
    chronic_share="R(sum(CASE WHEN n >= 5 AND low * 2 >= n THEN low ELSE 0 END) / nullif(sum(low), 0))"))
add("F10_duplicates", fb.agg("trip_id stwid", copies="count(*)").agg("copies", keys="count(*)"))

# F11 answers weighted as given, and by trips
_unit_score = rated("route_rating", "business_unit").agg("business_unit", answers="count(route_rating)", score="avg(route_rating)")
_unit_trips = rel("trips").agg("business_unit", trips="count(*)")
_weigh = _unit_score.join(_unit_trips, "business_unit")
add("F11_unit_scores", _weigh.cols("business_unit answers trips", score="R(score)", response="R(answers / trips)"))
add("F11_weighted_score", _weigh.agg({"scope": "'all'"}, by_answers="R(sum(score * answers) / sum(answers))", by_trips="R(sum(score * trips) / sum(trips))"))

# F12 vendors inside a unit
add("F12_vendor_in_unit", rated("route_rating", "business_unit vendor_id").agg("business_unit vendor_id", n="count(route_rating)", mean="avg(route_rating)").plus(
    unit_mean="sum(mean * n) OVER (PARTITION BY business_unit) / sum(n) OVER (PARTITION BY business_unit)").cols("business_unit vendor_id n", mean="R(mean)", gap="R(mean - unit_mean)"))

# F13 which of the two moves more
add("F13_sensitivity", fb.agg("quarter", mean="avg(route_rating)", detractors="RATE(route_rating <= 2)").plus(m0="lag(mean) OVER (ORDER BY quarter)", d0="lag(detractors) OVER (ORDER BY quarter)").cols(
    "quarter", mean="R(mean)", detractors="R(detractors)", mean_change="R((mean - m0) / nullif(m0, 0))", detractor_change="R((detractors - d0) / nullif(d0, 0))"))

# F14 who answers
_self = rel("trips").cols("trip_id business_unit on_time delay_minutes").join(fb.agg("trip_id").plus(answered="1"), "trip_id", "left").plus(rated="answered IS NOT NULL")
_sm = dict(trips="count(*)", on_time_rate="R(avg(on_time))", late_share="R(RATE(delay_minutes > 5))")
add("F14_self_selection", _self.agg("rated", **_sm))
add("F14_self_selection_unit", _self.agg("business_unit rated", **_sm))

# F15 submission lag
LAG = "CASE WHEN lag_minutes < 60 THEN 'first hour' WHEN lag_minutes < 1440 THEN 'same day' WHEN lag_minutes < 2880 THEN 'next day' ELSE 'later' END"
add("F15_lag_percentiles", fb.agg("quarter", n="count(*)", p50="R(PCT(lag_minutes, 0.5))", p90="R(PCT(lag_minutes, 0.9))"))
add("F15_lag_bands", rated("lag_minutes route_rating", "business_unit").plus(band=LAG).agg("business_unit band", n="count(*)", mean="R(avg(route_rating))", median_lag="R(median(lag_minutes))"))
