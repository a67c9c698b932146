"""Safety-alert, escort and compliance analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.functions.ordering import with_position, with_tile
from tripscope.plans.flow import Flow, FlowBook, rel
from tripscope.plans.registry import Book
from tripscope.plans.riders import TIE
from tripscope.plans.timeliness import BAND

BOOK = Book()
add = FlowBook(BOOK)
alerts, trips, legs = rel("alerts"), rel("trips"), rel("legs")
TYPES = ["click", "error", "purchase", "signup", "view"]
NIGHT = "(shift_hour >= 20 OR shift_hour <= 5)"

# Y1 counts over time, with change
for _n, _e in (("week", "week"), ("month", "cast(date_trunc('month', alert_date) as date)"), ("hour", "alert_hour")):
    add(f"Y1_events_by_{_n}", alerts.agg({"event_type": "event_type", "slot": _e}, n="count(*)").plus(prior="lag(n) OVER (PARTITION BY event_type ORDER BY slot)").cols(
        "event_type n prior", **{_n: "slot", "change": "R((n - prior) / nullif(prior, 0))"}))

# Y2 rate per 1000 trips; members without an alert stay with zero
_hits = alerts.agg("trip_id", n_alerts="count(*)", errors="NUM(event_type = 'error')")
_exposed = lambda cols: trips.cols("trip_id " + cols).join(_hits, "trip_id", "left")
_per = dict(trips="count(*)", alerts="ISUM(coalesce(n_alerts, 0))", per_1000="R(sum(coalesce(n_alerts, 0)) * 1000 / count(*))", errors_per_1000="R(sum(coalesce(errors, 0)) * 1000 / count(*))")
for _d in ("month", "business_unit", "office", "vendor_id"):
    add(f"Y2_rate_by_{_d}", _exposed(_d).agg(_d, **_per))

# Y3 acknowledgement latency: whole minutes
_ack = dict(n="count(*)", never="NUM(unacknowledged)", negative="NUM(ack_minutes < 0)", p50="R(median(ack_minutes))", p90="R(PCT(ack_minutes, 0.9))", p99="R(PCT(ack_minutes, 0.99))", longest="max(ack_minutes)", within_15="R(RATE(ack_minutes <= 15))")
for _n, _d in (("severity", {"severity": "coalesce(severity, 'none')"}), ("type", {"event_type": "event_type"}), ("total", {"scope": "'all'"})):
    add(f"Y3_latency_{_n}", alerts.agg(_d, **_ack))
add("Y3_latency_unit", alerts.cols("trip_id ack_minutes unacknowledged").join(trips.cols("trip_id business_unit"), "trip_id").agg("business_unit", **_ack))

# Y4 buckets and granularity
add("Y4_latency_buckets", alerts.agg({"bucket": "CASE WHEN ack_minutes IS NULL THEN 'never' WHEN ack_minutes <= 5 THEN 'to 5' WHEN ack_minutes <= 15 THEN 'to 15' WHEN ack_minutes <= 60 THEN 'to 60' WHEN ack_minutes <= 240 THEN 'to 240' ELSE 'longer' END"}, n="count(*)").plus(share="R(n / sum(n) OVER ())"))
add("Y4_common_values", alerts.where("ack_minutes IS NOT NULL").agg("ack_minutes", n="count(*)").plus(place="row_number() OVER (ORDER BY n DESC, ack_minutes)").where("place <= 20"))

# Y5 a cluster of closures at one latency
_cl = "ack_minutes BETWEEN 240 AND 300"
_clm = dict(n="count(*)", in_cluster=f"NUM({_cl})", share=f"R(RATE({_cl}))", p50_without=f"R(median(CASE WHEN NOT ({_cl}) THEN ack_minutes END))")
add("Y5_cluster_severity", alerts.agg({"severity": "coalesce(severity, 'none')"}, **_clm))
add("Y5_cluster_type", alerts.agg("event_type", **_clm))
add("Y5_cluster_unit_week", alerts.cols("trip_id ack_minutes week").join(trips.cols("trip_id business_unit"), "trip_id").agg("business_unit week", **_clm))

# Y6 open backlog; the data end is taken over daily totals, not over alerts
add("Y6_backlog_state", alerts.agg({"state_text": "state_text", "day": "alert_date"}, n="count(*)", kinds="LISTD(event_type)").plus(age="DAYS(max(day) OVER (), day)").agg(
    "state_text", alerts="ISUM(n)", oldest_days="max(age)", mean_age="R(sum(age * n) / sum(n))"))
add("Y6_backlog_types", alerts.where("unacknowledged").agg("state_text source", n="count(*)", kinds="LISTD(event_type)", first_day="min(alert_date)"))
add("Y6_tail", alerts.agg("alert_date", n="count(*)", open_alerts="NUM(unacknowledged)").plus(place="row_number() OVER (ORDER BY alert_date DESC)").where("place <= 7").cols("alert_date n open_alerts"))

# Y7 severity matrix
_sev = {f"s{i}": f"NUM(severity = 'Sev-{i}')" for i in (1, 2, 3)}
add("Y7_type_by_severity", alerts.agg("event_type", n="count(*)", **_sev, none="NUM(severity IS NULL)"))
add("Y7_sentinel", alerts.agg("week source severity_raw", n="count(*)").plus(share="R(n / sum(n) OVER (PARTITION BY week, source))"))

# Y8 detector coverage per unit, silent detectors included
_t8 = alerts.agg("trip_id", **{f"n_{t}": f"NUM(event_type = '{t}')" for t in TYPES})
_cov = trips.cols("trip_id business_unit office").join(_t8, "trip_id", "left")
_rates = {f"{t}_per_1000": f"R(sum(coalesce(n_{t}, 0)) * 1000 / count(*))" for t in TYPES}
add("Y8_detector_coverage", _cov.agg("business_unit", trips="count(*)", **_rates))
add("Y8_silent_detectors", _cov.agg("office", trips="count(*)", **{f"k_{t}": f"sum(coalesce(n_{t}, 0))" for t in TYPES}).cols("office trips", silent="cast(" + " + ".join(f"CASE WHEN k_{t} = 0 THEN 1 ELSE 0 END" for t in TYPES) + " as int)"))

# Y9 escort cover
add.each("Y9_escort_cover", trips.plus(band=BAND), ["band", "shift_hour", "business_unit", "month", "product_type", "trip_direction"], "actual_escort", escorted="R(RATE(actual_escort))", known="count(actual_escort)")

# Y10 who was aboard
profile = legs.where("boarded").agg("trip_id", boarded_legs="count(*)", women="NUM(gender = 'F')", last_gender=f"MAXBY(gender, planned_drop_epoch, {TIE})", first_gender=f"MINBY(gender, planned_pickup_epoch, {TIE})")
add("Y10_passenger_profile", profile)

# Y11 exposure with the male control
def exposed(cols: str) -> Flow:
    return trips.cols("trip_id actual_escort shift_hour " + cols).join(profile, "trip_id").plus(
        lone_woman="boarded_legs = 1 AND women = 1", lone_man="boarded_legs = 1 AND women = 0", woman_last="last_gender = 'F'")


_exp = dict(woman_last_n="NUM(woman_last)", woman_last_escorted="R(avg(CASE WHEN woman_last THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))", man_last_escorted="R(avg(CASE WHEN NOT woman_last THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))",
            lone_women="NUM(lone_woman)", lone_woman_escorted="R(avg(CASE WHEN lone_woman THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))", lone_man_escorted="R(avg(CASE WHEN lone_man THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))")
add.each("Y11_exposure", exposed("business_unit month office vendor_id").where(NIGHT), ["business_unit", "shift_hour", "month", "office", "vendor_id"], "actual_escort lone_woman lone_man woman_last", 1, **_exp)
add("Y11_exposure_alerted", exposed("").join(_hits, "trip_id", "left").where(NIGHT).agg({"alerted": "n_alerts IS NOT NULL"}, trips="count(*)", **_exp))

# Y12 the same share under other clock offsets
add("Y12_offset_sensitivity", exposed("business_unit").where("woman_last AND shift_hour IS NOT NULL").agg("business_unit", **{
    f"night_{n}": f"R(avg(CASE WHEN (shift_hour + {o}) % 24 >= 20 OR (shift_hour + {o}) % 24 <= 5 THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))" for n, o in (("minus_2", 22), ("minus_1", 23), ("as_is", 0), ("plus_1", 1), ("plus_2", 2))}))

# Y13 detector against ground truth
_truth = exposed("business_unit").plus(at_risk=f"coalesce({NIGHT}, false) AND (woman_last OR lone_woman)", strict=f"coalesce({NIGHT}, false) AND lone_woman").join(alerts.where("event_type = 'error'").agg("trip_id").plus(flagged="1"), "trip_id", "left")
_rp = dict(trips="count(*)", at_risk="NUM(at_risk)", flagged="NUM(flagged = 1)", both="NUM(at_risk AND flagged = 1)", recall="R(NUM(at_risk AND flagged = 1) / nullif(NUM(at_risk), 0))",
           precision_loose="R(NUM(at_risk AND flagged = 1) / nullif(NUM(flagged = 1), 0))", precision_strict="R(NUM(strict AND flagged = 1) / nullif(NUM(flagged = 1), 0))", base_rate="R(RATE(at_risk))")
_truth = _truth.cols("business_unit at_risk strict flagged")
add("Y13_recall_unit", _truth.agg("business_unit", **_rp))
add("Y13_recall_total", _truth.agg({"scope": "'all'"}, **_rp))

# Y14 where the escort policy stops
_cliff = trips.where("shift_hour IS NOT NULL").plus(duration="(planned_end_epoch - planned_start_epoch) / 60", drop_hour="(shift_hour + (planned_end_epoch - planned_start_epoch) / 3600)").cols("trip_id shift_hour duration drop_hour actual_escort business_unit")
add("Y14_cliff_by_hour", _cliff.agg("shift_hour", trips="count(*)", escorted="R(RATE(actual_escort))", duration_p50="R(PCT(duration, 0.5))", duration_p90="R(PCT(duration, 0.9))", drop_after_20="R(RATE(drop_hour >= 20))"))
add("Y14_cliff_exposure", _cliff.join(profile, "trip_id").where("last_gender = 'F'").agg({"business_unit": "business_unit", "side": "CASE WHEN shift_hour >= 20 THEN 'inside policy' WHEN drop_hour >= 20 THEN 'drops after the line' ELSE 'before the line' END"}, trips="count(*)", escorted="R(RATE(actual_escort))"))

# Y15 non-compliance by vendor
_nc = trips.cols("trip_id vendor_id business_unit is_driver_nc is_cab_nc on_time").join(_hits, "trip_id", "left")
_ncm = dict(trips="count(*)", driver_nc="R(RATE(is_driver_nc))", cab_nc="R(RATE(is_cab_nc))", on_time_rate="R(avg(on_time))", alerts_per_1000="R(sum(coalesce(n_alerts, 0)) * 1000 / count(*))")
add("Y15_compliance_vendor", _nc.agg("vendor_id", **_ncm).where("trips >= 100").plus(worst_first="row_number() OVER (ORDER BY driver_nc DESC, vendor_id)"))
add("Y15_compliance_unit_vendor", _nc.agg("business_unit vendor_id", **_ncm).where("trips >= 20"))

# Y16 concentration of alerts
add("Y16_alerts_per_trip", alerts.agg("trip_id", n="count(*)").agg("n", trips="count(*)"))
_people = alerts.where("stwid is not null").agg("stwid", n="count(*)")
add("Y16_riders_histogram", _people.agg("n", riders="count(*)").cols("n riders", share="R(n * riders / sum(n * riders) OVER ())"))


def _top_percent(df):
    tiled = with_tile(df, [F.col("n").desc(), F.col("stwid")], 100)
    return tiled.agg(F.count("*").alias("riders"), F.sum("n").alias("alerts"), F.round(F.sum(F.when(F.col("tile") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("top_share"), F.count_if(F.col("n") > 1).alias("repeat_riders"))


add("Y16_top_percent", _people.via(_top_percent, "SELECT count(*) AS riders, CAST(sum(n) AS BIGINT) AS alerts, round(sum(CASE WHEN tile = 1 THEN n ELSE 0 END) / sum(n), 6) AS top_share, count(*) FILTER (WHERE n > 1) AS repeat_riders FROM (SELECT *, ntile(100) OVER (ORDER BY n DESC, stwid) AS tile FROM ({src}))"))
_RANKS = (1, 5, 10, 50, 100)


def _at_ranks(df):
    placed = with_position(df, [], [F.col("n").desc(), F.col("stwid")])
    wide = placed.agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col("position") <= k, F.col("n"))).alias(f"k{k}") for k in _RANKS])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).alias("riders"), F.round(F.col(f"k{k}") / F.col("all"), 6).alias("share")) for k in _RANKS])))


add("Y16_cumulative_share", _people.via(_at_ranks, "SELECT r.riders, round(sum(CASE WHEN p.pos <= r.riders THEN p.n END) / sum(p.n), 6) AS share FROM (SELECT *, row_number() OVER (ORDER BY n DESC, stwid) AS pos FROM ({src})) p CROSS JOIN (SELECT unnest([1, 5, 10, 50, 100]) AS riders) r GROUP BY 1"))

# Y17 what the escort flag means
_roles = legs.agg("trip_id", escort_rows="NUM(emp_role = 'ESCORT')", rows_all="count(*)")
add("Y17_escort_flag", trips.cols("trip_id actual_escort").join(_roles, "trip_id", "left").agg("actual_escort", trips="count(*)", with_escort_row="NUM(escort_rows > 0)", mean_rows="R(avg(rows_all))", share="R(RATE(escort_rows > 0))"))
