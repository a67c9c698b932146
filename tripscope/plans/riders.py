"""Rider-leg analyses.

A trip or a rider may hold a large part of all legs, so per-trip and per-rider facts are aggregates (combined map-side);
positions inside a trip come from range partitioning, never from one task per trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.functions.ordering import with_position, with_tile
from tripscope.plans.flow import Flow, FlowBook, rel
from tripscope.plans.registry import Book

BOOK = Book()
add = FlowBook(BOOK)
legs = rel("legs")

LATE = "late_minutes > 5"
DROP_DEV = "((actual_drop_epoch - planned_drop_epoch) / 60)"
IN_CAB = "((actual_drop_epoch - actual_pickup_epoch) / 60)"
PLAN_CAB = "((planned_drop_epoch - planned_pickup_epoch) / 60)"
TIE = "rider_ref, leg_ref, leg_amount"


def with_trip(leg_cols: str, trip_cols: str, where: str = "true") -> Flow:
    """Legs beside their trip."""
    return legs.where(where).cols("trip_id " + leg_cols).join(rel("trips").cols("trip_id " + trip_cols), "trip_id")


# E1 null combinations and value distributions
add("E1_null_matrix", legs.agg({"no_rider": "stwid IS NULL", "no_reason": "not_boarding_reason IS NULL", "no_pickup": "actual_pickup_epoch IS NULL", "no_drop": "actual_drop_epoch IS NULL"}, n="count(*)").plus(share="R(n / sum(n) OVER ())"))
add.each("E1_value_distribution", legs, ["signintype", "gender", "emp_role", "boarding_status", "not_boarding_reason"], "", share_boarded="R(RATE(boarding_status = 'Boarded'))")

# E2 no-show by dimension and month
_ns = dict(noshows="NUM(is_no_show)", rate="R(RATE(is_no_show))")
add.each("E2_noshow_by_dimension", legs, ["gender", "signintype", "emp_role", "month"], "is_no_show", 1, **_ns)
add("E2_noshow_three_months", legs.agg("signintype", **{f"r_{a}": f"R(avg(CASE WHEN month(month) = {i} THEN CASE WHEN is_no_show THEN 1 ELSE 0 END END))" for i, a in ((5, "may"), (6, "jun"), (7, "jul"))}))
add("E2_noshow_unit_month", with_trip("is_no_show", "business_unit quarter").agg("business_unit quarter", n="count(*)", **_ns))

# E3 reasons
_miss = legs.where("NOT boarded").plus(reason="coalesce(not_boarding_reason, 'none given')")
add("E3_reason_month", _miss.agg("month reason", n="count(*)").cols("month reason n", share="R(n / sum(n) OVER (PARTITION BY month))"))
add("E3_reason_signin", _miss.agg("signintype reason", n="count(*)").cols("signintype reason n", share="R(n / sum(n) OVER (PARTITION BY signintype))"))

# E4 whole trip or single riders
_trip_hit = legs.agg("trip_id", n_legs="count(*)", missed="NUM(NOT boarded)")
add("E4_whole_trip_or_rider", _trip_hit.agg({"extent": "CASE WHEN missed = 0 THEN 'none' WHEN missed = n_legs THEN 'all' ELSE 'some' END"}, trips="count(*)", legs="ISUM(n_legs)", missed_legs="ISUM(missed)"))
_reason_trip = _miss.agg("trip_id reason", hit="count(*)").join(legs.agg("trip_id", n_legs="count(*)"), "trip_id")
add("E4_reason_extent", _reason_trip.agg("reason", trips="count(*)", whole_trip="NUM(hit = n_legs)", share_whole="R(RATE(hit = n_legs))"))

# E5 same-day follow-on
_rode = legs.where("boarded AND stwid IS NOT NULL").agg("stwid trip_date").plus(rode="1")
add("E5_same_day_follow_on", _miss.where("stwid IS NOT NULL").cols("stwid trip_date reason").join(_rode, "stwid trip_date", "left").agg("reason", n="count(*)", rode_later="NUM(rode = 1)", share="R(RATE(rode = 1))"))

# E6 punctuality bands
_bands = dict(n="count(*)", very_early="R(RATE(late_minutes < -10))", early="R(RATE(late_minutes >= -10 AND late_minutes < 0))", in_time="R(RATE(late_minutes >= 0 AND late_minutes <= 5))",
    late="R(RATE(late_minutes > 5 AND late_minutes <= 15))", very_late="R(RATE(late_minutes > 15))", p50="R(PCT(late_minutes, 0.5))", p90="R(PCT(late_minutes, 0.9))", spread="R(stddev_samp(late_minutes))")
_on = legs.where("boarded")
add("E6_punctuality_month", _on.agg("month", **_bands))
add("E6_punctuality_direction", with_trip("late_minutes", "trip_direction", "boarded").agg("trip_direction", **_bands))
add("E6_punctuality_total", _on.agg({"scope": "'all'"}, **_bands))

# E7 rider against trip on time
_pair = dict(n="count(*)", rider_rate="R(RATE(late_minutes <= 5))", trip_rate="R(avg(on_time))", gap="R(RATE(late_minutes <= 5) - avg(on_time))")
add("E7_rider_vs_trip_month", with_trip("late_minutes", "on_time month", "boarded").agg("month", **_pair))
add("E7_rider_vs_trip_cell", with_trip("late_minutes", "on_time quarter trip_direction business_unit", "boarded").agg("quarter trip_direction business_unit", **_pair))

# E8 sequence in pickup order
_seq_cols = "trip_id planned_pickup_epoch rider_ref leg_ref leg_amount late_minutes actual_drop_epoch planned_drop_epoch actual_pickup_epoch"


def _sequence(df):
    order = [F.col(c) for c in ("planned_pickup_epoch", "rider_ref", "leg_ref", "leg_amount")]
    return with_position(df, ["trip_id"], order, "seq")


_seq_sql = f"SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY planned_pickup_epoch, {TIE}) AS seq FROM ({{src}})"
_seq = _on.cols(_seq_cols).via(_sequence, _seq_sql)
add("E8_leg_sequence", _seq.agg({"position": "cast(least(seq, 8) as int)"}, n="count(*)", late_rate=f"R(RATE({LATE}))", mean_late="R(avg(late_minutes))", overrun=f"R(avg({IN_CAB} - {PLAN_CAB}))"))
add("E8_every_position", _seq.agg({"position": "cast(seq as int)"}, n="count(*)", late_rate="R(RATE(late_minutes > 15))", mean_late="R(avg(late_minutes))"))
add("E8_sequence_by_size", _seq.cols("trip_id seq late_minutes").join(_on.agg("trip_id", size="count(*)"), "trip_id").where("size BETWEEN 2 AND 4").agg({"size": "size", "position": "cast(seq as int)"}, n="count(*)", late_rate=f"R(RATE({LATE}))"))
add("E8_sequence_every_size", _seq.cols("trip_id seq late_minutes").join(_on.agg("trip_id", size="count(*)"), "trip_id").agg({"size": "size", "position": "cast(seq as int)"}, n="count(*)", late_rate=f"R(RATE({LATE}))"))

# E9 first and last leg against the trip's own delay
_ends = _on.agg("trip_id", first_late=f"MINBY(late_minutes, planned_pickup_epoch, {TIE})", last_late=f"MAXBY(late_minutes, planned_pickup_epoch, {TIE})", n_legs="count(*)").join(rel("trips").cols("trip_id trip_direction delay_minutes"), "trip_id")
_endm = dict(n="count(*)", corr_first="R(CORR(first_late, delay_minutes))", corr_last="R(CORR(last_late, delay_minutes))", gap_first="R(avg(abs(first_late - delay_minutes)))", gap_last="R(avg(abs(last_late - delay_minutes)))")
add("E9_first_last_direction", _ends.agg("trip_direction", **_endm))
add("E9_first_last_total", _ends.agg({"scope": "'all'"}, **_endm))

# E10 burned minutes
add("E10_burned_minutes", _on.agg("month", late="ISUM(greatest(late_minutes, 0))", early="ISUM(greatest(-late_minutes, 0))", n="count(*)"))

# E11 concentration over riders: exact deciles and ventiles of the rider order
_riders = _on.where("stwid IS NOT NULL").agg("stwid", n_legs="count(*)", late=f"NUM({LATE})")


def _tiles(k: int, order):
    def step(df):
        tiled = with_tile(df, order(), k)
        return tiled.groupBy("tile").agg(F.count("*").alias("riders"), F.sum("n_legs").alias("legs"), F.sum("late").alias("late"))

    return step


def _tiles_sql(k: int, order: str) -> str:
    return f"SELECT CAST(tile AS INTEGER) AS tile, count(*) AS riders, CAST(sum(n_legs) AS BIGINT) AS legs, CAST(sum(late) AS BIGINT) AS late FROM (SELECT *, ntile({k}) OVER (ORDER BY {order}) AS tile FROM ({{src}})) GROUP BY 1"


_share = dict(late_share="R(late / nullif(sum(late) OVER (), 0))", leg_share="R(legs / nullif(sum(legs) OVER (), 0))")
add("E11_late_deciles", _riders.via(_tiles(10, lambda: [F.col("late").desc(), F.col("stwid")]), _tiles_sql(10, "late DESC, stwid")).plus(**_share))
add("E11_late_ventiles", _riders.via(_tiles(20, lambda: [F.col("late").desc(), F.col("stwid")]), _tiles_sql(20, "late DESC, stwid")).plus(**_share).where("tile = 1"))
add("E11_rate_deciles", _riders.where("n_legs >= 10").plus(rate="late / n_legs").via(_tiles(10, lambda: [F.col("rate").desc(), F.col("stwid")]), _tiles_sql(10, "rate DESC, stwid")).plus(**_share))

# E12 worst and best riders, repeaters
_rates = _riders.where("n_legs >= 20").plus(rate="late / n_legs")
add("E12_worst_riders", _rates.via(
    lambda df: df.orderBy(F.col("rate").desc(), F.col("n_legs").desc(), "stwid").limit(20), "SELECT * FROM ({src}) ORDER BY rate DESC, n_legs DESC, stwid LIMIT 20").cols("stwid n_legs late", rate="R(rate)"))
add("E12_best_riders", _rates.via(
    lambda df: df.orderBy("rate", F.col("n_legs").desc(), "stwid").limit(20), "SELECT * FROM ({src}) ORDER BY rate, n_legs DESC, stwid LIMIT 20").cols("stwid n_legs late", rate="R(rate)"))
_repeat = legs.where("stwid IS NOT NULL").agg("stwid", n_legs="count(*)", missed="NUM(is_no_show)", late=f"NUM(boarded AND {LATE})")
add("E12_repeaters", _repeat.agg({"scope": "'all'"}, riders="count(*)", never_late="R(RATE(late = 0))", repeat_riders="NUM(missed >= 2)", repeat_share="R(sum(CASE WHEN missed >= 2 THEN missed ELSE 0 END) / nullif(sum(missed), 0))"))

# E13 legs per trip
_size = legs.agg("trip_id", n_legs="count(*)", boarded_legs="NUM(boarded)")
add("E13_legs_histogram", _size.agg("n_legs", trips="count(*)").cols("n_legs trips", share="R(trips / sum(trips) OVER ())"))
_sized = _size.join(rel("trips").cols("trip_id quarter cab_capacity emp_planned emp_actual"), "trip_id")
add("E13_legs_per_quarter", _sized.agg("quarter", trips="count(*)", mean_legs="R(avg(n_legs))", single_share="R(RATE(n_legs = 1))", p90="R(PCT(n_legs, 0.9))"))
add("E13_legs_vs_capacity", _sized.agg("cab_capacity", trips="count(*)", fill="R(sum(n_legs) / nullif(sum(cab_capacity), 0))", over_capacity="NUM(n_legs > cab_capacity)"))
add("E13_agreement", _sized.agg({"scope": "'all'"}, trips="count(*)", planned_match="R(RATE(n_legs = emp_planned))", actual_match="R(RATE(boarded_legs = emp_actual))", mean_gap="R(avg(boarded_legs - emp_actual))"))

# E14 composition
_mix = legs.agg("trip_id", women="NUM(gender = 'F' AND boarded)", men="NUM(gender = 'M' AND boarded)", escorts="NUM(emp_role = 'ESCORT')").plus(
    composition="CASE WHEN women = 0 AND men = 0 THEN 'nobody' WHEN men = 0 AND women = 1 THEN 'lone woman' WHEN men = 0 THEN 'women only' WHEN women = 0 THEN 'men only' ELSE 'mixed' END")
_mixed = _mix.join(rel("trips").cols("trip_id actual_escort shift_hour").plus(night="coalesce(shift_hour >= 20 OR shift_hour <= 5, false)").cols("trip_id actual_escort night"), "trip_id")
add("E14_composition", _mixed.agg("composition night", trips="count(*)", escort_share="R(RATE(actual_escort))", escort_role_share="R(RATE(escorts > 0))"))
add("E14_role_mix", legs.agg("emp_role gender", n="count(*)", boarded="NUM(boarded)", late_rate=f"R(RATE(boarded AND {LATE}))"))

# E15 last drop
_last = _on.agg("trip_id", last_gender=f"MAXBY(gender, planned_drop_epoch, {TIE})", n_legs="count(*)")
_lasted = _last.join(rel("trips").cols("trip_id quarter office actual_escort"), "trip_id")
_lm = dict(trips="count(*)", woman_last="NUM(last_gender = 'F')", share="R(RATE(last_gender = 'F'))", escorted="R(avg(CASE WHEN last_gender = 'F' THEN CASE WHEN actual_escort THEN 1 ELSE 0 END END))")
for _d in ("quarter", "office", "actual_escort"):
    add(f"E15_last_drop_{_d}", _lasted.agg(_d, **_lm))

# E16 duration and speed
_cab = dict(n="count(*)", planned_min=f"R(avg({PLAN_CAB}))", actual_min=f"R(avg({IN_CAB}))", overrun=f"R(avg({IN_CAB} - {PLAN_CAB}))", kmh=f"R(sum(traveled_km) / nullif(sum({IN_CAB}) / 60, 0))")
_ck = "actual_drop_epoch actual_pickup_epoch planned_drop_epoch planned_pickup_epoch traveled_km"
_cw = "boarded AND traveled_km >= 0"
add("E16_duration_direction", with_trip(_ck, "trip_direction quarter", _cw).agg("trip_direction quarter", **_cab))
add("E16_duration_unit", with_trip(_ck, "business_unit", _cw).agg("business_unit", **_cab))
add("E16_solo_control", with_trip(_ck, "emp_actual", _cw).agg({"solo": "emp_actual = 1"}, **_cab))

# E17 one target for both directions
add("E17_unified_target", with_trip("late_minutes actual_drop_epoch planned_drop_epoch", "trip_direction month", "boarded").agg("month", n="count(*)",
    on_target=f"R(RATE(CASE WHEN trip_direction = 'LOGIN' THEN {DROP_DEV} ELSE late_minutes END <= 5))"))

# E18 the pooled effect inside each unit
_in = with_trip("late_minutes gender", "business_unit shift_hour trip_date", "boarded").plus(weekday="WEEKDAY(trip_date)")
add("E18_gender_in_unit", _in.cols("business_unit gender late_minutes").agg("business_unit", women=f"R(avg(CASE WHEN gender = 'F' THEN CASE WHEN {LATE} THEN 1 ELSE 0 END END))", men=f"R(avg(CASE WHEN gender = 'M' THEN CASE WHEN {LATE} THEN 1 ELSE 0 END END))"))
add("E18_weekday_in_unit", _in.cols("business_unit weekday late_minutes").agg("business_unit weekday", n="count(*)", rate=f"R(RATE({LATE}))"))
add("E18_hour", with_trip("late_minutes gender", "shift_hour", "boarded").agg("shift_hour", n="count(*)", women=f"R(avg(CASE WHEN gender = 'F' THEN late_minutes END))", men=f"R(avg(CASE WHEN gender = 'M' THEN late_minutes END))"))

# E19 headline again after one row per trip id
_one = rel("trips").agg("trip_id", trip_direction="min(trip_direction)", month="min(month)", on_time="min(on_time)")
add("E19_deduplicated_join", _on.cols("trip_id late_minutes").join(_one, "trip_id").agg("trip_direction month", **_pair))
