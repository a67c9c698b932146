"""Analyses across relations. Every side is reduced to its join key before it meets another."""

from __future__ import annotations

import zlib

from pyspark.sql import SparkSession

from tripscope.plans.cost import billed, per_trip
from tripscope.plans.feedback import BUCKET, rated
from tripscope.plans.flow import _RELATIONS, FlowBook, rel
from tripscope.plans.registry import Book
from tripscope.session import input_mark
from tripscope.sources import copartitioned

BOOK = Book()
add = FlowBook(BOOK)
trips, bills, alerts, fb, legs = rel("trips"), rel("bills"), rel("alerts"), rel("feedback"), rel("legs")

# X1 cardinality of the five relations against the trip key
_keys = trips.agg("trip_id").plus(known="1")
_card = None
for _name in ("trips", "bills", "alerts", "legs", "feedback"):
    _ids = rel(_name).agg("trip_id", copies="count(*)").join(_keys, "trip_id", "left").agg(
        {"relation": f"'{_name}'"}, rows_all="ISUM(copies)", ids="count(trip_id)", matched_ids="NUM(known = 1)", unmatched_ids="NUM(known IS NULL AND trip_id IS NOT NULL)", rows_without_id="ISUM(CASE WHEN trip_id IS NULL THEN copies ELSE 0 END)", most_copies="max(copies)")
    _card = _ids if _card is None else _card.union(_ids)
add("X1_join_cardinality", _card)
add("X1_trips_without", trips.cols("trip_id").join(bills.where("trip_id is not null").agg("trip_id"), "trip_id", "anti").agg({"missing_in": "'bills'"}, trips="count(*)").union(
    trips.cols("trip_id").join(fb.agg("trip_id"), "trip_id", "anti").agg({"missing_in": "'feedback'"}, trips="count(*)")).union(
    trips.cols("trip_id").join(alerts.agg("trip_id"), "trip_id", "anti").agg({"missing_in": "'alerts'"}, trips="count(*)")))

# X2 excess over the undelayed in the same cell: cells are built before the baseline is joined
for _n, _cell in (("contract", "contract business_unit quarter"), ("contract_slab", "contract slab business_unit quarter")):
    _rows = billed("contract trip_cost slab_name", "business_unit quarter delay_reason").where("trip_cost >= 0").plus(slab="coalesce(slab_name, 'NA')")
    _cells = _rows.agg(_cell + " delay_reason", n="count(*)", cost="sum(trip_cost)")
    _basis = _cells.where("delay_reason = 'NODELAY'").cols(_cell, base_n="n", base="cost / n").where("base_n >= 5")
    _ex = _cells.where("delay_reason <> 'NODELAY'").join(_basis, _cell).plus(excess="cost - base * n")
    add(f"X2_excess_{_n}", _ex.agg("delay_reason", n="ISUM(n)", excess="RT(sum(excess), 4)", per_line="RT(sum(excess) / sum(n), 4)"))
    add(f"X2_excess_{_n}_quarter", _ex.agg("delay_reason quarter", n="ISUM(n)", excess="RT(sum(excess), 4)"))

# X3 rating points lost per minute of delay
_loss = rated("route_rating", "delay_minutes delay_reason").where("delay_minutes < 240 AND route_rating IS NOT NULL").plus(bucket=BUCKET)
for _n, _d in (("bucket", "bucket"), ("reason", "delay_reason")):
    _none = "none" if _n == "bucket" else "NODELAY"
    add(f"X3_rating_cost_{_n}", _loss.cols(f"{_d} route_rating delay_minutes").agg(_d, n="count(*)", mean="avg(route_rating)", minutes="avg(delay_minutes)").plus(basis=f"max(CASE WHEN {_d} = '{_none}' THEN mean END) OVER ()").cols(
        f"{_d} n", mean="R(mean)", delta="R(mean - basis)", per_minute="R((mean - basis) / nullif(minutes, 0))"))

# X4 alerted trips, with rider and unit controls
_ta = alerts.agg("trip_id", n_alerts="count(*)")
_ra = fb.where("stwid is not null").cols("trip_id stwid").join(_ta, "trip_id").agg("stwid", alerted_trips="count(*)")
_al = fb.cols("trip_id stwid route_rating safety_rating").join(_ta, "trip_id", "left").join(_ra, "stwid", "left")
_am = dict(n="count(*)", route="R(avg(route_rating))", safety="R(avg(safety_rating))")
add("X4_alerted_vs_rest", _al.agg({"alerted": "n_alerts IS NOT NULL", "same_rider_alerted_elsewhere": "n_alerts IS NULL AND alerted_trips IS NOT NULL"}, **_am))
add("X4_unit_control", _al.join(trips.cols("trip_id business_unit"), "trip_id").agg({"business_unit": "business_unit", "alerted": "n_alerts IS NOT NULL"}, **_am))

# X5 value of empty seats
_seat = per_trip("emp_planned noshow quarter office").plus(lost="cost * noshow / nullif(emp_planned, 0)")
for _d in ("quarter", "office"):
    add(f"X5_noshow_value_{_d}", _seat.cols(f"{_d} lost cost").agg(_d, trips="count(*)", lost="RT(sum(lost), 4)", share="R(sum(lost) / nullif(sum(cost), 0))"))

# X6 does the rider side show the same dip
_swing = legs.where("boarded").cols("trip_id late_minutes").join(trips.cols("trip_id office shift_hour product_type quarter on_time"), "trip_id")
_sw = dict(n="count(*)", before="avg(CASE WHEN quarter = date '1998-01-01' THEN CASE WHEN late_minutes <= 5 THEN 1 ELSE 0 END END)", after="avg(CASE WHEN quarter = date '1998-04-01' THEN CASE WHEN late_minutes <= 5 THEN 1 ELSE 0 END END)",
           trip_before="avg(CASE WHEN quarter = date '1998-01-01' THEN on_time END)", trip_after="avg(CASE WHEN quarter = date '1998-04-01' THEN on_time END)")
for _d in ("office", "shift_hour", "product_type"):
    add(f"X6_swing_{_d}", _swing.cols(f"{_d} late_minutes quarter on_time").agg(_d, **_sw).cols(f"{_d} n", rider_swing="R(after - before)", trip_swing="R(trip_after - trip_before)"))
for _d in ("office", "shift_hour", "product_type"):
    add(f"X6_every_quarter_{_d}", _swing.cols(f"{_d} late_minutes quarter on_time").agg(f"{_d} quarter", n="count(*)", rider="RATE(late_minutes <= 5)", trip="avg(on_time)").plus(
        d_rider=f"rider - lag(rider) OVER (PARTITION BY {_d} ORDER BY quarter)", d_trip=f"trip - lag(trip) OVER (PARTITION BY {_d} ORDER BY quarter)").cols(
        f"{_d} quarter n", rider="R(rider)", trip="R(trip)", rider_swing="R(d_rider)", trip_swing="R(d_trip)"))
add("X6_same_trip_corr", legs.where("boarded").agg("trip_id", late="avg(late_minutes)").join(trips.cols("trip_id delay_minutes month"), "trip_id").agg("month", trips="count(*)", same_trip="R(CORR(late, delay_minutes))"))

# X7 vendor scorecard at trip grain
_score = trips.cols("trip_id vendor_id on_time delay_minutes emp_actual cab_capacity noshow emp_planned is_driver_nc").join(
    bills.where("trip_id is not null").agg("trip_id", cost="sum(trip_cost)", km="sum(total_trip_km)"), "trip_id", "left").join(_ta, "trip_id", "left").join(fb.agg("trip_id", rating="avg(route_rating)"), "trip_id", "left")
add("X7_vendor_scorecard", _score.agg("vendor_id", trips="count(*)", on_time_rate="R(avg(on_time))", mean_delay="R(avg(delay_minutes))", fill="R(sum(emp_actual) / nullif(sum(cab_capacity), 0))",
    noshow_rate="R(sum(noshow) / nullif(sum(emp_planned), 0))", driver_nc="R(RATE(is_driver_nc))", cost_per_trip="R(sum(cost) / nullif(count(cost), 0))", cost_per_km="R(sum(cost) / nullif(sum(km), 0))",
    alerts_per_1000="R(sum(coalesce(n_alerts, 0)) * 1000 / count(*))", mean_rating="R(avg(rating))", response="R(count(rating) / count(*))").where("trips >= 100"))


# The same joins on relations stored by trip id: published once per application, then joined without a shuffle.
_STORED: set[str] = set()
_BY_TRIP = ("trips", "bills", "alerts", "feedback")


def stored_readers(spark: SparkSession, sf: str) -> dict:
    mark = zlib.crc32(repr((spark.sparkContext.applicationId, sf, input_mark(spark, sf))).encode())
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = {}
    for name in _BY_TRIP:
        reader, columns = _RELATIONS[name]
        table = f"{name}_{mark:08x}_{buckets}"
        if table not in _STORED:
            copartitioned.publish(reader(spark, sf), table, buckets)
            _STORED.add(table)
        out[name] = (lambda spark, sf, *cols, t=table: copartitioned.with_id(spark, t).select(*cols), columns)
    return out


for _name in ("X7_vendor_scorecard", "X1_trips_without"):
    _flow = add.flows[_name]
    BOOK.add(f"{_name}_stored_by_trip", lambda spark, sf, f=_flow: f.dataframe(spark, sf, stored_readers(spark, sf)), _flow.sql())

# X8 cost index against peers in the same contract, unit and quarter
_peer = billed("contract vendor trip_cost", "business_unit quarter").where("trip_cost > 0").agg("contract business_unit quarter vendor", n="count(*)", cost="sum(trip_cost)").plus(
    mean="sum(cost) OVER (PARTITION BY contract, business_unit, quarter) / sum(n) OVER (PARTITION BY contract, business_unit, quarter)")
add("X8_cost_index", _peer.agg("vendor", n="ISUM(n)", cost_index="R(sum(cost / mean) / sum(n))"))

# X9 vendor against the same office and quarter
_cell = trips.agg("vendor_id office quarter", n="count(*)", hits="sum(on_time)").plus(peer="sum(hits) OVER (PARTITION BY office, quarter) / sum(n) OVER (PARTITION BY office, quarter)")
add("X9_gap_to_office", _cell.agg("vendor_id", n="ISUM(n)", rate="R(sum(hits) / sum(n))", peer_rate="R(sum(peer * n) / sum(n))", gap="R(sum(hits - peer * n) / sum(n))"))

# X10 coverage against outcome across vendors
add("X10_coverage_vs_outcome", trips.cols("trip_id vendor_id on_time").join(fb.agg("trip_id").plus(answered="1"), "trip_id", "left").agg("vendor_id", response="RATE(answered = 1)", rate="avg(on_time)").agg(
    {"scope": "'vendors'"}, vendors="count(*)", corr_response_rate="R(CORR(response, rate))"))
