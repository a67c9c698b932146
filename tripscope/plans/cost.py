"""Cost analyses over billing lines and the trips they bill.

Lines are aggregated before any window, so a contract or vendor holding a third of all lines is combined map-side. Money
medians use the banded exact percentile; a plain one would hold a group's distinct amounts in one buffer.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.functions.quantiles import exact_percentiles
from tripscope.plans.flow import Flow, FlowBook, rel
from tripscope.plans.registry import Book

BOOK = Book()
add = FlowBook(BOOK)

MIN_LINES = 100
CYCLE = "concat(YM(cycle_start), CASE WHEN dayofmonth(cycle_start) = 1 THEN '-A' ELSE '-B' END)"
SLAB = "coalesce(slab_name, 'NA')"
CLASSES = "CASE WHEN zero_share >= 0.95 THEN 'FIXED' WHEN zero_share <= 0.20 THEN 'DISTANCE' ELSE 'MIXED' END"

bills = rel("bills")


def billed(bill_cols: str, trip_cols: str) -> Flow:
    """Billing lines with their trip; overhead lines have none."""
    return bills.where("trip_id is not null").cols("trip_id " + bill_cols).join(rel("trips").cols("trip_id " + trip_cols), "trip_id")


def per_trip(trip_cols: str, keep: str = "") -> Flow:
    """Trips with their billed total: lines are summed per trip first, so nothing multiplies in the join."""
    lines = bills.where("trip_id is not null").agg("trip_id " + keep, cost="sum(trip_cost)", km="sum(total_trip_km)", n_lines="count(*)")
    return lines.join(rel("trips").cols("trip_id " + trip_cols), "trip_id")


def medians(keys: list[str], value: str, ps: list[float]):
    """A chain step giving exact percentiles per group, and its SQL."""
    names = ", ".join(keys)
    picks = ", ".join(f"quantile_cont(CAST({value} AS DOUBLE), {p}) AS p{round(p * 100)}" for p in ps)
    sql = f"SELECT {names + ', ' if keys else ''}count({value}) AS n, {picks} FROM ({{src}}) WHERE {value} IS NOT NULL" + (f" GROUP BY {names}" if keys else "")
    return (lambda df: exact_percentiles(df, keys, value, ps)), sql


def rounded(flow: Flow, keep: str, *floats: str, places: int = 4) -> Flow:
    return flow.cols(keep, **{f: f"R({f}, {places})" for f in floats})


# C1 contract class from its zero-distance share
add("C1_contract_class", bills.agg(
    "contract", n="count(*)", spend="R(sum(trip_cost), 4)", zero_share="RATE(total_trip_km = 0)",
    cost_km_corr="R(CORR(CASE WHEN total_trip_km > 0 THEN trip_cost END, CASE WHEN total_trip_km > 0 THEN total_trip_km END))",
).plus(contract_class=CLASSES).cols("contract n spend cost_km_corr contract_class", zero_share="R(zero_share)"))

# C2 spend split, and the same inside cycle and month
for _n, _dim in (("cycle", {"cycle": CYCLE}), ("month", {"month": "month"})):
    _d = next(iter(_dim))
    add(f"C2_spend_split_{_n}", bills.agg({"billing_regime": "billing_regime", **_dim}, spend="sum(trip_cost)", n="count(*)").cols(
        f"billing_regime {_d} n", spend="R(spend, 4)", share=f"R(spend / nullif(sum(spend) OVER (PARTITION BY {_d}), 0))"))
add("C2_spend_split", bills.agg("billing_regime", spend="sum(trip_cost)", n="count(*)").cols(
    "billing_regime n", spend="R(spend, 4)", share="R(spend / sum(spend) OVER ())"))

# C3 blended against segmented
_unit = dict(n="count(*)", cost_per_km="R(sum(trip_cost) / nullif(sum(total_trip_km), 0))", cost_per_line="R(sum(trip_cost) / count(*))")
add("C3_blended_vs_segmented", bills.agg({"scope": "'blended'"}, **_unit).union(
    bills.where("billing_regime = 'DISTANCE_BASED'").agg({"scope": "'distance only'"}, **_unit)))

# C4 unit cost by cycle, contract, office with the median of ratios
for _n, _e in (("cycle", CYCLE), ("contract", "contract"), ("office", "office")):
    _base = bills.where("billing_regime = 'DISTANCE_BASED' AND trip_cost >= 0 AND total_trip_km > 0")
    _sums = _base.agg({"k": _e}, lines="count(*)", ratio="sum(trip_cost) / nullif(sum(total_trip_km), 0)")
    _med = _base.cols(k=_e, unit="cost_per_km").via(*medians(["k"], "unit", [0.5])).cols("k p50")
    add(f"C4_unit_cost_by_{_n}", _sums.join(_med, "k").where(f"lines >= {MIN_LINES}").cols("lines", **{_n: "k", "ratio": "R(ratio)", "median_ratio": "R(p50)"}))

# C5 vendor against its own contract
_cv = bills.where("billing_regime = 'DISTANCE_BASED' AND trip_cost >= 0").agg("contract vendor", cost="sum(trip_cost)", km="sum(total_trip_km)", n="count(*)")
add("C5_vendor_vs_contract", _cv.plus(own="cost / nullif(km, 0)", peers="sum(cost) OVER (PARTITION BY contract) / nullif(sum(km) OVER (PARTITION BY contract), 0)").cols(
    "contract vendor n", own="R(own)", peers="R(peers)", gap="R(own - peers)"))

# C6 contract share in three months, widest shift
_m = {f"m{i}": f"sum(CASE WHEN month(month) = {i} THEN trip_cost ELSE 0 END)" for i in (5, 6, 7)}
add("C6_share_by_month", bills.agg("contract", **_m).plus(**{f"s{i}": f"m{i} / nullif(sum(m{i}) OVER (), 0)" for i in (5, 6, 7)}).cols(
    "contract", may="R(s5)", jun="R(s6)", jul="R(s7)", shift="R(abs(s7 - s5))"))

# C7 concentration
for _d in ("vendor", "contract", "office"):
    add(f"C7_concentration_{_d}", bills.agg(_d, spend="sum(trip_cost)").plus(share="spend / sum(spend) OVER ()").plus(
        running=f"sum(share) OVER (ORDER BY spend DESC, {_d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
        place=f"row_number() OVER (ORDER BY spend DESC, {_d})").cols(f"{_d} place", spend="R(spend, 4)", share="R(share)", running="R(running)"))
_hhi = None
for _d in ("vendor", "contract", "office"):
    _one = bills.agg({"k": _d}, spend="sum(trip_cost)").plus(share="spend / sum(spend) OVER ()").agg({"dimension": f"'{_d}'"}, hhi="R(sum(share * share))", members="count(*)")
    _hhi = _one if _hhi is None else _hhi.union(_one)
add("C7_hhi", _hhi)

# C8 top supplier per site
_ov = bills.agg("office vendor", spend="sum(trip_cost)")
add("C8_top_supplier", _ov.agg("office", top_vendor="MAXBY(vendor, spend, vendor)", top="max(spend)", total="sum(spend)", suppliers="count(*)").cols(
    "office top_vendor suppliers", top_share="R(top / nullif(total, 0))"))

# C9 credits
_credit = dict(n="count(*)", credit_lines="NUM(trip_cost < 0)", gross="R(sum(CASE WHEN trip_cost >= 0 THEN trip_cost ELSE 0 END), 4)",
               credits="R(sum(CASE WHEN trip_cost < 0 THEN -trip_cost ELSE 0 END), 4)", net="R(sum(trip_cost), 4)")
_cs = {"credit_share": "R(credits / nullif(gross, 0))"}
for _n, _d in (("vendor", {"vendor": "vendor"}), ("month", {"month": "month"}), ("total", {"scope": "'all'"})):
    add(f"C9_credits_by_{_n}", bills.agg(_d, **_credit).plus(**_cs))

# C10 price against contract mean
add("C10_price_vs_contract_mean", bills.where("trip_cost >= 0").agg("contract vendor", n="count(*)", cost="sum(trip_cost)").plus(
    own="cost / n", mean="sum(cost) OVER (PARTITION BY contract) / sum(n) OVER (PARTITION BY contract)").cols(
    "contract vendor n", own="R(own, 4)", contract_mean="R(mean, 4)", excess="RT((own - mean) * n, 4)"))

# C11 peer outliers: peers share contract and slab; the generated prices spread less, so the cut is twice the median
_peers = bills.where("trip_cost > 0").cols("contract trip_cost", slab=SLAB).via(*medians(["contract", "slab"], "trip_cost", [0.5])).where(f"n >= {MIN_LINES}").cols("contract slab", peer_n="n", peer_median="p50")
_out = bills.where("trip_cost > 0").cols("contract vendor trip_cost", slab=SLAB).join(_peers, "contract slab").where("trip_cost > 2 * peer_median").plus(excess="trip_cost - peer_median")
add("C11_peer_outliers", _out.agg("contract slab", outliers="count(*)", peers="max(peer_n)", peer_median="R(max(peer_median), 4)", worst="R(max(trip_cost), 4)", excess="RT(sum(excess), 4)"))
for _d in ("vendor", "contract"):
    add(f"C11_outlier_excess_by_{_d}", _out.agg({_d: _d}, outliers="count(*)", excess="RT(sum(excess), 4)"))

# C12 integer multiples of the smallest price
_basis = bills.where("trip_cost > 0").agg("contract", base="min(trip_cost)")
add("C12_integer_multiples", bills.where("trip_cost > 0").cols("contract trip_cost").join(_basis, "contract").plus(ratio="trip_cost / base").agg(
    {"multiple": "cast(least(round(ratio), 20) as int)"}, n="count(*)", near_integer="NUM(abs(ratio - round(ratio)) < 0.02)"))

# C13 structural or missing label
_label = dict(n="count(*)", missing="NUM(slab_name IS NULL)", spend_missing="R(sum(CASE WHEN slab_name IS NULL THEN trip_cost ELSE 0 END), 4)",
              kind="CASE WHEN bool_and(slab_name IS NULL) THEN 'structural' WHEN bool_or(slab_name IS NULL) THEN 'sometimes' ELSE 'never' END")
for _n, _d in (("contract", {"contract": "contract"}), ("vendor", {"vendor": "vendor"}), ("total", {"scope": "'all'"})):
    add(f"C13_missing_label_{_n}", bills.agg(_d, **_label))

# C14 billed against travelled distance
_dist = billed("contract vendor total_trip_km cost_per_km billing_regime", "traveled_km route_source").where("billing_regime = 'DISTANCE_BASED' AND traveled_km >= 0").plus(diff="total_trip_km - traveled_km")
_dm = dict(n="count(*)", over_share="R(RATE(diff > 0.5))", under_share="R(RATE(diff < -0.5))", exact_share="R(RATE(diff = 0))", mae="R(avg(abs(diff)))",
           corr_km="R(CORR(total_trip_km, traveled_km))", extra_value="RT(sum(CASE WHEN diff > 0 THEN diff * coalesce(cost_per_km, 0) ELSE 0 END), 4)")
for _n, _d in (("vendor", {"vendor": "vendor"}), ("contract", {"contract": "contract"}), ("route", {"route_source": "route_source"}), ("total", {"scope": "'all'"})):
    add(f"C14_billed_distance_{_n}", _dist.agg(_d, **_dm))

# C15 orphan lines and unbilled trips
_billed_ids = bills.where("trip_id is not null").agg("trip_id")
add("C15_lines_without_trip", bills.cols("trip_id contract vendor trip_cost").join(rel("trips", "trip_id").cols("trip_id"), "trip_id", "anti").agg(
    "vendor contract", n="count(*)", spend="R(sum(trip_cost), 4)"))
_unbilled = rel("trips").cols("trip_id month business_unit").join(_billed_ids.plus(has_bill="1"), "trip_id", "left")
for _d in ("month", "business_unit"):
    add(f"C15_unbilled_by_{_d}", _unbilled.agg(_d, trips="count(*)", unbilled="NUM(has_bill IS NULL)", billed_share="R(RATE(has_bill = 1))"))

# C16 month over month
add("C16_spend_growth", bills.agg("month", spend="sum(trip_cost)", n="count(*)").plus(prior="lag(spend) OVER (ORDER BY month)").cols(
    "month n", spend="R(spend, 4)", prior="R(prior, 4)", growth="R((spend - prior) / nullif(prior, 0))"))

# C17 cost per rider and seat fill
_rider = dict(trips="count(*)", cost_per_rider="R(sum(cost) / nullif(sum(emp_actual), 0))", cost_per_trip="R(sum(cost) / count(*))", fill="R(sum(emp_actual) / nullif(sum(cab_capacity), 0))")
add("C17_cost_per_rider_month", per_trip("emp_actual cab_capacity month").agg("month", **_rider))
add("C17_cost_per_rider_capacity", per_trip("emp_actual cab_capacity").agg("cab_capacity", **_rider))
for _n, _d in (("regime", "billing_regime"), ("contract", "contract")):
    add(f"C17_cost_per_rider_{_n}", per_trip("emp_actual cab_capacity", _d).agg(_d, **_rider))

# C18 spend on trips that carried nobody
_zero = per_trip("emp_actual emp_planned noshow quarter", "contract").where("emp_actual <= 0")
add("C18_zero_rider_quarter", _zero.agg("quarter", n="count(*)", spend="R(sum(cost), 4)"))
add("C18_zero_rider_contract", _zero.agg("contract", n="count(*)", spend="R(sum(cost), 4)"))
_proof = rel("legs").agg("trip_id", boarded_legs="NUM(boarded)", leg_rows="count(*)")
add("C18_zero_rider_class", per_trip("emp_actual emp_planned noshow").where("emp_actual <= 0").join(_proof, "trip_id", "left").agg(
    {"explanation": "CASE WHEN noshow >= emp_planned THEN 'all planned riders missing' WHEN leg_rows IS NULL THEN 'no leg rows' WHEN boarded_legs > 0 THEN 'legs show boarding' ELSE 'unexplained' END"},
    n="count(*)", spend="R(sum(cost), 4)", with_boarding="NUM(boarded_legs > 0)"))

# C19 repeated billing
_copies = bills.where("trip_id is not null").agg("trip_id", copies="count(*)", vendors="count(DISTINCT vendor)", months="count(DISTINCT month)", spend="sum(trip_cost)", top="max(trip_cost)")
add("C19_copies_histogram", _copies.agg("copies", trips="count(*)", spend="R(sum(spend), 4)"))
add("C19_duplicate_billing", _copies.where("copies > 1").agg({"scope": "'billed more than once'"}, trips="count(*)", several_vendors="NUM(vendors > 1)", several_months="NUM(months > 1)", beyond_largest="R(sum(spend - top), 4)"))
add("C19_duplicate_units", _copies.where("copies > 1").cols("trip_id copies").join(rel("trips").cols("trip_id business_unit"), "trip_id").agg("business_unit", trips="count(*)", lines="ISUM(copies)"))

# C20 overhead lines
add("C20_overhead_by_vendor", bills.where("is_overhead").agg("vendor", n="count(*)", spend="R(sum(trip_cost), 4)", largest="R(max(trip_cost), 4)"))
add("C20_overhead_effect", bills.agg({"scope": "'all'"}, lines="count(*)", overhead_lines="NUM(is_overhead)", mean_all="R(avg(trip_cost))", mean_without="R(avg(CASE WHEN NOT is_overhead THEN trip_cost END))"))

# C21 levelling prize
_level = bills.where("trip_cost > 0").agg({"contract": "contract", "slab": SLAB, "office": "office", "vendor": "vendor"}, n="count(*)", cost="sum(trip_cost)").where("n >= 5").plus(mean="cost / n").plus(
    best="min(mean) OVER (PARTITION BY contract, slab, office)", suppliers="count(*) OVER (PARTITION BY contract, slab, office)").where("suppliers >= 2")
add("C21_levelling_by_contract", _level.agg("contract", strata="PAIRS(slab, office)", spend="R(sum(cost), 4)", saving="RT(sum((mean - best) * n), 4)"))
add("C21_levelling_total", _level.agg({"scope": "'all'"}, cells="count(*)", spend="R(sum(cost), 4)", saving="RT(sum((mean - best) * n), 4)"))

# C22 spread under three normalisations
_three = billed("contract vendor trip_cost total_trip_km", "emp_actual").where("trip_cost > 0").agg("contract vendor", n="count(*)", cost="sum(trip_cost)", km="sum(total_trip_km)", riders="sum(emp_actual)").plus(
    per_trip="cost / n", per_rider="cost / nullif(riders, 0)", per_km="cost / nullif(km, 0)")
add("C22_normalised_unit_cost", rounded(_three, "contract vendor n", "per_trip", "per_rider", "per_km", places=6))
add("C22_spread", _three.plus(best="min(per_rider) OVER (PARTITION BY contract)").agg("contract", vendors="count(*)", spread_trip="R(max(per_trip) / nullif(min(per_trip), 0))",
    spread_rider="R(max(per_rider) / nullif(min(per_rider), 0))", spread_km="R(max(per_km) / nullif(min(per_km), 0))", prize="RT(sum((per_rider - best) * riders), 4)"))

# C23 zero-cost lines
add("C23_zero_cost_contract", billed("contract trip_cost", "emp_actual").agg("contract", n="count(*)", zero_lines="NUM(trip_cost = 0)", carried_riders="NUM(trip_cost = 0 AND emp_actual > 0)", has_priced_peer="bool_or(trip_cost > 0)"))
add("C23_zero_cost_month", bills.agg("month", n="count(*)", zero_lines="NUM(trip_cost = 0)"))

# C24 segment reversal
_half = dict(u0="sum(CASE WHEN year(month) = 1996 THEN trip_cost END) / nullif(sum(CASE WHEN year(month) = 1996 THEN total_trip_km END), 0)",
             u1="sum(CASE WHEN year(month) = 1997 THEN trip_cost END) / nullif(sum(CASE WHEN year(month) = 1997 THEN total_trip_km END), 0)")
add("C24_segment_reversal", bills.agg({"segment": "billing_regime"}, **_half).union(bills.agg({"segment": "'ALL'"}, **_half)).cols(
    "segment", unit_1996="R(u0)", unit_1997="R(u1)", change="R(u1 - u0)"))

# C25 target calibration
_unit_rows = bills.where("cost_per_km IS NOT NULL AND trip_cost >= 0")
_ps = [0.05, 0.25, 0.5, 0.75, 0.95]
_pn = ("p5", "p25", "p50", "p75", "p95")
add("C25_calibration_quarter", rounded(_unit_rows.cols("quarter cost_per_km").via(*medians(["quarter"], "cost_per_km", _ps)), "quarter n", *_pn, places=6))
add("C25_calibration_unit", rounded(_unit_rows.cols("business_unit cost_per_km").via(*medians(["business_unit"], "cost_per_km", _ps)), "business_unit n", *_pn, places=6))
add("C25_calibration_total", rounded(_unit_rows.cols("cost_per_km").via(*medians([], "cost_per_km", _ps)), "n", *_pn, places=6))
