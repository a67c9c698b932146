"""Data-quality queries over the typed relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripscope.operators import quality as Q
from tripscope.plans.flow import Flow, FlowBook, rel, spell
from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.plans.timeliness import END_DEV
from tripscope.sources import roles

BOOK = Book()
add = FlowBook(BOOK)
trips, bills, alerts, legs, fb = rel("trips"), rel("bills"), rel("alerts"), rel("legs"), rel("feedback")


def counts(checks: dict[str, str]) -> dict[str, str]:
    return {"rows_read": "count(*)", **{a: f"NUM({c})" for a, c in checks.items()}}


def stacked(flow: Flow, names: list[str], key: str, value: str) -> Flow:
    """A one-row table turned into (name, value) rows."""
    sql = "WITH w AS ({src}) " + " UNION ALL ".join(f"SELECT '{n}' AS {key}, {n} AS {value} FROM w" for n in names)
    return flow.via(lambda df: Q.as_rows(df, names, key, value), sql)


# Q1, Q2 defect counters, one pass per relation
TRIP_CHECKS = {
    "bad_trip_id": "trip_id IS NULL", "bad_date": "trip_date IS NULL", "null_delay": "delay_minutes IS NULL", "null_actual_end": "actual_end_epoch IS NULL",
    "null_planned_km": "planned_km IS NULL", "null_traveled_km": "traveled_km IS NULL", "null_driver_nc": "is_driver_nc IS NULL", "null_cab_nc": "is_cab_nc IS NULL",
    "negative_km": "planned_km < 0 OR traveled_km < 0", "delay_over_24h": "delay_minutes > 1440", "trip_nodal_na": "trip_nodal = 'NA'",
    "usable_core": "trip_id IS NOT NULL AND trip_date IS NOT NULL AND delay_minutes IS NOT NULL",
}
BILL_CHECKS = {
    "overhead_rows": "is_overhead", "null_slab": "slab_name IS NULL", "fixed_rate_rows": "billing_regime = 'FIXED_RATE'", "zero_km_rows": "zero_km",
    "distance_zero_km": "billing_regime = 'DISTANCE_BASED' AND zero_km", "null_cost": "trip_cost IS NULL", "cost_per_km_defined": "cost_per_km IS NOT NULL",
}
ALERT_CHECKS = {"severity_null": "severity IS NULL", "severity_false": "severity_raw = 'False'", "unacknowledged": "unacknowledged", "placeholder_stwid": "stwid_placeholder", "bad_start_time": "start_time IS NULL"}
LEG_CHECKS = {"negative_km": "planned_km < 0 OR traveled_km < 0", "placeholder_stwid": "stwid_placeholder", "incomplete_leg": "actual_pickup_epoch IS NULL OR actual_drop_epoch IS NULL", "bad_date": "trip_date IS NULL"}
FB_CHECKS = {"bad_date": "trip_date IS NULL", "no_marshal_rating": "marshal_rating IS NULL", "placeholder_stwid": "stwid_placeholder", "unrated": "avg_rating IS NULL"}
ALL = {"scope": "'all'"}
add("Q1_trip_defects", trips.agg(ALL, **counts(TRIP_CHECKS), max_delay_minutes="coalesce(round(max(delay_minutes)), 0)"))
add("Q2_bill_defects", bills.agg(ALL, **counts(BILL_CHECKS)))
add("Q2_alert_defects", alerts.agg(ALL, **counts(ALERT_CHECKS)))
add("Q2_leg_defects", legs.agg(ALL, **counts(LEG_CHECKS), lowest_km="min(least(coalesce(planned_km, 0), coalesce(traveled_km, 0)))"))
add("Q2_feedback_defects", fb.agg(ALL, **counts(FB_CHECKS)))

# Q3 coverage per field and headline
_FIELDS = ["trip_id", "trip_date", "delay_minutes", "actual_end_epoch", "planned_km", "traveled_km", "is_driver_nc"]
_CORE = ["trip_id", "trip_date", "delay_minutes"]
BOOK.add(
    "Q3_field_coverage",
    lambda spark, sf: Q.coverage_by_field(roles.trips(spark, sf, *_FIELDS), _FIELDS, _CORE).withColumn("coverage", F.round("coverage", 6)),
    with_roles(
        " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, round(count({f}) / count(*), 6) AS coverage FROM trips" for f in _FIELDS)
        + " UNION ALL SELECT 'headline', count(*) FILTER (WHERE delay_minutes IS NOT NULL), round(count(*) FILTER (WHERE delay_minutes IS NOT NULL) / count(*), 6) FROM trips",
        "trips",
    ),
)

# Q4 confidence band
BOOK.add(
    "Q4_confidence_band",
    lambda spark, sf: roles.trips(spark, sf, "quarter", "delay_minutes").groupBy("quarter").agg(F.count("*").alias("n"), (F.count("delay_minutes") / F.count("*")).alias("c"))
    .select("quarter", "n", F.round("c", 6).alias("coverage"), Q.confidence_band(F.col("c"), F.col("n")).alias("band")),
    with_roles(
        "SELECT quarter, count(*) AS n, round(count(delay_minutes) / count(*), 6) AS coverage, CASE WHEN count(delay_minutes) / count(*) >= 0.98 AND count(*) >= 10000 THEN 'HIGH'"
        " WHEN count(delay_minutes) / count(*) >= 0.90 AND count(*) >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM trips GROUP BY 1", "trips"),
)

# Q5 caveats
_WORDING = {
    "null_delay": "%d trips (%.1f%%) have no readable delay", "null_actual_end": "%d trips (%.1f%%) have no actual end time", "negative_km": "%d trips carry a negative distance",
    "delay_over_24h": "%d trips report a delay beyond 24 hours", "null_driver_nc": "%d driver flags are unknown", "trip_nodal_na": "%d trips (%.1f%%) have no nodal category", "bad_date": "%d trips have no readable date",
}


def _caveat_sql() -> str:
    parts = []
    for k, text in _WORDING.items():
        head, *rest = text.split("%d")
        tail = rest[0].replace("%%", "%")
        if "%.1f" in tail:
            a, b = tail.split("%.1f")
            expr = f"'{head}' || n || '{a}' || printf('%.1f', round(n * 100.0 / rows_read, 1)) || '{b}'"
        else:
            expr = f"'{head}' || n || '{tail}'"
        parts.append(f"SELECT '{k}' AS counter, n, {expr} AS caveat FROM (SELECT {k} AS n, rows_read FROM w) WHERE n > 0")
    return "WITH w AS ({src}) " + " UNION ALL ".join(parts)


add("Q5_caveats", trips.agg(ALL, **counts(TRIP_CHECKS)).via(lambda df: Q.caveats(df, _WORDING), _caveat_sql()))

# Q6 column profile
_PROFILE = ["trip_id_raw", "contract", "slab_name", "vendor", "office"]
_profile_sql = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) FILTER (WHERE {c} = '') AS empty,
 count(*) FILTER (WHERE {c} <> trim({c})) AS padded, count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS BIGINT) IS NULL) AS cast_failures, min({c}) AS lowest, max({c}) AS highest,
 round(count(*) FILTER (WHERE {c} IS NULL) * 100 / count(*), 4) AS null_pct FROM bills""" for c in _PROFILE)
BOOK.add("Q6_column_profile", lambda spark, sf: Q.column_profile(roles.bills(spark, sf, *_PROFILE), _PROFILE), with_roles(_profile_sql, "bills"))

# Q7 children without a parent; the parents are the trips with a recorded end
_parents = trips.where("actual_end_epoch IS NOT NULL").agg("trip_id").plus(known="1")
_orph = None
for _n in ("bills", "alerts", "legs", "feedback"):
    _p = rel(_n).agg("trip_id", c="count(*)").join(_parents, "trip_id", "left").agg({"child": f"'{_n}'"}, rows_all="ISUM(c)", orphan_rows="ISUM(CASE WHEN known IS NULL AND trip_id IS NOT NULL THEN c ELSE 0 END)",
        orphan_ids="NUM(known IS NULL AND trip_id IS NOT NULL)", unparseable="ISUM(CASE WHEN trip_id IS NULL THEN c ELSE 0 END)")
    _orph = _p if _orph is None else _orph.union(_p)
add("Q7_orphans", _orph)

# Q8 parents without a child
_miss = None
for _n in ("bills", "alerts", "legs", "feedback"):
    _p = trips.cols("trip_id").join(rel(_n).where("trip_id IS NOT NULL").agg("trip_id"), "trip_id", "anti").agg({"child": f"'{_n}'"}, parents_without="count(*)")
    _miss = _p if _miss is None else _miss.union(_p)
add("Q8_missing_children", _miss)

# Q9 where the orphans sit
_open = trips.cols("trip_id business_unit month").join(alerts.agg("trip_id"), "trip_id", "anti")
for _d in ("business_unit", "month"):
    add(f"Q9_orphans_by_{_d}", _open.cols(f"trip_id {_d}").agg(_d, n="count(*)", lowest_id="min(trip_id)", highest_id="max(trip_id)"))
add("Q9_orphan_ranges", _open.cols("trip_id").agg({"range_of": "IDIV(trip_id, 1000)"}, n="count(*)"))

# Q10 rows per unit and relation
_unit = trips.cols("trip_id business_unit")
_pres = trips.agg("business_unit", n="count(*)").plus(relation="'trips'").union(bills.agg("business_unit", n="count(*)").plus(relation="'bills'"))
for _n in ("alerts", "legs", "feedback"):
    _pres = _pres.union(rel(_n).agg("trip_id", c="count(*)").join(_unit, "trip_id").agg("business_unit", n="ISUM(c)").plus(relation=f"'{_n}'"))
add("Q10_presence_matrix", _pres.agg("business_unit", **{x: f"ISUM(CASE WHEN relation = '{x}' THEN n ELSE 0 END)" for x in ("trips", "bills", "alerts", "legs", "feedback")}))

# Q11, Q12, Q13 keys
_KEYS = {
    "trip": ["trip_id"], "trip+line": ["trip_id", "leg_no"], "trip+rider": ["trip_id", "stwid"], "trip+date+rider": ["trip_id", "trip_date", "stwid"],
    "date+rider": ["trip_date", "stwid"], "trip+date+rider+line": ["trip_id", "trip_date", "stwid", "leg_no"], "rider": ["stwid"], "all parts": ["trip_id", "trip_date", "stwid", "leg_no", "leg_ref", "leg_amount"],
}


def _key_sql(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS key_name, CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_keys, CAST(sum(c) - count(*) AS BIGINT) AS excess, count(*) FILTER (WHERE c > 1) AS repeated_keys, max(c) AS most_copies"
        f" FROM (SELECT count(*) AS c FROM legs WHERE {where} GROUP BY {', '.join(cols)})" for k, cols in _KEYS.items())


_KEYCOLS = ["trip_id", "leg_no", "stwid", "trip_date", "leg_ref", "leg_amount"]
BOOK.add("Q13_candidate_keys", lambda spark, sf: Q.key_report(roles.legs(spark, sf, *_KEYCOLS), _KEYS), with_roles(_key_sql("true"), "legs"))
BOOK.add("Q13_candidate_keys_no_placeholder", lambda spark, sf: Q.key_report(roles.legs(spark, sf, *_KEYCOLS), _KEYS, "stwid is not null"), with_roles(_key_sql("stwid IS NOT NULL"), "legs"))


def _minimal_sql(columns: list[str]) -> str:
    """Counts every set of columns and keeps the keys that have no key inside them."""
    sets = [[c for i, c in enumerate(columns) if s >> i & 1] for s in range(1, 2 ** len(columns))]
    counted = " UNION ALL ".join(f"SELECT {[*s]} AS key_columns, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM legs)) = (SELECT count(*) FROM legs) AS is_key" for s in sets)
    return (f"SELECT array_to_string(key_columns, '+') AS key_columns, len(key_columns)::INT AS size FROM sets a WHERE is_key AND NOT EXISTS "
            "(SELECT 1 FROM sets b WHERE b.is_key AND len(b.key_columns) < len(a.key_columns) AND list_has_all(a.key_columns, b.key_columns))", f"sets AS ({counted})")


_FIND = ["trip_id", "leg_no", "stwid", "trip_date", "leg_ref", "leg_amount"]
BOOK.add("Q13_minimal_keys", lambda spark, sf: Q.minimal_keys(roles.legs(spark, sf, *_FIND), _FIND).select(F.array_join("key_columns", "+").alias("key_columns"), "size"),
         with_roles(_minimal_sql(_FIND)[0], "legs", extra=_minimal_sql(_FIND)[1]))
_copies = legs.agg("trip_id leg_no", copies="count(*)", variants="PAIRS(rider_ref, leg_ref, leg_amount, trip_date)", dates="count(DISTINCT trip_date)", riders="count(DISTINCT rider_ref)", first_day="min(trip_date)", last_day="max(trip_date)")
add("Q11_key_multiplicity", _copies.agg("copies", keys="count(*)", rows_all="ISUM(copies)"))
add("Q11_key_uniqueness", _copies.agg(ALL, rows_all="ISUM(copies)", keys="count(*)", excess="cast(sum(copies) - count(*) as bigint)"))
add("Q12_duplicate_kind", _copies.where("copies > 1").agg({"kind": "CASE WHEN variants = 1 THEN 'exact copy' WHEN variants = copies THEN 'all differ' ELSE 'partly' END"}, keys="count(*)", rows_all="ISUM(copies)"))

# Q14 the repeated keys in detail
_rep = _copies.where("copies > 1").plus(gap="DAYS(last_day, first_day)")
add("Q14_collision_gap", _rep.agg({"gap_bucket": "CASE WHEN gap = 0 THEN 'same day' WHEN gap <= 30 THEN 'to 30' WHEN gap <= 365 THEN 'to 365' ELSE 'longer' END"}, keys="count(*)", largest="max(gap)"))
add("Q14_collision_summary", _rep.agg(ALL, keys="count(*)", same_date="R(RATE(dates = 1))", same_rider="R(RATE(riders = 1))", lowest_id="min(trip_id)", highest_id="max(trip_id)"))
_rep_trip = _rep.agg("trip_id", keys="count(*)").join(trips.cols("trip_id business_unit office"), "trip_id")
for _d in ("business_unit", "office"):
    add(f"Q14_collision_by_{_d}", _rep_trip.cols(f"trip_id {_d} keys").agg(_d, trips="count(*)", keys="ISUM(keys)"))
add("Q14_collision_rows", legs.cols("trip_id leg_no gender boarded").join(_rep.cols("trip_id leg_no"), "trip_id leg_no", "semi").agg("gender", rows_all="count(*)", boarded="NUM(boarded)"))

# Q15 what a careless join would do: the size of the product follows from per-key counts, so it is never built
_b = bills.where("trip_id IS NOT NULL").agg("trip_id", bn="count(*)", money="sum(trip_cost)")
_l = legs.agg("trip_id", ln="count(*)")
_bt = bills.where("trip_id IS NOT NULL").agg({"trip_id": "trip_id", "line": "line_ref"}, bn="count(*)", money="sum(trip_cost)")
_lt = legs.agg({"trip_id": "trip_id", "line": "leg_no"}, ln="count(*)")
_fan = dict(joined_rows="ISUM(bn * ln)", true_rows="ISUM(bn)", joined_money="R(sum(money * ln), 4)", true_money="R(sum(money), 4)", inflation="R(sum(money * ln) / nullif(sum(money), 0))")
add("Q15_fan_out", _b.join(_l, "trip_id").agg({"join_key": "'trip'"}, **_fan).union(_bt.join(_lt, "trip_id line").agg({"join_key": "'trip+line'"}, **_fan)))
add("Q15_composite_key", _b.join(trips.cols("trip_id business_unit"), "trip_id").agg("business_unit", lines="ISUM(bn)", money="R(sum(money), 4)"))

# Q16 impossible values
_IMPOSSIBLE = {
    "trips": {"negative_distance": "traveled_km < 0", "delay_over_day": "delay_minutes > 1440", "end_before_start": "actual_end_epoch < actual_start_epoch", "more_riders_than_seats": "emp_actual > cab_capacity",
              "noshow_above_plan": "noshow > emp_planned", "actual_above_plan": "emp_actual > emp_planned", "travel_double_plan": "traveled_km > 2 * planned_km", "on_time_but_late_end": f"on_time = 1 AND {END_DEV} > 5"},
    "legs": {"negative_distance": "traveled_km < 0", "drop_before_pickup": "actual_drop_epoch < actual_pickup_epoch", "boarded_without_time": "boarded AND actual_pickup_epoch IS NULL", "missed_without_reason": "NOT boarded AND not_boarding_reason IS NULL", "noshow_but_boarded": "is_no_show AND boarded"},
    "bills": {"negative_cost": "trip_cost < 0", "zero_cost": "trip_cost = 0", "km_without_cost": "total_trip_km > 0 AND trip_cost = 0", "cost_per_km_over_2000": "cost_per_km > 2000"},
    "alerts": {"ack_before_start": "acknowledge_time < start_time", "ack_over_8h": "ack_minutes > 480", "severity_token": "severity_raw = 'False'"},
    "feedback": {"all_zero": "route_raw + driver_raw + cab_raw + safety_raw = 0", "rating_above_5": "greatest(route_raw, driver_raw, cab_raw, safety_raw) > 5", "lag_over_2_days": "lag_minutes > 2880"},
}
_imp = None
for _n, _checks in _IMPOSSIBLE.items():
    _p = rel(_n).agg(ALL, rows_read="count(*)", **{a: f"NUM({c})" for a, c in _checks.items()})
    _names = list(_checks)
    _sql = "WITH w AS ({src}) " + " UNION ALL ".join(f"SELECT '{_n}' AS relation, '{c}' AS \"check\", {c} AS n, rows_read FROM w" for c in _names)
    _p = _p.via(lambda df, n=_n, names=_names: Q.as_rows(df, names, "check", "n", ["rows_read"]).withColumn("relation", F.lit(n)), _sql)
    _imp = _p if _imp is None else _imp.union(_p)
add("Q16_impossible_values", _imp.plus(pct="R(n * 100 / rows_read)"))

# Q17 outlier distribution, whole minutes
add("Q17_outliers", trips.where("delay_minutes IS NOT NULL").agg(ALL, n="count(*)", **{f"p{str(p).replace('0.', '').ljust(2, '0')}": f"R(PCT(delay_minutes, {p}))" for p in (0.5, 0.9, 0.95, 0.99, 0.999)}, largest="max(delay_minutes)", over_4h="NUM(delay_minutes > 240)", over_24h="NUM(delay_minutes > 1440)"))

# Q18 two relations telling different stories; again without the trips whose keys collide
_leg_facts = legs.agg("trip_id", leg_boarded="NUM(boarded)", leg_noshow="NUM(is_no_show)", leg_escort="NUM(emp_role = 'ESCORT')")
_both = trips.cols("trip_id emp_actual noshow actual_escort trip_direction").join(_leg_facts, "trip_id")
_dis = dict(trips="count(*)", boarded_differs="NUM(emp_actual <> leg_boarded)", noshow_differs="NUM(noshow <> leg_noshow)", escort_differs="NUM(actual_escort AND leg_escort = 0)", boarded_share="R(RATE(emp_actual <> leg_boarded))")
add("Q18_trip_vs_legs", _both.agg(ALL, **_dis))
add("Q18_trip_vs_legs_no_collisions", _both.join(_rep.cols("trip_id").distinct(), "trip_id", "anti").agg(ALL, **_dis))
add("Q18_trip_vs_feedback", trips.cols("trip_id trip_direction trip_date month").join(fb.cols("trip_id trip_type", fb_date="trip_date"), "trip_id").agg("month", n="count(*)", direction_differs="NUM(trip_direction <> trip_type)", date_differs="NUM(trip_date <> fb_date)"))
add("Q18_trip_vs_bill", bills.where("trip_id IS NOT NULL").cols("trip_id ship_date vendor").join(trips.cols("trip_id trip_date vendor_id month"), "trip_id").agg("month", n="count(*)", vendor_differs="NUM(vendor <> vendor_id)", billed_before="NUM(ship_date < trip_date)"))

# Q19 days without rows
_days = trips.agg(ALL, a="min(trip_date)", b="max(trip_date)").via(
    lambda df: df.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day")), "SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM ({src})")
_cal = _days
for _n, _c in (("trips", "trip_date"), ("bills", "ship_date"), ("legs", "trip_date"), ("feedback", "trip_date")):
    _cal = _cal.join(rel(_n).agg({"day": _c}, **{f"n_{_n}": "count(*)"}), "day", "left")
_cal = _cal.cols("day", **{f"n_{n}": f"coalesce(n_{n}, 0)" for n in ("trips", "bills", "legs", "feedback")})
add("Q19_calendar", _cal)
add("Q19_gaps", _cal.agg({"month": "cast(date_trunc('month', day) as date)"}, days="count(*)", **{f"without_{n}": f"NUM(n_{n} = 0)" for n in ("trips", "bills", "legs", "feedback")}))

# Q20 dates out of the window, or at odds with another field
_when = legs.cols("trip_id trip_date planned_pickup_epoch").join(trips.cols("trip_id", booked="trip_date"), "trip_id").plus(shift="DAYS(trip_date, booked)")
add("Q20_out_of_window", _when.agg({"position": "CASE WHEN shift < -365 THEN 'over a year before' WHEN shift < 0 THEN 'before' WHEN shift <= 365 THEN 'within a year' ELSE 'over a year after' END"}, n="count(*)", widest="max(abs(shift))"))
add("Q20_month_mismatch", bills.agg(ALL, n="count(*)", cycle_month_differs="NUM(cast(date_trunc('month', cycle_start) as date) <> month)", starts_after_ship="NUM(cycle_start > ship_date)"))
add("Q20_epoch_vs_date", trips.where("actual_end_epoch IS NOT NULL").agg("month", n="count(*)", next_day="NUM(IDIV(actual_end_epoch, 86400) * 86400 > planned_start_epoch)", end_day_differs="NUM(IDIV(actual_end_epoch, 86400) <> IDIV(planned_start_epoch, 86400))"))

# Q22 categories that come and go
_catq = bills.where("quarter IN (date '1998-01-01', date '1998-04-01', date '1998-07-01')").agg({"label": "concat(contract, ' / ', coalesce(slab_name, 'NA'), ' / ', vendor)"}, q1="NUM(quarter = date '1998-01-01')", q2="NUM(quarter = date '1998-04-01')", q3="NUM(quarter = date '1998-07-01')")
add("Q22_category_drift", _catq.plus(flag="CASE WHEN q1 = 0 AND q3 > 0 THEN 'NEW' WHEN q1 > 0 AND q3 = 0 THEN 'GONE' ELSE 'STAYS' END"))

add("Q22_every_quarter", bills.agg({"label": "concat(contract, ' / ', coalesce(slab_name, 'NA'), ' / ', vendor)", "quarter": "quarter"}, n="count(*)").plus(
    before="lag(n) OVER (PARTITION BY label ORDER BY quarter)", later="lead(n) OVER (PARTITION BY label ORDER BY quarter)").plus(
    flag="CASE WHEN before IS NULL AND later IS NULL THEN 'ONCE' WHEN before IS NULL THEN 'NEW' WHEN later IS NULL THEN 'LAST' ELSE 'STAYS' END"))

# Q23 text hygiene
_TEXT = ["contract", "slab_name", "vendor", "office", "business_unit"]
BOOK.add("Q23_text_hygiene", lambda spark, sf: Q.text_hygiene(roles.bills(spark, sf, *_TEXT), _TEXT), with_roles(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} <> trim({c})) AS padded, count(*) FILTER (WHERE contains({c}, '  ')) AS double_space, count(*) FILTER (WHERE length({c}) <> strlen({c})) AS non_ascii,
 count(*) FILTER (WHERE {c} = '') AS empty, count(DISTINCT {c}) AS distinct_raw, count(DISTINCT trim({c})) AS distinct_trimmed, count(DISTINCT lower(trim({c}))) AS distinct_lower FROM bills""" for c in _TEXT), "bills"))

# Q24 vocabularies
_voc = None
for _name, _a, _b2 in (("office", trips.agg({"v": "office"}), bills.agg({"v": "office"})), ("vendor", trips.agg({"v": "vendor_id"}), bills.agg({"v": "vendor"})),
                       ("rider", legs.where("stwid IS NOT NULL").agg({"v": "cast(stwid as string)"}), fb.where("stwid IS NOT NULL").agg({"v": "cast(stwid as string)"}))):
    for _side, _x, _y in (("first only", _a, _b2), ("second only", _b2, _a)):
        _p = _x.join(_y, "v", "anti").agg({"vocabulary": f"'{_name}'", "side": f"'{_side}'"}, n="count(*)", first_value="min(v)")
        _voc = _p if _voc is None else _voc.union(_p)
add("Q24_vocabulary_difference", _voc)

# Q25 what each defect touches
_DEFECTS = {"overhead": "is_overhead", "credits": "trip_cost < 0", "zero_distance": "zero_km AND billing_regime = 'DISTANCE_BASED'", "no_slab": "slab_name IS NULL", "zero_cost": "trip_cost = 0", "fixed_with_distance": "billing_regime = 'FIXED_RATE' AND total_trip_km > 0"}
_touch = bills.agg(ALL, **{f"n_{a}": f"NUM({c})" for a, c in _DEFECTS.items()}, **{f"m_{a}": f"sum(CASE WHEN {c} THEN abs(trip_cost) ELSE 0 END)" for a, c in _DEFECTS.items()}, gross="sum(abs(trip_cost))")
_touch = _touch.via(
    lambda df: df.select("gross", F.inline(F.array(*[F.struct(F.lit(a).alias("defect"), F.col(f"n_{a}").alias("n"), F.col(f"m_{a}").alias("money")) for a in _DEFECTS]))),
    "WITH w AS ({src}) " + " UNION ALL ".join(f"SELECT gross, '{a}' AS defect, n_{a} AS n, m_{a} AS money FROM w" for a in _DEFECTS))
add("Q25_defect_impact", _touch.cols("defect n", money="R(money, 4)", share="R(money / gross)"))
add("Q25_uncosted_trips", trips.cols("trip_id business_unit emp_actual").join(bills.where("trip_id IS NOT NULL").agg("trip_id"), "trip_id", "anti").agg("business_unit", trips="count(*)", riders="ISUM(emp_actual)"))

# Q26 which formula the delay field follows
_form = trips.where("actual_end_epoch IS NOT NULL AND delay_minutes < 1440").plus(end_dev=END_DEV, start_dev="((actual_start_epoch - planned_start_epoch) / 60)")
_fm = dict(n="count(*)", is_end_dev="R(RATE(abs(delay_minutes - end_dev) < 0.5))", is_late_end="R(RATE(abs(delay_minutes - greatest(end_dev, 0)) < 0.5))", is_start_dev="R(RATE(abs(delay_minutes - start_dev) < 0.5))", within_1="R(RATE(abs(delay_minutes - end_dev) <= 1))", corr_end="R(CORR(delay_minutes, end_dev))")
_form = _form.cols("month trip_direction delay_minutes end_dev start_dev")
add("Q26_delay_formula_direction", _form.agg("trip_direction", **_fm))
add("Q26_delay_formula_month", _form.agg("month", **_fm))

# Q27 feed outages
_feed = trips.cols("trip_id trip_date").join(fb.agg("trip_id").plus(answered="1"), "trip_id", "left").agg("trip_date", trips="count(*)", answered="NUM(answered = 1)").plus(coverage="answered / trips", weekday="WEEKDAY(trip_date)")
add("Q27_feed_outage_days", _feed.where("coverage < 0.3").cols("trip_date trips answered weekday", coverage="R(coverage)"))
add("Q27_weekday_baseline", _feed.agg("weekday", days="count(*)", coverage="R(sum(answered) / sum(trips))", low_days="NUM(coverage < 0.3)"))

# Q28 step change round a date
add("Q28_step_change", alerts.agg("event_type", before="NUM(alert_date < date '2024-01-15')", after="NUM(alert_date >= date '2024-01-15')").plus(ratio="R(after / nullif(before, 0))"))
add("Q28_weekly_series", alerts.agg("week event_type", n="count(*)"))
add("Q28_daily_series", alerts.where("alert_date BETWEEN date '2024-01-08' AND date '2024-01-22'").agg("alert_date", n="count(*)", errors="NUM(event_type = 'error')"))
add("Q28_every_day", alerts.agg("alert_date", n="count(*)", errors="NUM(event_type = 'error')"))

# Q29 clock offset per office: the hour the epoch shows against the hour the shift names
_clock = trips.where("shift_hour IS NOT NULL").plus(epoch_hour="IDIV(actual_start_epoch, 3600) % 24").plus(offset_hours="cast((epoch_hour - shift_hour + 36) % 24 - 12 as int)")
add("Q29_modal_offset", _clock.agg("office offset_hours", n="count(*)").plus(place="row_number() OVER (PARTITION BY office ORDER BY n DESC, offset_hours)").where("place = 1").cols("office offset_hours n"))
_OFFSETS = [-6, -5, -1, 0, 1, 5, 6]
_off_wide = trips.where("actual_end_epoch IS NOT NULL").agg("business_unit", **{f"o{i}": f"RATE(IDIV(actual_end_epoch + ({o}) * 3600, 86400) = IDIV(planned_start_epoch, 86400))" for i, o in enumerate(_OFFSETS)})
add("Q29_candidate_offsets", _off_wide.via(
    lambda df: df.select("business_unit", F.inline(F.array(*[F.struct(F.lit(o).alias("offset_hours"), F.round(F.col(f"o{i}"), 6).alias("same_date")) for i, o in enumerate(_OFFSETS)]))),
    "WITH w AS ({src}) " + " UNION ALL ".join(f"SELECT business_unit, {o} AS offset_hours, round(o{i}, 6) AS same_date FROM w" for i, o in enumerate(_OFFSETS))))

# Q30 planned = actual + no-show
add("Q30_identity", trips.agg("month", n="count(*)", holds="R(RATE(emp_planned = emp_actual + noshow))", residual="ISUM(emp_planned - emp_actual - noshow)"))
add("Q30_violations", trips.agg({"kind": "CASE WHEN emp_planned = emp_actual + noshow THEN 'holds' WHEN emp_planned < emp_actual + noshow THEN 'more than planned' ELSE 'fewer than planned' END"}, n="count(*)").plus(share="R(n / sum(n) OVER ())"))

# Q31 the same slab written differently (the spellings are derived from the line number)
_raw_slab = "CASE WHEN slab_name IS NULL THEN '' WHEN line_ref % 3 = 0 THEN lower(slab_name) WHEN line_ref % 3 = 1 THEN concat(' ', slab_name, ' - A') ELSE concat(slab_name, '-a') END"
_norm = "CASE WHEN RXR(RXR(upper(trim(raw)), ' *- *', '-'), ' +', ' ') = '' THEN 'UNLABELLED' ELSE RXR(RXR(upper(trim(raw)), ' *- *', '-'), ' +', ' ') END"
add("Q31_label_fragmentation", bills.plus(raw=_raw_slab).plus(label=_norm).agg("label", variants="count(DISTINCT raw)", spellings="LISTD(raw)", n="count(*)", money="R(sum(trip_cost), 4)").plus(fragmented="variants > 1"))

# Q32 published figures derived again from the typed views
_claims = [
    trips.agg({"claim": "'on-time rate'"}, value="R(avg(on_time))"), trips.agg({"claim": "'no-show rate'"}, value="R(sum(noshow) / sum(emp_planned))"), trips.agg({"claim": "'fill'"}, value="R(sum(emp_actual) / sum(cab_capacity))"),
    trips.where("delay_minutes > 0").agg({"claim": "'delay p90'"}, value="R(PCT(delay_minutes, 0.9))"), trips.where("shift_hour >= 20 OR shift_hour <= 5").agg({"claim": "'night escort'"}, value="R(RATE(coalesce(actual_escort, false)))"),
    bills.where("billing_regime = 'DISTANCE_BASED' AND trip_cost >= 0").agg({"claim": "'cost per km'"}, value="R(sum(trip_cost) / sum(total_trip_km))"), bills.where("trip_id IS NOT NULL").agg({"claim": "'cost per trip'"}, value="R(sum(trip_cost) / count(DISTINCT trip_id))"),
    bills.agg({"claim": "'credit share'"}, value="R(sum(CASE WHEN trip_cost < 0 THEN -trip_cost ELSE 0 END) / sum(CASE WHEN trip_cost >= 0 THEN trip_cost ELSE 0 END))"), alerts.agg({"claim": "'never acknowledged'"}, value="R(RATE(unacknowledged))"),
    alerts.agg({"claim": "'acknowledged in 15 min'"}, value="R(RATE(ack_minutes <= 15))"), legs.agg({"claim": "'boarding rate'"}, value="R(RATE(boarded))"), legs.where("boarded").agg({"claim": "'rider late rate'"}, value="R(RATE(late_minutes > 5))"),
    fb.agg({"claim": "'route rating'"}, value="R(avg(route_rating))"), fb.agg({"claim": "'detractors'"}, value="R(RATE(route_rating <= 2))"),
]
_re = _claims[0]
for _p in _claims[1:]:
    _re = _re.union(_p)
add("Q32_reverification", _re)
