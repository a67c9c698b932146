"""The five operational relations, derived from the generated star-schema tables.

Each relation is a lazy projection. Callers name the columns they need, so the parquet scan reads only the source
columns behind them, and the customer/nation/region join is added only when a geography column is asked for.
Money and distance are kept on a quarter-unit grid: such doubles add up exactly, in any order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Region names by key and nation naming follow the generated tables (fixed values).
REGION_NAMES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]

_EPOCH_DAY = "cast(datediff({d}, date'1970-01-01') as bigint) * 86400"



def _numbered(key: str, n: int, spelled: str, name) -> str:
    """``spelled``, which names the remainder of a key, taken from a constant list where there is one: text is costly to build for every row."""
    names = ", ".join(f"'{name(i)}'" for i in range(n))
    return f"if({key} >= 0, element_at(array({names}), cast({key} % {n} + 1 as int)), {spelled})"  # element_at is not null-safe


def _vendor(key: str) -> str:
    return _numbered(key, 23, f"concat('V', lpad(cast({key} % 23 as string), 2, '0'))", lambda i: f"V{i:02d}")


# First projection: straight from orders (and customer/nation/region for geography).
_TRIP_BASE = {
    "trip_id": "o_orderkey",
    "business_unit": "r_name",
    "office": "n_name",
    "product_type": "c_mktsegment",
    "vendor_id": _vendor("o_custkey"),
    "route_source": "o_orderstatus",
    "trip_direction": "if(o_orderkey % 2 = 0, 'LOGIN', 'LOGOUT')",
    "shift_type": (
        "if(o_orderkey % 53 = 0, 'Non Shift', concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', "
        "element_at(array('00', '30', '05'), cast((o_orderkey div 24) % 3 + 1 as int))))"
    ),
    "trip_nodal_raw": "case when o_orderkey % 7 = 0 then null when o_orderkey % 7 < 5 then 'HOME' else 'NODAL' end",
    "actual_cab_fuel_type": "element_at(array('CNG', 'DIESEL', 'EV', 'PETROL', 'CNG'), cast(o_orderkey % 5 + 1 as int))",
    "trip_date": "cast(o_orderdate as date)",
    "delay_minutes": (
        "case when o_orderkey % 211 = 0 then null "
        "when o_orderkey % 1013 = 0 then cast(1500 + o_orderkey % 500 as double) "
        "else cast(greatest(0, floor(o_totalprice) % 50 - 40) as double) end"
    ),
    "reason_code": "o_orderpriority",
    "planned_km": "5 + cast(o_orderkey % 40 as double) / 2",
    "actual_escort": "case when o_orderkey % 17 = 0 then null else o_orderkey % 3 = 0 end",
    "is_driver_nc": "case when o_orderkey % 307 = 0 then null else o_orderkey % 50 = 0 end",
    "is_cab_nc": "case when o_orderkey % 409 = 0 then null else o_orderkey % 70 = 0 end",
    "cab_capacity": "element_at(array(4, 4, 6, 12), cast(o_orderkey % 4 + 1 as int))",
    "emp_planned": "cast(1 + (o_orderkey div 3) % 4 as int)",
    "noshow": "cast(if((o_orderkey div 4) % 10 = 0, 1, 0) as int)",
    "_k": "o_orderkey",
}

# Second projection: columns built from the first one.
_TRIP_DERIVED = {
    "month": "trunc(trip_date, 'MM')",
    "quarter": "trunc(trip_date, 'QUARTER')",
    "trip_nodal": "coalesce(trip_nodal_raw, 'NA')",
    "on_time": "case when delay_minutes <= 5 then 1 else 0 end",
    "delay_reason": "if(delay_minutes = 0, 'NODELAY', reason_code)",
    "emp_actual": "cast(emp_planned - noshow + if(_k % 113 = 0, 1, 0) as int)",
    "traveled_km": "if(_k % 401 = 0, -1.0D, floor(planned_km * (90 + _k % 25) / 25) / 4)",
    "shift_hour": "cast(if(_k % 53 = 0, null, _k % 24) as int)",
    "planned_start_epoch": _EPOCH_DAY.format(d="trip_date") + " + (_k % 24) * 3600",
    "planned_end_epoch": _EPOCH_DAY.format(d="trip_date") + " + (_k % 24) * 3600 + (30 + _k % 60) * 60",
    "actual_start_epoch": _EPOCH_DAY.format(d="trip_date") + " + (_k % 24) * 3600 + ((_k * 7) % 21 - 8) * 60",
    "actual_end_epoch": (
        "if(_k % 97 = 0, null, " + _EPOCH_DAY.format(d="trip_date") + " + (_k % 24) * 3600 + (30 + _k % 60) * 60 "
        "+ case when delay_minutes > 0 then cast(delay_minutes as bigint) * 60 + (_k % 3 - 1) * 60 "
        "else if(_k % 31 = 0, 600, 0) - (_k % 5) * 60 end)"
    ),
}

_TRIP_NEEDS = {
    "month": ["trip_date"],
    "quarter": ["trip_date"],
    "trip_nodal": ["trip_nodal_raw"],
    "on_time": ["delay_minutes"],
    "delay_reason": ["delay_minutes", "reason_code"],
    "emp_actual": ["emp_planned", "noshow", "_k"],
    "traveled_km": ["planned_km", "_k"],
    "shift_hour": ["_k"],
    "planned_start_epoch": ["trip_date", "_k"],
    "planned_end_epoch": ["trip_date", "_k"],
    "actual_start_epoch": ["trip_date", "_k"],
    "actual_end_epoch": ["trip_date", "delay_minutes", "_k"],
}

TRIP_COLUMNS = [c for c in _TRIP_BASE if not c.startswith("_") and c not in ("trip_nodal_raw", "reason_code")] + list(
    _TRIP_DERIVED
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One source table. Time arithmetic below is wall-clock, so the session zone is pinned."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _project(df: DataFrame, base: dict[str, str], derived: dict[str, str], needs: dict[str, list[str]], cols) -> DataFrame:
    unknown = [c for c in cols if c not in base and c not in derived]
    if unknown:
        raise KeyError(f"unknown columns {unknown}")
    first = {c for c in cols if c in base} | {n for c in cols if c in derived for n in needs[c]}
    stage = df.select(*[F.expr(base[c]).alias(c) for c in base if c in first])
    return stage.select(*[F.col(c) if c in base else F.expr(derived[c]).alias(c) for c in cols])


def trips(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per order. ``trip_id`` is unique here; unit, office and product come from the customer."""
    cols = cols or tuple(TRIP_COLUMNS)
    df = table(spark, sf_dir, "orders")
    geo = {"business_unit", "office"} & set(cols)
    if geo or "product_type" in cols:
        df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if geo:
        df = df.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    if "business_unit" in cols:
        df = df.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _project(df, _TRIP_BASE, _TRIP_DERIVED, _TRIP_NEEDS, cols)


_LEG_BASE = {
    "trip_id": "l_orderkey",
    "leg_no": "l_linenumber",
    "rider_ref": "l_partkey",
    "leg_ref": "l_suppkey",
    "leg_amount": "l_extendedprice",
    "stwid": "nullif(if(l_partkey % 97 = 0, 0L, l_partkey), 0L)",
    "stwid_placeholder": "l_partkey % 97 = 0",
    "trip_date": "cast(l_shipdate as date)",
    "boarding_status": "if(l_returnflag = 'R', 'Not Boarded', 'Boarded')",
    "boarded": "l_returnflag <> 'R'",
    "is_no_show": "l_returnflag = 'R' and l_linestatus = 'O'",
    "not_boarding_reason": (
        "case when l_returnflag <> 'R' or l_suppkey % 13 = 0 then null else "
        "element_at(array('NO_SHOW', 'CANCELLED', 'SELF_TRAVEL', 'VEHICLE_ISSUE'), cast(l_suppkey % 4 + 1 as int)) end"
    ),
    "gender": "if(l_linestatus = 'F', 'F', 'M')",
    "emp_role": "if(l_partkey % 29 = 0, 'ESCORT', 'EMPLOYEE')",
    "signintype": "element_at(array('APP', 'OTP', 'IVR'), cast(l_suppkey % 3 + 1 as int))",
    "planned_km": "l_quantity / 2",
    "traveled_km": "if(l_partkey % 499 = 0, -6.5D, floor(l_quantity * (80 + l_suppkey % 50) / 40) / 4)",
    "late_minutes": "cast(l_quantity as bigint) - 20",
}
_LEG_DERIVED = {
    "month": "trunc(trip_date, 'MM')",
    "quarter": "trunc(trip_date, 'QUARTER')",
    "planned_pickup_epoch": _EPOCH_DAY.format(d="trip_date") + " + 28800 + leg_no * 300",
    "planned_drop_epoch": _EPOCH_DAY.format(d="trip_date") + " + 28800 + leg_no * 300 + 2400",
    "actual_pickup_epoch": "if(boarded, " + _EPOCH_DAY.format(d="trip_date") + " + 28800 + leg_no * 300 + late_minutes * 60, null)",
    "actual_drop_epoch": (
        "if(boarded, " + _EPOCH_DAY.format(d="trip_date")
        + " + 28800 + leg_no * 300 + late_minutes * 60 + 2400 + ((late_minutes + 20) % 7 - 3) * 60, null)"
    ),
}
_LEG_NEEDS = {
    "month": ["trip_date"],
    "quarter": ["trip_date"],
    "planned_pickup_epoch": ["trip_date", "leg_no"],
    "planned_drop_epoch": ["trip_date", "leg_no"],
    "actual_pickup_epoch": ["trip_date", "leg_no", "boarded", "late_minutes"],
    "actual_drop_epoch": ["trip_date", "leg_no", "boarded", "late_minutes"],
}


def legs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per rider leg (a line item). Line numbers repeat inside an order, so there is no natural key."""
    return _project(table(spark, sf_dir, "lineitem"), _LEG_BASE, _LEG_DERIVED, _LEG_NEEDS, cols or (*_LEG_BASE, *_LEG_DERIVED))


# Contracts billed at a fixed rate in this mapping, and the slab billed that way under any contract (fixed values).
FIXED_CONTRACTS = ["Brand#1", "Brand#2", "Brand#3"]
FIXED_SLABS = ["PROMO"]

_BILL_BASE = {
    "trip_id": "if(l_orderkey % 997 = 0, null, l_orderkey)",
    "trip_id_raw": "if(l_orderkey % 997 = 0, 'OverHead', cast(l_orderkey as string))",
    "is_overhead": "l_orderkey % 997 = 0",
    "vendor": _vendor("l_suppkey"),
    "office": _numbered("l_suppkey", 25, "concat('NATION_', l_suppkey % 25)", "NATION_{}".format),
    "business_unit": "element_at(array({}), cast(l_suppkey % 25 % 5 + 1 as int))".format(
        ", ".join(f"'{r}'" for r in REGION_NAMES)
    ),
    "contract": "p_brand",
    "slab_name": "if(l_partkey % 11 = 0 and l_partkey % 2 = 0, null, p_type)",
    "ship_date": "cast(l_shipdate as date)",
    "total_trip_km": "if(p_brand in ({}), 0.0D, l_quantity)".format(", ".join(f"'{c}'" for c in FIXED_CONTRACTS)),
    "trip_cost": (
        "floor(l_extendedprice * (1 - l_discount) * 4) / 4 * if(l_returnflag = 'R' and l_tax > 0.075D, -1, 1)"
        " * if(l_partkey % 883 = 0, 0, 1)"
    ),
    "line_ref": "l_linenumber",
}
_BILL_DERIVED = {
    "cycle_start": "if(dayofmonth(ship_date) < 16, trunc(ship_date, 'MM'), date_add(trunc(ship_date, 'MM'), 15))",
    "month": "trunc(ship_date, 'MM')",
    "quarter": "trunc(ship_date, 'QUARTER')",
    "billing_regime": "if(contract in ({}) or slab_name in ({}), 'FIXED_RATE', 'DISTANCE_BASED')".format(
        ", ".join(f"'{c}'" for c in FIXED_CONTRACTS), ", ".join(f"'{s}'" for s in FIXED_SLABS)
    ),
    "cost_per_km": (
        "case when contract not in ({}) and coalesce(slab_name not in ({}), true) and total_trip_km > 0 "
        "then trip_cost / total_trip_km end"
    ).format(", ".join(f"'{c}'" for c in FIXED_CONTRACTS), ", ".join(f"'{s}'" for s in FIXED_SLABS)),
    "zero_km": "total_trip_km = 0",
}
_BILL_NEEDS = {
    "cycle_start": ["ship_date"],
    "month": ["ship_date"],
    "quarter": ["ship_date"],
    "billing_regime": ["contract", "slab_name"],
    "cost_per_km": ["contract", "slab_name", "total_trip_km", "trip_cost"],
    "zero_km": ["total_trip_km"],
}
_BILL_PART = {"contract", "slab_name", "total_trip_km", "billing_regime", "cost_per_km", "zero_km"}


def bills(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per billing line. ``trip_id`` is null on overhead lines and repeats across lines of a trip."""
    cols = cols or (*_BILL_BASE, *_BILL_DERIVED)
    df = table(spark, sf_dir, "lineitem")
    if _BILL_PART & set(cols):
        df = df.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return _project(df, _BILL_BASE, _BILL_DERIVED, _BILL_NEEDS, cols)


_ALERT_BASE = {
    "trip_id": "event_id",
    "event_id": "event_id",
    "event_type": "event_type",
    "stwid": "nullif(user_id, 0L)",
    "stwid_placeholder": "user_id = 0",
    "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)",
    "start_time": "ts",
    "acknowledge_time": (
        "case when event_type = 'error' and value > 150 then null "
        "else ts + make_dt_interval(0, 0, 0, cast(floor(value * 60) as decimal(18, 6))) end"
    ),
}
_ALERT_DERIVED = {
    "severity": "case when k < 30 then 'Sev-1' when k < 60 then 'Sev-2' when k < 90 then 'Sev-3' end",
    "severity_raw": "case when k < 30 then 'Sev-1' when k < 60 then 'Sev-2' when k < 90 then 'Sev-3' when k < 95 then 'False' else 'NA' end",
    "source": "if(event_id % 2 = 0, 'APP', 'DEVICE')",
    "state_text": "case when acknowledge_time is null then 'OPEN' when k % 3 = 0 then 'ACKNOWLEDGED' else 'CLOSED' end",
    "alert_date": "cast(start_time as date)",
    "week": "cast(date_trunc('WEEK', start_time) as date)",
    "alert_hour": "hour(start_time)",
    "ack_minutes": (
        "timestampdiff(MINUTE, date_trunc('MINUTE', start_time), date_trunc('MINUTE', acknowledge_time))"
    ),
    "unacknowledged": "acknowledge_time is null",
}
_ALERT_NEEDS = {
    "severity": ["k"],
    "severity_raw": ["k"],
    "source": ["event_id"],
    "state_text": ["k", "acknowledge_time"],
    "alert_date": ["start_time"],
    "week": ["start_time"],
    "alert_hour": ["start_time"],
    "ack_minutes": ["start_time", "acknowledge_time"],
    "unacknowledged": ["acknowledge_time"],
}


def alerts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per event, joined to trips where the id exists."""
    return _project(
        table(spark, sf_dir, "events"), _ALERT_BASE, _ALERT_DERIVED, _ALERT_NEEDS, cols or (*_ALERT_BASE, *_ALERT_DERIVED)
    )


_RATINGS = {
    "route": "cast(o_orderkey % 6 as int)",
    "driver": "cast((o_orderkey div 6) % 6 as int)",
    "cab": "cast((o_orderkey div 36) % 6 as int)",
    "safety": "cast((o_orderkey div 7) % 6 as int)",
    "marshal": "cast(if(o_orderkey % 10 < 8, 0, 1 + o_orderkey % 5) as int)",
}
_FB_BASE = {
    "trip_id": "o_orderkey",
    "stwid": "nullif(o_custkey % 500, 0L)",
    "stwid_placeholder": "o_custkey % 500 = 0",
    "trip_type": "if(o_orderkey % 2 = 0, 'LOGIN', 'LOGOUT')",
    "trip_date": "cast(o_orderdate as date)",
    "lag_minutes": "(o_orderkey % 72) * 60 + o_orderkey % 60",
    **{f"{n}_raw": e for n, e in _RATINGS.items()},
    **{f"{n}_rating": f"nullif({e}, 0)" for n, e in _RATINGS.items()},
}
_PARTS = ["route", "driver", "cab", "safety"]
_FB_DERIVED = {
    "month": "trunc(trip_date, 'MM')",
    "quarter": "trunc(trip_date, 'QUARTER')",
    "avg_rating": "({}) / cast(nullif({}, 0) as double)".format(
        " + ".join(f"coalesce({p}_rating, 0)" for p in _PARTS),
        " + ".join(f"if({p}_rating is null, 0, 1)" for p in _PARTS),
    ),
}
_FB_NEEDS = {"month": ["trip_date"], "quarter": ["trip_date"], "avg_rating": [f"{p}_rating" for p in _PARTS]}


def feedback(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """One row per rated trip; two orders in three carry a rating. ``*_raw`` keeps the zero, ``*_rating`` nulls it."""
    df = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0")
    return _project(df, _FB_BASE, _FB_DERIVED, _FB_NEEDS, cols or (*_FB_BASE, *_FB_DERIVED))
