"""Extract loading and typing, checked on text extracts derived from the generated tables.

The text carries the defects the parsers exist for: thousands commas, long dates, float epochs, placeholder ids, unknown
flags, text nulls, a column missing from one file. Expected values come straight from the tables.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.functions import parse as P
from tripscope.operators import quality as Q
from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.session import input_mark, shared_dir
from tripscope.sources import extracts, quoted, roles

BOOK = Book()
FILES = ("may", "jun", "jul")
_FILE = "CASE (month(trip_date) - 1) % 3 WHEN 0 THEN 'may' WHEN 1 THEN 'jun' ELSE 'jul' END"
_STAMP = P.LONG_TIMESTAMP


def _e(**exprs: str) -> list:
    return [F.expr(e).alias(a) for a, e in exprs.items()]


def ride_text(spark: SparkSession, sf: str) -> DataFrame:
    t = roles.trips(spark, sf)
    return t.select(
        *_e(
            src=_FILE, business_unit="business_unit", office="office", product_type="product_type", vendor_id="vendor_id", shift_type="shift_type",
            trip_direction="trip_direction", trip_nodal="nullif(trip_nodal, 'NA')", delay_reason="delay_reason", route_source="route_source",
            actual_cab_fuel_type="actual_cab_fuel_type", trip_id="format_number(trip_id, 0)", trip_date=f"date_format(trip_date, '{P.LONG_DATE}')",
            delay_minutes="format_number(cast(delay_minutes as bigint), 0)", planned_end_epoch="cast(planned_end_epoch as string)",
            actual_end_epoch="cast(actual_end_epoch as string)",
            planned_km=f"if({_FILE} = 'jul' and trip_id % 100 = 0, concat('1,', cast(cast(planned_km as int) as string)), cast(planned_km as string))",
            traveled_km="cast(traveled_km as string)", actual_escort="cast(actual_escort as string)",
            is_driver_nc="if(is_driver_nc is null, 'x', cast(is_driver_nc as string))", is_cab_nc="cast(is_cab_nc as string)",
            actual_cab_capacity="cast(cab_capacity as string)", plannedemployee_cnt="cast(emp_planned as string)",
            actualemployee_cnt="concat(emp_actual, '.0')", noshow_cnt="cast(noshow as string)",
        )
    )


_FIXED = "('Brand#1', 'Brand#2', 'Brand#3')"


def bill_text(spark: SparkSession, sf: str) -> DataFrame:
    return roles.bills(spark, sf).select(
        *_e(
            business_unit="business_unit", office="office", vendor="vendor", cycle_start=f"date_format(cycle_start, '{_STAMP}')",
            cycle_end=f"date_format(date_add(cycle_start, 14), '{_STAMP}')", trip_id="if(trip_id is null, 'OverHead', format_number(trip_id, 0))",
            contract=f"if(contract in {_FIXED}, concat(' ', contract, '-HYD'), contract)", slab_name="coalesce(if(slab_name = 'PROMO', 'Short', slab_name), 'null')",
            total_trip_km="cast(total_trip_km as string)", trip_cost="format_number(trip_cost, 2)",
        )
    )


def alert_text(spark: SparkSession, sf: str) -> DataFrame:
    return roles.alerts(spark, sf).select(
        *_e(
            business_unit="concat('U', trip_id % 5)", trip_id="format_number(trip_id, 0)", stwid="coalesce(cast(stwid as string), '0')", event_id="cast(event_id as string)",
            event_type="event_type", start_time=f"date_format(start_time, '{_STAMP}')", acknowledge_time=f"date_format(acknowledge_time, '{_STAMP}')",
            state_text="state_text", severity="severity_raw", source="source",
        )
    )


def emp_text(spark: SparkSession, sf: str) -> DataFrame:
    return roles.legs(spark, sf).select(
        *_e(
            business_unit="concat('U', trip_id % 5)", office="concat('O', trip_id % 7)", product_type="'CAB'", shift_type="'09:00'", trip_id="format_number(trip_id, 0)",
            trip_date="cast(trip_date as string)", stwid="coalesce(cast(stwid as string), '0')",
            **{c: f"concat({c}, '.0')" for c in ("planned_pickup_epoch", "planned_drop_epoch", "actual_pickup_epoch", "actual_drop_epoch")},
            planned_km="cast(planned_km as string)", traveled_km="cast(traveled_km as string)", signintype="signintype", gender="gender", emp_role="emp_role",
            boarding_status="boarding_status", not_boarding_reason="coalesce(not_boarding_reason, ' ')", is_no_show="cast(is_no_show as string)",
        )
    )


def feedback_text(spark: SparkSession, sf: str) -> DataFrame:
    return roles.feedback(spark, sf).select(
        *_e(
            business_unit="concat('U', trip_id % 5)", trip_id="format_number(trip_id, 0)", trip_type="trip_type", trip_date=f"date_format(cast(trip_date as timestamp) + interval 11 hours, '{_STAMP}')",
            stwid="coalesce(cast(stwid as string), '0')", **{f"{n}_rating": f"cast({n}_raw as string)" for n in ("route", "driver", "cab", "safety", "marshal")},
            creation_time=f"date_format(cast(trip_date as timestamp) + make_dt_interval(0, 0, cast(lag_minutes as int), 0), '{_STAMP}')",
        )
    )


_WRITTEN: dict[tuple, str] = {}
#: Compressed files are read whole by one task, so their rows are bounded.
EXTRACT_ROWS = 250_000


def _write_text(text: DataFrame, path: str, **options) -> None:
    """Text of a relation as compressed CSV files: uncompressed it takes several times the bytes of its table."""
    out = text.write.mode("overwrite").option("header", True).option("escape", '"').options(**options)
    out.option("compression", "gzip").option("maxRecordsPerFile", EXTRACT_ROWS).csv(path)


def extract_path(spark: SparkSession, sf: str, name: str) -> str:
    """The relation's text extract as CSV in the shared folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf, name, input_mark(spark, sf))
    if key not in _WRITTEN:
        root = f"{shared_dir(spark)}/extracts-{key[0]}-{zlib.crc32(repr(key[3]).encode()):08x}/{sf.strip('/').replace('/', '_')}/{name}"
        if name == "trips":
            text = ride_text(spark, sf)
            for f in FILES:
                _write_text(text.filter(F.col("src") == f).drop("src", *(["actual_cab_fuel_type"] if f == "jul" else [])), f"{root}/ride_{f}.csv")
        else:
            maker = {"bills": bill_text, "alerts": alert_text, "emp": emp_text, "feedback": feedback_text}[name]
            _write_text(maker(spark, sf), f"{root}.csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        _WRITTEN[key] = root
    return _WRITTEN[key]


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = extract_path(spark, sf, name)
    if name == "trips":
        return extracts.read_extracts(spark, [f"{path}/ride_{f}.csv" for f in FILES], r"ride_(\w+)\.csv")
    return extracts.read_extract(spark, f"{path}.csv")


def typed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return extracts.TYPED[name](raw(spark, sf, name))


# --- S: scans, tags, conservation ----------------------------------------------------------------------------------

_TRIP_OUT = (
    "trip_id business_unit office product_type vendor_id trip_direction shift_type trip_nodal delay_reason actual_cab_fuel_type route_source trip_date month "
    "delay_minutes planned_end_epoch actual_end_epoch planned_km traveled_km actual_escort is_driver_nc is_cab_nc cab_capacity emp_planned emp_actual noshow on_time"
).split()
_trip_fix = {"actual_cab_fuel_type": f"CASE WHEN {_FILE} <> 'jul' THEN actual_cab_fuel_type END", "planned_km": f"CASE WHEN {_FILE} = 'jul' AND trip_id % 100 = 0 THEN NULL ELSE planned_km END"}
BOOK.add("S1_multi_file_scan", lambda spark, sf: typed(spark, sf, "trips").select(*_TRIP_OUT, "src_month"),
         with_roles(f"SELECT {', '.join(f'{_trip_fix[c]} AS {c}' if c in _trip_fix else c for c in _TRIP_OUT)}, {_FILE} AS src_month FROM trips", "trips"))
_BILL_OUT = "trip_id is_overhead business_unit office vendor contract slab_name cycle_start cycle_end month total_trip_km trip_cost billing_regime cost_per_km zero_km".split()
_bill_fix = {"contract": f"CASE WHEN contract IN {_FIXED} THEN contract || '-HYD' ELSE contract END", "slab_name": "CASE WHEN slab_name = 'PROMO' THEN 'Short' ELSE slab_name END",
             "cycle_end": "cycle_start + 14", "month": "CAST(date_trunc('month', cycle_start) AS DATE)"}
BOOK.add("S2_bill_scan", lambda spark, sf: typed(spark, sf, "bills").select(*_BILL_OUT),
         with_roles(f"SELECT {', '.join(f'{_bill_fix[c]} AS {c}' if c in _bill_fix else c for c in _BILL_OUT)} FROM bills", "bills"))
_ALERT_OUT = "trip_id event_type state_text source stwid stwid_placeholder severity severity_raw alert_date ack_minutes unacknowledged".split()
BOOK.add("S2_alert_scan", lambda spark, sf: typed(spark, sf, "alerts").select(*_ALERT_OUT), with_roles(f"SELECT {', '.join(_ALERT_OUT)} FROM alerts", "alerts"))
_EMP_OUT = ("trip_id trip_date month stwid stwid_placeholder planned_pickup_epoch planned_drop_epoch actual_pickup_epoch actual_drop_epoch planned_km traveled_km signintype gender emp_role "
            "boarding_status not_boarding_reason is_no_show boarded").split()
BOOK.add("S2_emp_scan", lambda spark, sf: typed(spark, sf, "emp").select(*_EMP_OUT, "km_negative", "incomplete_leg"),
         with_roles(f"SELECT {', '.join(_EMP_OUT)}, planned_km < 0 OR traveled_km < 0 AS km_negative, actual_pickup_epoch IS NULL OR actual_drop_epoch IS NULL AS incomplete_leg FROM legs", "legs"))
_FB_OUT = "trip_id trip_type stwid stwid_placeholder trip_date month route_rating driver_rating cab_rating safety_rating marshal_rating".split()
BOOK.add("S2_feedback_scan", lambda spark, sf: typed(spark, sf, "feedback").select(*_FB_OUT, F.round("avg_rating", 6).alias("avg_rating"), F.unix_seconds("creation_time").alias("created")),
         with_roles(f"SELECT {', '.join(_FB_OUT)}, round(avg_rating, 6) AS avg_rating, CAST(trip_date - DATE '1970-01-01' AS BIGINT) * 86400 + lag_minutes * 60 AS created FROM feedback", "feedback"))
BOOK.add("S3_file_tag", lambda spark, sf: raw(spark, sf, "trips").groupBy("src_month").agg(F.count("*").alias("n"), F.count("actual_cab_fuel_type").alias("with_fuel")),
         with_roles(f"SELECT {_FILE} AS src_month, count(*) AS n, count(CASE WHEN {_FILE} <> 'jul' THEN 1 END) AS with_fuel FROM trips GROUP BY 1", "trips"))


def _quoted(spark, sf):
    """Remarks with line breaks and quotes inside, written as one CSV and read back by quote parity."""
    path = f"{extract_path(spark, sf, 'feedback')}-remarks.csv"
    said = roles.feedback(spark, sf, "trip_id", "driver_raw", "route_raw").select(*_e(
        trip_id="cast(trip_id as string)", remark="concat('driver \"', driver_raw, '\"', chr(10), 'route ', route_raw, if(trip_id % 5 = 0, concat(chr(10), chr(10), ', and more'), ''))"))
    said.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return quoted.read_quoted(spark, [path]).select(F.col("trip_id").cast("bigint").alias("trip_id"), "remark")


BOOK.add("S2_quoted_line_breaks", _quoted, with_roles(
    """SELECT trip_id, 'driver "' || driver_raw || '"' || chr(10) || 'route ' || route_raw || CASE WHEN trip_id % 5 = 0 THEN chr(10) || chr(10) || ', and more' ELSE '' END AS remark FROM feedback""", "feedback"))


def _conserved(spark, sf):
    """Loads all five relations; the report has what each load counted."""
    accounts = []
    for n in extracts.RELATIONS:
        root = extract_path(spark, sf, n)
        paths = [f"{root}/ride_{f}.csv" for f in FILES] if n == "trips" else [f"{root}.csv"]
        accounts.append(extracts.load(spark, n, paths, f"{root}-loaded")[1])
    return extracts.conservation(spark, accounts)


BOOK.add("S5_row_conservation", _conserved, with_roles(
    " UNION ALL ".join(f"SELECT '{n}' AS relation, count(*) AS lines, count(*) AS parsed, count(*) AS kept, count(*) AS written, true AS conserved FROM {t}" for n, t in zip(extracts.RELATIONS, ("trips", "bills", "alerts", "legs", "feedback"))),
    "trips", "bills", "alerts", "legs", "feedback"))


def _published(spark, sf):
    out = extracts.publish(typed(spark, sf, "trips"), "trips", f"{extract_path(spark, sf, 'trips')}-parquet")
    return out.groupBy("month").agg(F.count("*").alias("n"), F.sum("on_time").alias("on_time"))


BOOK.add("S4_materialised_by_month", _published, with_roles("SELECT month, count(*) AS n, CAST(sum(on_time) AS BIGINT) AS on_time FROM trips GROUP BY 1", "trips"))

# Q21 drift between the files
_HINTS = {"planned_km": "double", "is_driver_nc": "boolean", "trip_id": "bigint", "delay_minutes": "double", "actualemployee_cnt": "int"}


def _drift_sql() -> str:
    text = {
        "planned_km": (f"CASE WHEN {_FILE} = 'jul' AND trip_id % 100 = 0 THEN '1,' || CAST(trunc(planned_km) AS INTEGER) ELSE CAST(planned_km AS VARCHAR) END", "DOUBLE"),
        "is_driver_nc": ("CASE WHEN is_driver_nc IS NULL THEN 'x' ELSE CAST(is_driver_nc AS VARCHAR) END", "BOOLEAN"), "trip_id": ("format('{:,}', trip_id)", "BIGINT"),
        "delay_minutes": ("format('{:,}', CAST(delay_minutes AS BIGINT))", "DOUBLE"), "actualemployee_cnt": ("emp_actual || '.0'", None),
    }
    return " UNION ALL ".join(
        f"""SELECT src_month, '{c}' AS "column", count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS nulls, """
        + (f"count(*) FILTER (WHERE v IS NOT NULL AND TRY_CAST(v AS {t}) IS NULL)" if t else "count(v)")
        + f" AS cast_failures, count(*) FILTER (WHERE contains(v, ',')) AS with_comma, count(*) FILTER (WHERE contains(v, '.')) AS with_dot FROM (SELECT {_FILE} AS src_month, {e} AS v FROM trips) GROUP BY 1"
        for c, (e, t) in text.items())


BOOK.add("Q21_schema_drift", lambda spark, sf: Q.schema_drift(raw(spark, sf, "trips"), "src_month", _HINTS), with_roles(_drift_sql(), "trips"))

# --- P: typing expressions on derived text --------------------------------------------------------------------------


def parsed(name: str, text, columns: dict, sql: str, role: str) -> None:
    BOOK.add(name, lambda spark, sf: text(spark, sf).select(*[c.alias(a) for a, c in columns().items()]), with_roles(sql, role))


c = F.col
parsed("P1_comma_numbers", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "delay_minutes": P.comma_double(c("delay_minutes"))}, "SELECT trip_id, delay_minutes FROM trips", "trips")
parsed("P2_float_epoch", emp_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "actual_drop_epoch": P.float_epoch(c("actual_drop_epoch")), "direct": c("actual_drop_epoch").try_cast("bigint")},
       "SELECT trip_id, actual_drop_epoch, CAST(NULL AS BIGINT) AS direct FROM legs", "legs")
parsed("P3_long_date", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "trip_date": P.long_date(c("trip_date")), "unreadable": P.long_date(c("delay_reason"))},
       "SELECT trip_id, trip_date, CAST(NULL AS DATE) AS unreadable FROM trips", "trips")
parsed("P4_long_timestamp", feedback_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "created": F.unix_seconds(P.long_timestamp(c("creation_time")))},
       "SELECT trip_id, CAST(trip_date - DATE '1970-01-01' AS BIGINT) * 86400 + lag_minutes * 60 AS created FROM feedback", "feedback")
parsed("P5_iso_date", emp_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "trip_date": P.iso_date(c("trip_date")), "unreadable": P.iso_date(c("gender"))},
       "SELECT trip_id, trip_date, CAST(NULL AS DATE) AS unreadable FROM legs", "legs")
parsed("P6_three_valued_boolean", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "is_driver_nc": P.boolean3(c("is_driver_nc")), "is_cab_nc": P.boolean3(c("is_cab_nc"))},
       "SELECT trip_id, is_driver_nc, is_cab_nc FROM trips", "trips")
parsed("P7_text_nulls", bill_text, lambda: {"slab_name": P.text_or_null(c("slab_name")), "contract": P.text_or_null(c("contract"))},
       f"SELECT {_bill_fix['slab_name']} AS slab_name, {_bill_fix['contract']} AS contract FROM bills", "bills")
parsed("P8_placeholder_id", emp_text, lambda: {"stwid": P.rider_id(c("stwid"))[0], "placeholder": P.rider_id(c("stwid"))[1]}, "SELECT stwid, stwid_placeholder AS placeholder FROM legs", "legs")
parsed("P9_severity", alert_text, lambda: {"event_id": P.comma_long(c("event_id")), "severity": P.severity(c("severity"))[0], "severity_raw": P.severity(c("severity"))[1]}, "SELECT event_id, severity, severity_raw FROM alerts", "alerts")
parsed("P10_zero_rating", feedback_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "route": P.rating(c("route_rating")), "marshal": P.rating(c("marshal_rating"))}, "SELECT trip_id, route_rating AS route, marshal_rating AS marshal FROM feedback", "feedback")
parsed("P11_na_category", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "trip_nodal": P.na_category(c("trip_nodal"))}, "SELECT trip_id, trip_nodal FROM trips", "trips")
parsed("P12_row_average", feedback_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "avg_rating": F.round(P.row_average([P.rating(c(f"{n}_rating")) for n in ("route", "driver", "cab", "safety")]), 6)},
       "SELECT trip_id, round(avg_rating, 6) AS avg_rating FROM feedback", "feedback")
parsed("P13_billing_regime", bill_text, lambda: {"contract": F.trim(c("contract")), "slab_name": P.text_or_null(c("slab_name")), "regime": P.billing_regime(c("contract"), c("slab_name"))},
       f"SELECT {_bill_fix['contract']} AS contract, {_bill_fix['slab_name']} AS slab_name, billing_regime AS regime FROM bills", "bills")
parsed("P14_unit_cost", bill_text, lambda: {"cost": P.comma_double(c("trip_cost")), "km": P.comma_double(c("total_trip_km")), "unit": F.round(P.unit_cost(P.billing_regime(c("contract"), c("slab_name")), P.comma_double(c("trip_cost")), P.comma_double(c("total_trip_km"))), 6)},
       "SELECT trip_cost AS cost, total_trip_km AS km, round(cost_per_km, 6) AS unit FROM bills", "bills")
parsed("P15_ack_minutes", alert_text, lambda: {"event_id": P.comma_long(c("event_id")), "ack_minutes": P.ack_minutes(P.long_timestamp(c("start_time")), P.long_timestamp(c("acknowledge_time")))}, "SELECT event_id, ack_minutes FROM alerts", "alerts")
parsed("P16_on_time", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "on_time": P.on_time(P.comma_double(c("delay_minutes"))), "on_time_known": P.on_time_known(P.comma_double(c("delay_minutes")))},
       "SELECT trip_id, on_time, CASE WHEN delay_minutes IS NOT NULL THEN on_time END AS on_time_known FROM trips", "trips")
parsed("P17_shift_band", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), "shift_hour": P.shift_hour(c("shift_type")), "band": P.shift_band(P.shift_hour(c("shift_type")))},
       "SELECT trip_id, shift_hour, CASE WHEN shift_hour IS NULL THEN 'none' WHEN shift_hour >= 21 OR shift_hour <= 5 THEN 'night' WHEN shift_hour <= 11 THEN 'morning' WHEN shift_hour <= 16 THEN 'day' ELSE 'evening' END AS band FROM trips", "trips")
parsed("P18_night_predicate", ride_text, lambda: {"trip_id": P.comma_long(c("trip_id")), **{f"night_{a}": P.is_night(P.shift_hour(c("shift_type")), a) for a in (19, 20, 21)}},
       "SELECT trip_id, shift_hour >= 19 OR shift_hour <= 5 AS night_19, shift_hour >= 20 OR shift_hour <= 5 AS night_20, shift_hour >= 21 OR shift_hour <= 5 AS night_21 FROM trips", "trips")
BOOK.add("P19_cycle_label", lambda spark, sf: bill_text(spark, sf).select(P.cycle_label(P.long_timestamp(c("cycle_start"))).alias("cycle")).groupBy("cycle").agg(F.count("*").alias("n")),
         with_roles("SELECT strftime(cycle_start, '%Y-%m') || CASE WHEN day(cycle_start) = 1 THEN '-A' ELSE '-B' END AS cycle, count(*) AS n FROM bills GROUP BY 1", "bills"))
BOOK.add("P20_slab_label", lambda spark, sf: roles.bills(spark, sf, "slab_name", "line_ref").select(
    P.slab_label(F.expr("CASE WHEN slab_name IS NULL THEN ' ' WHEN line_ref % 2 = 0 THEN concat(' ', lower(slab_name), '  -  a') ELSE concat(slab_name, '-A ') END")).alias("label")).groupBy("label").agg(F.count("*").alias("n")),
    with_roles("SELECT CASE WHEN slab_name IS NULL THEN 'UNLABELLED' ELSE slab_name || '-A' END AS label, count(*) AS n FROM bills GROUP BY 1", "bills"))
BOOK.add("P21_local_hour", lambda spark, sf: roles.trips(spark, sf, "planned_start_epoch").select(P.local_hour(c("planned_start_epoch"), 5).alias("local_hour")).groupBy("local_hour").agg(F.count("*").alias("n")),
         with_roles("SELECT CAST((planned_start_epoch - 5 * 3600) // 3600 % 24 AS INTEGER) AS local_hour, count(*) AS n FROM trips GROUP BY 1", "trips"))

# --- odd text: each row gets one of a few spellings, read by both sides from the same strings ------------------------

_ODD_NUMBERS = ["12.7", "1783633500.0", "1,097,076", "9007199254740993", "x", "-3.5", ""]
_ODD_DATES = ["2026", "2026-06", "2026-06-01", " 2026-06-02 ", "2026-13-01", "n/a"]


def _spelled(spark, sf, options):
    pick = F.element_at(F.array(*[F.lit(o) for o in options]), (F.col("trip_id") % len(options) + 1).cast("int"))
    return roles.trips(spark, sf, "trip_id").select("trip_id", pick.alias("text"))


def _spelled_sql(options) -> str:
    return f"(SELECT trip_id, [{', '.join(chr(39) + o + chr(39) for o in options)}][CAST(trip_id % {len(options)} + 1 AS INTEGER)] AS text FROM trips)"


BOOK.add("P1_odd_numbers", lambda spark, sf: _spelled(spark, sf, _ODD_NUMBERS).select("trip_id", P.comma_long(F.col("text")).alias("whole"), P.comma_double(F.col("text")).alias("number")), with_roles(
    f"SELECT trip_id, CAST(round(TRY_CAST(replace(text, ',', '') AS DECIMAL(38, 6)), 0) AS BIGINT) AS whole, TRY_CAST(replace(text, ',', '') AS DOUBLE) AS number FROM {_spelled_sql(_ODD_NUMBERS)}", "trips"))
BOOK.add("P5_odd_dates", lambda spark, sf: _spelled(spark, sf, _ODD_DATES).select("trip_id", P.iso_date(F.col("text")).alias("day")), with_roles(
    f"SELECT trip_id, CASE WHEN length(trim(text)) = 10 THEN TRY_CAST(trim(text) AS DATE) END AS day FROM {_spelled_sql(_ODD_DATES)}", "trips"))
