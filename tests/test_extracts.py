import datetime as dt

import pytest
from pyspark.sql import functions as F

from tripscope.operators import quality as Q
from tripscope.sources import extracts as X

RIDE = ("business_unit office product_type trip_date shift_type trip_id trip_direction actual_escort vendor_id actual_cab_capacity planned_km traveled_km planned_end_epoch "
        "actual_end_epoch delay_reason delay_minutes route_source actual_cab_fuel_type is_driver_nc is_cab_nc trip_nodal plannedemployee_cnt actualemployee_cnt noshow_cnt").split()
RIDE_ROW = dict(business_unit="U", office="O", product_type="CAB", trip_date='"May 1, 2026"', shift_type="22:00", trip_id='"1,097,076"', trip_direction="LOGIN", actual_escort="true", vendor_id="V",
                actual_cab_capacity="4", planned_km="12.5", traveled_km="13", planned_end_epoch="1783633500", actual_end_epoch="", delay_reason="X", delay_minutes='"10,644"', route_source="AUTO",
                actual_cab_fuel_type="EV", is_driver_nc="x", is_cab_nc="false", trip_nodal="", plannedemployee_cnt="3", actualemployee_cnt="2", noshow_cnt="1")


def write(path, columns, rows):
    path.write_text("\n".join([",".join(columns)] + [",".join(str(r.get(c, "")) for c in columns) for r in rows]) + "\n")
    return str(path)


def test_ride_defects_and_missing_column(spark, tmp_path):
    may = write(tmp_path / "ride-may_2026.csv", RIDE, [RIDE_ROW, {**RIDE_ROW, "delay_minutes": "", "trip_id": "oops"}])
    fewer = [c for c in RIDE if c != "trip_nodal"]
    jul = write(tmp_path / "ride-jul_2026.csv", fewer, [{**RIDE_ROW, "planned_km": '"1,234"', "delay_minutes": "3", "trip_date": "not a date"}])
    raw = X.read_extracts(spark, [may, jul], r"ride-(\w+)_2026")
    rows = X.typed_trips(raw).orderBy("src_month", F.col("delay_minutes").desc()).collect()
    assert [r.src_month for r in rows] == ["jul", "may", "may"]
    jul_row, may_row, bad = rows
    assert may_row.trip_id == 1097076 and may_row.trip_date == dt.date(2026, 5, 1) and may_row.month == dt.date(2026, 5, 1)
    assert may_row.delay_minutes == 10644.0 and may_row.on_time == 0 and may_row.is_driver_nc is None and may_row.is_cab_nc is False
    assert may_row.trip_nodal == "NA" and may_row.actual_end_epoch is None
    assert bad.delay_minutes is None and bad.on_time == 0 and bad.trip_id is None
    assert jul_row.planned_km is None and jul_row.trip_date is None and jul_row.trip_nodal == "NA" and jul_row.on_time == 1
    out, account = X.load(spark, "trips", [may, jul], str(tmp_path / "trips"), r"ride-(\w+)_2026")
    assert tuple(account) == ("trips", 3, 3, 3, 3) and out.count() == 3
    X.assert_conserved([account])
    drift = {(r.src_month, r.column): r for r in Q.schema_drift(raw, "src_month", {"planned_km": "double", "trip_nodal": "int"}).collect()}
    assert drift["jul", "planned_km"].cast_failures == 1 and drift["jul", "planned_km"].with_comma == 1 and drift["jul", "trip_nodal"].nulls == 1


def test_short_rows_are_padded(spark, tmp_path):
    p = tmp_path / "short.csv"
    p.write_text("a,b,c\n1,2\n3,4,5\n")
    assert [tuple(r) for r in X.read_extract(spark, str(p)).orderBy("a").collect()] == [("1", "2", None), ("3", "4", "5")]


def test_bill_defects(spark, tmp_path):
    cols = "business_unit office vendor cycle_start cycle_end trip_id contract slab_name total_trip_km trip_cost".split()
    base = dict(business_unit="U", office="O", vendor="V", cycle_start='"May 1, 2026, 12:00 AM"', cycle_end='"May 15, 2026, 11:59 PM"')
    path = write(tmp_path / "bill.csv", cols, [
        {**base, "trip_id": "OverHead", "contract": "6S-A", "slab_name": "null", "total_trip_km": "10", "trip_cost": '"1,200"'},
        {**base, "trip_id": "7", "contract": "4S-HYD", "slab_name": "S", "total_trip_km": "0", "trip_cost": '"-2,233,332.99"'},
        {**base, "trip_id": "8", "contract": "", "slab_name": "Medium", "total_trip_km": "5", "trip_cost": "50"},
        {**base, "trip_id": "9", "contract": "", "slab_name": "", "total_trip_km": "5", "trip_cost": "50"}])
    over, hyd, slab, plain = X.typed_bills(X.read_extract(spark, path)).orderBy(F.col("trip_id").asc_nulls_first()).collect()
    assert over.trip_id is None and over.is_overhead and over.trip_id_raw == "OverHead" and over.trip_cost == 1200.0 and over.slab_name is None and over.cost_per_km == 120.0
    assert hyd.trip_cost == -2233332.99 and hyd.billing_regime == "FIXED_RATE" and hyd.cost_per_km is None and hyd.zero_km
    assert slab.billing_regime == "FIXED_RATE" and plain.billing_regime == "DISTANCE_BASED" and plain.cost_per_km == 10.0
    assert over.cycle_start == dt.date(2026, 5, 1) and over.cycle_end == dt.date(2026, 5, 15)


def test_alert_defects(spark, tmp_path):
    cols = "business_unit trip_id stwid event_id event_type start_time acknowledge_time state_text severity source".split()
    base = dict(business_unit="U", trip_id="1", event_type="SOS", state_text="OPEN", source="APP", start_time='"June 3, 2026, 11:58 PM"')
    path = write(tmp_path / "alerts.csv", cols, [
        {**base, "event_id": "1", "stwid": "0", "severity": "False", "acknowledge_time": ""}, {**base, "event_id": "2", "stwid": '"1,001"', "severity": "Sev-1", "acknowledge_time": '"June 4, 2026, 12:03 AM"'},
        {**base, "event_id": "3", "stwid": "", "severity": "NA", "acknowledge_time": "bad"}])
    a, b, c = X.typed_alerts(X.read_extract(spark, path)).orderBy("event_id").collect()
    assert a.severity is None and a.severity_raw == "False" and a.unacknowledged and a.ack_minutes is None and a.stwid is None and a.stwid_placeholder
    assert b.severity == "Sev-1" and b.ack_minutes == 5 and b.stwid == 1001 and not b.stwid_placeholder and b.alert_date == dt.date(2026, 6, 3)
    assert c.stwid_placeholder and c.severity is None and c.unacknowledged


def test_leg_and_rating_defects(spark, tmp_path):
    cols = ("business_unit office product_type trip_date shift_type trip_id planned_pickup_epoch planned_drop_epoch actual_pickup_epoch actual_drop_epoch planned_km traveled_km stwid signintype gender "
            "emp_role boarding_status not_boarding_reason is_no_show").split()
    path = write(tmp_path / "emp.csv", cols, [dict(trip_id="5", trip_date="2026-06-03", stwid="9", actual_drop_epoch="1783633500.0", traveled_km="-6.63", boarding_status="Boarded", not_boarding_reason=" ", is_no_show="false")])
    leg = X.typed_emp(X.read_extract(spark, path)).first()
    assert leg.actual_drop_epoch == 1783633500 and leg.traveled_km == -6.63 and leg.km_negative and leg.incomplete_leg and leg.boarded and leg.not_boarding_reason is None
    cols = "business_unit trip_id trip_type trip_date stwid route_rating driver_rating cab_rating safety_rating marshal_rating creation_time".split()
    path = write(tmp_path / "fb.csv", cols, [dict(trip_id="5", trip_date='"June 3, 2026, 11:00 AM"', stwid="9", route_rating="5", driver_rating="0", cab_rating="4", safety_rating="", marshal_rating="0", creation_time='"June 3, 2026, 1:05 PM"')])
    fb = X.typed_feedback(X.read_extract(spark, path)).first()
    assert fb.trip_date == dt.date(2026, 6, 3) and fb.marshal_rating is None and fb.avg_rating == 4.5


def test_a_lost_or_made_row_is_noticed(spark, tmp_path):
    path = write(tmp_path / "ride.csv", RIDE, [{**RIDE_ROW, "trip_id": str(i)} for i in range(5)])

    def loaded(typing, where):
        return X.load(spark, "trips", [path], str(tmp_path / where), typing=typing)[1]

    X.assert_conserved([loaded(None, "whole")])
    lost = loaded(lambda raw: X.typed_trips(raw).filter("trip_id <> 3"), "lost")
    assert (lost.lines, lost.parsed, lost.kept, lost.written) == (5, 5, 4, 4)
    made = loaded(lambda raw: X.typed_trips(raw).withColumn("x", F.explode(F.array(F.lit(1), F.lit(2)))), "made")
    assert (made.parsed, made.kept) == (5, 10)
    for account in (lost, made):
        assert not X.conservation(spark, [account]).first().conserved
        with pytest.raises(ValueError, match="trips: 5 lines"):
            X.assert_conserved([account])


def test_a_broken_row_in_the_text_is_noticed(spark, tmp_path):
    path = tmp_path / "ride.csv"
    row = ",".join(str({**RIDE_ROW, "office": '"two\nlines"'}[c]) for c in RIDE)
    path.write_text(",".join(RIDE) + "\n" + row + "\n\n   \n" + ",".join(str(RIDE_ROW[c]) for c in RIDE) + "\n")
    account = X.load(spark, "trips", [str(path)], str(tmp_path / "out"))[1]
    assert account.lines == account.parsed == account.written == 3  # a line break ends a row, blank lines are no rows


def test_publish_partitions_by_month(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2026, 5, 1)), (2, dt.date(2026, 6, 1))], "trip_id bigint, month date")
    out = X.publish(df, "trips", str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"month=2026-05-01", "month=2026-06-01"}
    assert out.filter("month = date '2026-05-01'").count() == 1
    assert X.publish(df, "lazy_trips").count() == 2


def test_quotes_and_backslashes_in_fields(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b,c\n"say ""hi"", ok",2,3\nx\\,y,z\n"x\\",y,z\n')
    assert [tuple(r) for r in X.read_extract(spark, str(tmp_path / "q.csv")).collect()] == [('say "hi", ok', "2", "3"), ("x\\", "y", "z"), ("x\\", "y", "z")]


def test_whole_numbers_and_dates(spark):
    from tripscope.functions import parse as P

    numbers = {"12.7": 13, "1783633500.0": 1783633500, "1,097,076": 1097076, "9007199254740993": 9007199254740993, "x": None, "": None}
    dates = {"2026": None, "2026-06": None, "2026-06-01": dt.date(2026, 6, 1)}
    got = spark.createDataFrame([(t,) for t in (*numbers, *dates)], "t string").select("t", P.comma_long(F.col("t")).alias("n"), P.iso_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.n for r in got if r.t in numbers} == numbers and {r.t: r.d for r in got if r.t in dates} == dates
    bill = spark.createDataFrame([("1097076.0",), ("OverHead",)], "trip_id string")
    assert [r.o for r in bill.select(P.comma_long(F.col("trip_id")).isNull().alias("o")).collect()] == [False, True]


def test_derived_extracts_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    """Text takes several times the bytes of its table, so it is compressed, in files small enough for one task each."""
    import gzip

    from tripscope.plans import parsing

    monkeypatch.setattr(parsing, "EXTRACT_ROWS", 40)
    text = spark.range(100).coalesce(1).selectExpr("cast(id as string) AS trip_id", "if(id % 3 = 0, ' a,\"b\" ', null) AS remark")
    parsing._write_text(text, str(tmp_path / "x.csv"), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    files = list((tmp_path / "x.csv").glob("part-*.csv.gz"))
    assert sorted(len(gzip.open(f, "rt").read().splitlines()) for f in files) == [21, 41, 41]
    assert sorted(X.read_extract(spark, str(tmp_path / "x.csv")).collect(), key=str) == sorted(text.collect(), key=str)
    assert X.data_lines(spark, [str(tmp_path / "x.csv")]).first()["lines"] == 100
