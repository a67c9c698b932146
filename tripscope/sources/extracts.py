"""Text extracts in, typed relations out, and the checks around the load."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tripscope.functions import parse as P

RELATIONS = ("trips", "bills", "alerts", "emp", "feedback")


def read_extract(spark: SparkSession, path: str) -> DataFrame:
    """One CSV extract, every column text; short lines are padded with nulls.

    A quote inside a quoted field is doubled, and a backslash is an ordinary character. A line break ends a row even inside quotes.
    """
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", False).csv(path)


def read_extracts(spark: SparkSession, paths: list[str], tag: str | None = None) -> DataFrame:
    """Several extracts with possibly different columns, united by name.

    ``tag`` is a pattern whose first group is taken from each row's file path into ``src_month``.
    """
    out: DataFrame | None = None
    for p in paths:
        part = read_extract(spark, p)
        if tag:
            part = part.withColumn("src_month", F.regexp_extract(F.col("_metadata.file_path"), tag, 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _c(name: str) -> F.Column:
    return F.col(name)


def typed_trips(raw: DataFrame) -> DataFrame:
    delay = P.comma_double(_c("delay_minutes"))
    day = P.long_date(_c("trip_date"))
    keep = [c for c in ("src_month",) if c in raw.columns]
    return raw.select(
        P.comma_long(_c("trip_id")).alias("trip_id"), "business_unit", "office", "product_type", "vendor_id", "trip_direction", "shift_type",
        P.na_category(_c("trip_nodal")).alias("trip_nodal"), "delay_reason", "actual_cab_fuel_type", "route_source",
        day.alias("trip_date"), F.trunc(day, "MM").alias("month"), delay.alias("delay_minutes"),
        P.comma_long(_c("planned_end_epoch")).alias("planned_end_epoch"), P.comma_long(_c("actual_end_epoch")).alias("actual_end_epoch"),
        _c("planned_km").try_cast("double").alias("planned_km"), _c("traveled_km").try_cast("double").alias("traveled_km"),
        P.boolean3(_c("actual_escort")).alias("actual_escort"), P.boolean3(_c("is_driver_nc")).alias("is_driver_nc"),
        P.boolean3(_c("is_cab_nc")).alias("is_cab_nc"), P.whole_number(_c("actual_cab_capacity")).alias("cab_capacity"),
        P.whole_number(_c("plannedemployee_cnt")).alias("emp_planned"), P.whole_number(_c("actualemployee_cnt")).alias("emp_actual"),
        P.whole_number(_c("noshow_cnt")).alias("noshow"), P.on_time(delay).alias("on_time"), *keep,
    )


def typed_bills(raw: DataFrame, marks=P.FIXED_CONTRACT_MARKS, slabs=P.FIXED_SLABS) -> DataFrame:
    start = P.long_timestamp(_c("cycle_start"))
    base = raw.select(
        P.comma_long(_c("trip_id")).alias("trip_id"), _c("trip_id").alias("trip_id_raw"), P.comma_long(_c("trip_id")).isNull().alias("is_overhead"),
        "business_unit", "office", "vendor", P.text_or_null(_c("contract")).alias("contract"), P.text_or_null(_c("slab_name")).alias("slab_name"),
        start.cast("date").alias("cycle_start"), P.long_timestamp(_c("cycle_end")).cast("date").alias("cycle_end"),
        F.trunc(start, "MM").alias("month"), P.comma_double(_c("total_trip_km")).alias("total_trip_km"), P.comma_double(_c("trip_cost")).alias("trip_cost"),
    ).withColumn("billing_regime", P.billing_regime(_c("contract"), _c("slab_name"), marks, slabs))
    return base.withColumns({"cost_per_km": P.unit_cost(_c("billing_regime"), _c("trip_cost"), _c("total_trip_km")), "zero_km": _c("total_trip_km") == 0})


def typed_alerts(raw: DataFrame) -> DataFrame:
    rider, placeholder = P.rider_id(_c("stwid"))
    kept, text = P.severity(_c("severity"))
    start, ack = P.long_timestamp(_c("start_time")), P.long_timestamp(_c("acknowledge_time"))
    return raw.select(
        P.comma_long(_c("trip_id")).alias("trip_id"), "business_unit", "event_id", "event_type", "state_text", "source", rider.alias("stwid"),
        placeholder.alias("stwid_placeholder"), kept.alias("severity"), text.alias("severity_raw"), start.alias("start_time"), ack.alias("acknowledge_time"),
        start.cast("date").alias("alert_date"), F.trunc(start, "MM").alias("month"), P.ack_minutes(start, ack).alias("ack_minutes"),
        ack.isNull().alias("unacknowledged"),
    )


def typed_emp(raw: DataFrame) -> DataFrame:
    rider, placeholder = P.rider_id(_c("stwid"))
    day = P.iso_date(_c("trip_date"))
    epochs = ("planned_pickup_epoch", "planned_drop_epoch", "actual_pickup_epoch", "actual_drop_epoch")
    base = raw.select(
        P.comma_long(_c("trip_id")).alias("trip_id"), "business_unit", "office", "product_type", "shift_type", day.alias("trip_date"),
        F.trunc(day, "MM").alias("month"), rider.alias("stwid"), placeholder.alias("stwid_placeholder"),
        *[P.float_epoch(_c(e)).alias(e) for e in epochs], P.comma_double(_c("planned_km")).alias("planned_km"),
        P.comma_double(_c("traveled_km")).alias("traveled_km"), "signintype", "gender", "emp_role", "boarding_status",
        F.nullif(F.trim(_c("not_boarding_reason")), F.lit("")).alias("not_boarding_reason"), P.boolean3(_c("is_no_show")).alias("is_no_show"),
        (_c("boarding_status") == "Boarded").alias("boarded"),
    )
    return base.withColumns(
        {
            "km_negative": (F.coalesce("planned_km", F.lit(0.0)) < 0) | (F.coalesce("traveled_km", F.lit(0.0)) < 0),
            "incomplete_leg": _c("actual_pickup_epoch").isNull() | _c("actual_drop_epoch").isNull(),
        }
    )


def typed_feedback(raw: DataFrame) -> DataFrame:
    rider, placeholder = P.rider_id(_c("stwid"))
    day = P.long_timestamp(_c("trip_date"))
    names = ("route", "driver", "cab", "safety", "marshal")
    base = raw.select(
        P.comma_long(_c("trip_id")).alias("trip_id"), "business_unit", "trip_type", rider.alias("stwid"), placeholder.alias("stwid_placeholder"),
        day.cast("date").alias("trip_date"), F.trunc(day, "MM").alias("month"), P.long_timestamp(_c("creation_time")).alias("creation_time"),
        *[P.rating(_c(f"{n}_rating")).alias(f"{n}_rating") for n in names],
    )
    return base.withColumn("avg_rating", P.row_average([_c(f"{n}_rating") for n in names[:4]]))


TYPED = {"trips": typed_trips, "bills": typed_bills, "alerts": typed_alerts, "emp": typed_emp, "feedback": typed_feedback}


def publish(typed: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Parquet partitioned by month when a path is given, else a lazy view of the same name."""
    spark = typed.sparkSession
    if path is None:
        typed.createOrReplaceTempView(name)
        return spark.table(name)
    # Rows of a month meet before they are written, large months in several tasks: a few files of good size instead of one per task and month.
    typed.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(path)
    return spark.read.parquet(path)


class Account(NamedTuple):
    """What one load of a relation saw: data lines of the text, rows parsed from them, rows after typing, rows in the written files."""

    relation: str
    lines: int
    parsed: int
    kept: int
    written: int

    @property
    def conserved(self) -> bool:
        return self.lines == self.parsed == self.kept == self.written


def data_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the files that are not blank, less one heading per file: what a load has to account for."""
    text = spark.read.text(paths).filter(F.col("value").rlike(r"[^\x00-\x20]"))
    per_file = text.groupBy(F.col("_metadata.file_path").alias("file")).agg((F.count("*") - 1).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("lines"))


def load(spark: SparkSession, name: str, paths: list[str], path: str, tag: str | None = None, typing=None) -> tuple[DataFrame, Account]:
    """Types a relation's extracts, writes them as Parquet by month and accounts for every row.

    Rows are counted inside the job that writes them, where they leave the parser and where they enter the files; the files' own counts
    come from their footers, the lines from the text. The four agree unless a step loses or makes rows.
    """
    parsed, kept = Observation(f"{name}-parsed"), Observation(f"{name}-kept")
    rows = read_extracts(spark, paths, tag) if len(paths) > 1 or tag else read_extract(spark, paths[0])
    seen = rows.observe(parsed, F.count(F.lit(1)).alias("n"))
    typed = (typing or TYPED[name])(seen).observe(kept, F.count(F.lit(1)).alias("n"))
    out = publish(typed if "month" in typed.columns else typed.withColumn("month", F.lit(None).cast("date")), name, path)
    lines = data_lines(spark, paths).first()["lines"]
    return out, Account(name, lines, parsed.get["n"], kept.get["n"], out.count())


def conservation(spark: SparkSession, accounts: list[Account]) -> DataFrame:
    """The accounts of a load as a report."""
    return spark.createDataFrame([(*a, a.conserved) for a in accounts], "relation string, lines bigint, parsed bigint, kept bigint, written bigint, conserved boolean")


def assert_conserved(accounts: list[Account]) -> None:
    """Fails when a relation lost or gained rows on the way from its lines to its files."""
    bad = [a for a in accounts if not a.conserved]
    if bad:
        raise ValueError("; ".join(f"{a.relation}: {a.lines} lines, {a.parsed} parsed, {a.kept} kept, {a.written} written" for a in bad))
