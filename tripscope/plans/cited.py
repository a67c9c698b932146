"""Analyses at their published thresholds, each with SQL written by itself rather than printed from the chain.

Thresholds and gates are parameters whose defaults are the published values. The generated tables are small, so the registered queries pass
lower sample gates (``SMALL``); rules such as "three times the median" or "late from 15 minutes" are never changed. Detail rows are
counted by their keys and value before any join, so a contract or vendor with a third of all lines costs one row per distinct price.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tripscope.functions.ordering import with_tile
from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.sources import roles

BOOK = Book()
SMALL = 20


def share(part, whole, digits: int = 6):
    return F.round(part / F.nullif(whole, F.lit(0)), digits)


def counted_median(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and number of rows per key from (keys, value, c): prices are counted first, so a buffer holds distinct prices."""
    return counts.groupBy(*keys).agg(F.percentile(value, 0.5, F.col("c")).alias("med"), F.sum("c").alias("n"))


# --- cost ------------------------------------------------------------------------------------------------------------


def peer_outliers(spark: SparkSession, sf: str, times: float = 3.0, peers: int = 500) -> DataFrame:
    """Lines above ``times`` the median of their contract and slab, where it has ``peers`` lines; by vendor."""
    prices = roles.bills(spark, sf, "contract", "slab_name", "vendor", "trip_cost").filter("trip_cost > 0").withColumn("slab", F.coalesce("slab_name", F.lit("<null>")))
    counts = prices.groupBy("contract", "slab", "vendor", "trip_cost").agg(F.count("*").alias("c"))
    peer = counted_median(counts.groupBy("contract", "slab", "trip_cost").agg(F.sum("c").alias("c")), ["contract", "slab"], "trip_cost").filter(F.col("n") >= peers)
    out = counts.join(peer, ["contract", "slab"]).filter(F.col("trip_cost") > times * F.col("med"))
    return out.groupBy("contract", "slab", "vendor").agg(
        F.sum("c").alias("outliers"), F.max("n").alias("peers"), F.round(F.max("med"), 4).alias("peer_median"), F.round(F.sum(F.col("c") * F.col("trip_cost")), 4).alias("spend"),
        F.round(F.sum(F.col("c") * (F.col("trip_cost") - F.col("med"))) + 1e-7, 4).alias("excess"),
    )


def _peer_sql(times: float, peers: int) -> str:
    return with_roles(f"""SELECT contract, slab, vendor, count(*) AS outliers, max(n) AS peers, round(max(med), 4) AS peer_median, round(sum(trip_cost), 4) AS spend,
  round(sum(trip_cost - med) + 0.0000001, 4) AS excess
FROM (SELECT contract, coalesce(slab_name, '<null>') AS slab, vendor, CAST(trip_cost AS DOUBLE) AS trip_cost, count(*) OVER w AS n, CAST(median(trip_cost) OVER w AS DOUBLE) AS med
      FROM bills WHERE trip_cost > 0 WINDOW w AS (PARTITION BY contract, coalesce(slab_name, '<null>')))
WHERE n >= {peers} AND trip_cost > {times} * med GROUP BY ALL""", "bills")


BOOK.add("C11_outliers_published", lambda spark, sf: peer_outliers(spark, sf), _peer_sql(3.0, 500))
BOOK.add("C11_outliers_low_bar", lambda spark, sf: peer_outliers(spark, sf, times=1.5, peers=2), _peer_sql(1.5, 2))
BOOK.add("C11_outliers_small_gate", lambda spark, sf: peer_outliers(spark, sf, peers=2), _peer_sql(3.0, 2))


def integer_multiples(spark: SparkSession, sf: str, times: float = 3.0, near: float = 0.02) -> DataFrame:
    """Lines above ``times`` their contract's median: how many are whole multiples of it."""
    counts = roles.bills(spark, sf, "contract", "trip_cost").groupBy("contract", "trip_cost").agg(F.count("*").alias("c"))
    base = counted_median(counts, ["contract"], "trip_cost").select("contract", "med")
    over = counts.join(base, "contract").filter(F.col("trip_cost") > times * F.col("med")).withColumn("ratio", F.col("trip_cost") / F.col("med"))
    whole = F.abs(F.col("ratio") - F.round("ratio")) < near
    return over.groupBy("contract").agg(F.sum(F.when(whole, F.col("c")).otherwise(0)).alias("near_integer"), F.sum("c").alias("over"), F.round(F.max("ratio"), 4).alias("largest"))


def _multiples_sql(times: float) -> str:
    return with_roles(f"""SELECT contract, count(*) FILTER (WHERE abs(ratio - round(ratio)) < 0.02) AS near_integer, count(*) AS "over", round(max(ratio), 4) AS largest
FROM (SELECT contract, CAST(trip_cost AS DOUBLE) / m AS ratio FROM bills JOIN (SELECT contract, CAST(median(trip_cost) AS DOUBLE) AS m FROM bills GROUP BY 1) USING (contract) WHERE trip_cost > {times} * m)
GROUP BY 1""", "bills")


BOOK.add("C12_multiples_of_median", lambda spark, sf: integer_multiples(spark, sf), _multiples_sql(3.0))
BOOK.add("C12_multiples_over_twice", lambda spark, sf: integer_multiples(spark, sf, times=2.0), _multiples_sql(2.0))


def levelling(spark: SparkSession, sf: str, least: int = 500) -> DataFrame:
    """Saving if every vendor of a contract and known slab charged the best mean there; vendors with ``least`` lines."""
    v = roles.bills(spark, sf, "contract", "slab_name", "vendor", "trip_cost").filter("trip_cost > 0 AND slab_name IS NOT NULL").groupBy("contract", "slab_name", "vendor").agg(
        F.sum("trip_cost").alias("cost"), F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("mean", F.col("cost") / F.col("n"))
    best = F.min("mean").over(W.partitionBy("contract", "slab_name"))
    return v.withColumn("best", best).groupBy("contract").agg(F.sum("n").alias("n"), F.round(F.sum("cost"), 4).alias("spend"), F.round(F.sum(F.col("n") * (F.col("mean") - F.col("best"))) + 1e-7, 3).alias("saving"))


def _levelling_sql(least: int) -> str:
    return with_roles(f"""WITH v AS (SELECT contract, slab_name, vendor, CAST(sum(trip_cost) AS DOUBLE) AS cost, count(*) AS n, CAST(sum(trip_cost) AS DOUBLE) / count(*) AS mean FROM bills
      WHERE trip_cost > 0 AND slab_name IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}), b AS (SELECT contract, slab_name, min(mean) AS best FROM v GROUP BY ALL)
SELECT contract, CAST(sum(n) AS BIGINT) AS n, round(sum(cost), 4) AS spend, round(sum(n * (mean - best)) + 0.0000001, 3) AS saving FROM v JOIN b USING (contract, slab_name) GROUP BY 1""", "bills").replace("\nWITH v AS", ",\nv AS", 1)


BOOK.add("C21_levelling_published", lambda spark, sf: levelling(spark, sf), _levelling_sql(500))
BOOK.add("C21_levelling_small_gate", lambda spark, sf: levelling(spark, sf, 2), _levelling_sql(2))

# --- riders ----------------------------------------------------------------------------------------------------------


def punctuality(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of pickups in five bands, by month."""
    late = F.col("late_minutes")
    bands = {"early_10": late < -10, "in_window": late.between(-10, 5), "late_15": (late > 5) & (late <= 15), "late_30": (late > 15) & (late <= 30), "later": late > 30}
    return roles.legs(spark, sf, "month", "late_minutes", "boarded").filter("boarded AND late_minutes IS NOT NULL").groupBy("month").agg(
        F.count("*").alias("n"), *[share(F.count(F.when(c, 1)), F.count("*")).alias(k) for k, c in bands.items()])


BOOK.add("E6_bands_published", punctuality, with_roles("""SELECT month, count(*) AS n, round(count(*) FILTER (WHERE late_minutes < -10) / count(*), 6) AS early_10,
  round(count(*) FILTER (WHERE late_minutes BETWEEN -10 AND 5) / count(*), 6) AS in_window, round(count(*) FILTER (WHERE late_minutes > 5 AND late_minutes <= 15) / count(*), 6) AS late_15,
  round(count(*) FILTER (WHERE late_minutes > 15 AND late_minutes <= 30) / count(*), 6) AS late_30, round(count(*) FILTER (WHERE late_minutes > 30) / count(*), 6) AS later
FROM legs WHERE boarded AND late_minutes IS NOT NULL GROUP BY 1""", "legs"))


def boarding_overrun(spark: SparkSession, sf: str, fewest: int = 2, most: int = 6, least: int = 2000) -> DataFrame:
    """Ride time against plan by place in the order of actual pickups, per direction; trips of ``fewest`` to ``most`` complete legs."""
    cols = ("trip_id", "planned_pickup_epoch", "planned_drop_epoch", "actual_pickup_epoch", "actual_drop_epoch", "rider_ref", "leg_ref", "leg_amount")
    legs = roles.legs(spark, sf, *cols).filter("actual_pickup_epoch IS NOT NULL AND actual_drop_epoch IS NOT NULL")
    sized = legs.groupBy("trip_id").agg(F.count("*").alias("size")).filter(F.col("size").between(fewest, most))
    # Trips of at most ``most`` legs remain, so a window holds as many rows.
    order = W.partitionBy("trip_id").orderBy("actual_pickup_epoch", "rider_ref", "leg_ref", "leg_amount")
    placed = legs.join(sized, "trip_id").withColumn("seq", F.row_number().over(order)).join(roles.trips(spark, sf, "trip_id", "trip_direction"), "trip_id")
    plan, real = (F.col("planned_drop_epoch") - F.col("planned_pickup_epoch")) / 60, (F.col("actual_drop_epoch") - F.col("actual_pickup_epoch")) / 60
    return placed.groupBy("trip_direction", "seq").agg(
        F.count("*").alias("n"), F.round(F.avg(plan), 4).alias("planned_min"), F.round(F.avg(real), 4).alias("actual_min"), F.round(F.avg(real) - F.avg(plan), 4).alias("overrun_min")).filter(F.col("n") >= least)


BOOK.add("E8_boarding_overrun", lambda spark, sf: boarding_overrun(spark, sf, least=SMALL), with_roles(f"""SELECT trip_direction, CAST(seq AS INTEGER) AS seq, count(*) AS n,
  round(avg((pd - pp) / 60), 4) AS planned_min, round(avg((ad - ap) / 60), 4) AS actual_min, round(avg((ad - ap) / 60) - avg((pd - pp) / 60), 4) AS overrun_min
FROM (SELECT trip_id, planned_pickup_epoch AS pp, planned_drop_epoch AS pd, actual_pickup_epoch AS ap, actual_drop_epoch AS ad,
    row_number() OVER (PARTITION BY trip_id ORDER BY actual_pickup_epoch, rider_ref, leg_ref, leg_amount) AS seq, count(*) OVER (PARTITION BY trip_id) AS size
  FROM legs WHERE actual_pickup_epoch IS NOT NULL AND actual_drop_epoch IS NOT NULL) JOIN trips USING (trip_id)
WHERE size BETWEEN 2 AND 6 GROUP BY 1, 2 HAVING count(*) >= {SMALL}""", "legs", "trips"))


def served_riders(spark: SparkSession, sf: str, late: int = 15, legs: int = 20) -> DataFrame:
    """Riders with ``legs`` pickups: how often over ``late`` minutes late; every rider, worst first by rate."""
    rows = roles.legs(spark, sf, "stwid", "late_minutes", "boarded").filter("stwid IS NOT NULL AND boarded AND late_minutes IS NOT NULL")
    r = rows.groupBy("stwid").agg(F.count("*").alias("legs"), F.count(F.when(F.col("late_minutes") > late, 1)).alias("late15"), F.round(F.avg("late_minutes"), 4).alias("avg_late"))
    return r.filter(F.col("legs") >= legs).withColumn("rate", share(F.col("late15"), F.col("legs")))


BOOK.add("E12_served_riders", served_riders, with_roles("""SELECT stwid, count(*) AS legs, count(*) FILTER (WHERE late_minutes > 15) AS late15, round(avg(late_minutes), 4) AS avg_late,
  round(count(*) FILTER (WHERE late_minutes > 15) / count(*), 6) AS rate FROM legs WHERE stwid IS NOT NULL AND boarded AND late_minutes IS NOT NULL GROUP BY 1 HAVING count(*) >= 20""", "legs"))


def never_late(spark: SparkSession, sf: str) -> DataFrame:
    return served_riders(spark, sf).agg(F.count("*").alias("riders"), F.count(F.when(F.col("late15") == 0, 1)).alias("never_late"), share(F.count(F.when(F.col("late15") == 0, 1)), F.count("*")).alias("part"))


BOOK.add("E12_never_late", never_late, with_roles("""SELECT count(*) AS riders, count(*) FILTER (WHERE late15 = 0) AS never_late, round(count(*) FILTER (WHERE late15 = 0) / nullif(count(*), 0), 6) AS part
FROM (SELECT stwid, count(*) FILTER (WHERE late_minutes > 15) AS late15 FROM legs WHERE stwid IS NOT NULL AND boarded AND late_minutes IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)""", "legs"))


def repeat_no_shows(spark: SparkSession, sf: str, least: int = 5) -> DataFrame:
    r = roles.legs(spark, sf, "stwid", "is_no_show").filter("stwid IS NOT NULL").groupBy("stwid").agg(F.count(F.when(F.col("is_no_show"), 1)).alias("ns"))
    often = F.col("ns") >= least
    return r.agg(F.count(F.when(F.col("ns") > 0, 1)).alias("with_any"), F.count("*").alias("riders"), F.sum("ns").alias("total"), share(F.sum(F.when(often, F.col("ns")).otherwise(0)), F.sum("ns")).alias("part"), F.count(F.when(often, 1)).alias("often"))


BOOK.add("E12_repeat_no_shows", repeat_no_shows, with_roles("""SELECT count(*) FILTER (WHERE ns > 0) AS with_any, count(*) AS riders, CAST(sum(ns) AS BIGINT) AS total,
  round(coalesce(sum(ns) FILTER (WHERE ns >= 5), 0) / nullif(sum(ns), 0), 6) AS part, count(*) FILTER (WHERE ns >= 5) AS often
FROM (SELECT stwid, count(*) FILTER (WHERE is_no_show) AS ns FROM legs WHERE stwid IS NOT NULL GROUP BY 1)""", "legs"))

# --- ratings ---------------------------------------------------------------------------------------------------------


def _lows(spark: SparkSession, sf: str) -> DataFrame:
    return roles.feedback(spark, sf, "stwid", "driver_rating").filter("stwid IS NOT NULL AND driver_rating > 0").groupBy("stwid").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("driver_rating").between(1, 2), 1)).alias("lows"))


_LOWS_SQL = "SELECT stwid, count(*) AS n, count(*) FILTER (WHERE driver_rating BETWEEN 1 AND 2) AS lows FROM feedback WHERE stwid IS NOT NULL AND driver_rating > 0 GROUP BY 1"


def low_raters(spark: SparkSession, sf: str) -> DataFrame:
    """Raters by how many low driver ratings they gave: none, one, two to four, five and more."""
    group = F.when(F.col("lows") == 0, "never").when(F.col("lows") == 1, "once").when(F.col("lows") <= 4, "repeat").otherwise("chronic")
    g = _lows(spark, sf).groupBy(group.alias("kind")).agg(F.count("*").alias("raters"), F.sum("n").alias("reviews"), F.sum("lows").alias("lows"))
    return g.withColumn("part", share(F.col("lows"), F.sum("lows").over(W.partitionBy())))  # four rows


BOOK.add("F10_low_raters", low_raters, with_roles(f"""SELECT CASE WHEN lows = 0 THEN 'never' WHEN lows = 1 THEN 'once' WHEN lows BETWEEN 2 AND 4 THEN 'repeat' ELSE 'chronic' END AS kind, count(*) AS raters,
  CAST(sum(n) AS BIGINT) AS reviews, CAST(sum(lows) AS BIGINT) AS lows, round(sum(lows) / nullif(sum(sum(lows)) OVER (), 0), 6) AS part FROM ({_LOWS_SQL}) GROUP BY 1""", "feedback"))


def low_concentration(spark: SparkSession, sf: str) -> DataFrame:
    """Share of low driver ratings from the top 1, 5 and 10 % of those who gave any."""
    tiled = with_tile(_lows(spark, sf).filter("lows > 0"), [F.col("lows").desc(), F.col("stwid")], 100)
    band = F.when(F.col("tile") <= 1, "top 1%").when(F.col("tile") <= 5, "top 5%").when(F.col("tile") <= 10, "top 10%").otherwise("rest")
    g = tiled.groupBy(band.alias("band")).agg(F.count("*").alias("raters"), F.sum("lows").alias("lows"))
    return g.withColumn("part", share(F.col("lows"), F.sum("lows").over(W.partitionBy())))  # four rows


BOOK.add("F10_low_concentration", low_concentration, with_roles(f"""SELECT CASE WHEN t <= 1 THEN 'top 1%' WHEN t <= 5 THEN 'top 5%' WHEN t <= 10 THEN 'top 10%' ELSE 'rest' END AS band, count(*) AS raters,
  CAST(sum(lows) AS BIGINT) AS lows, round(sum(lows) / nullif(sum(sum(lows)) OVER (), 0), 6) AS part FROM (SELECT *, ntile(100) OVER (ORDER BY lows DESC, stwid) AS t FROM ({_LOWS_SQL}) WHERE lows > 0) GROUP BY 1""", "feedback"))

# --- timeliness ------------------------------------------------------------------------------------------------------


def start_or_run(spark: SparkSession, sf: str, bound: int = 600) -> DataFrame:
    """Deviations of start, end and run time of all trips within ``bound`` minutes, by month."""
    t = roles.trips(spark, sf, "month", "planned_start_epoch", "actual_start_epoch", "planned_end_epoch", "actual_end_epoch")
    c = F.col
    d = t.select("month", ((c("actual_start_epoch") - c("planned_start_epoch")) / 60).alias("start"), ((c("actual_end_epoch") - c("planned_end_epoch")) / 60).alias("end"),
                 ((c("actual_end_epoch") - c("actual_start_epoch") - c("planned_end_epoch") + c("planned_start_epoch")) / 60).alias("run"))
    d = d.filter((F.abs("start") < bound) & (F.abs("end") < bound) & (F.abs("run") < bound))
    return d.groupBy("month").agg(
        F.count("*").alias("n"), *[x for k in ("start", "end", "run") for x in (F.round(F.avg(k), 4).alias(f"mean_{k}"), F.round(F.percentile(k, 0.5), 4).alias(f"p50_{k}"))],
        share(F.count(F.when(c("start") > 5, 1)), F.count("*")).alias("start_over_5"), share(F.count(F.when(c("run") > 5, 1)), F.count("*")).alias("run_over_5"))


BOOK.add("L11_all_trips", start_or_run, with_roles("""SELECT month, count(*) AS n, round(avg(s), 4) AS mean_start, round(quantile_cont(s, 0.5), 4) AS p50_start, round(avg(e), 4) AS mean_end, round(quantile_cont(e, 0.5), 4) AS p50_end,
  round(avg(r), 4) AS mean_run, round(quantile_cont(r, 0.5), 4) AS p50_run, round(count(*) FILTER (WHERE s > 5) / count(*), 6) AS start_over_5, round(count(*) FILTER (WHERE r > 5) / count(*), 6) AS run_over_5
FROM (SELECT month, (actual_start_epoch - planned_start_epoch) / 60 AS s, (actual_end_epoch - planned_end_epoch) / 60 AS e,
        ((actual_end_epoch - actual_start_epoch) - (planned_end_epoch - planned_start_epoch)) / 60 AS r FROM trips)
WHERE abs(s) < 600 AND abs(e) < 600 AND abs(r) < 600 GROUP BY 1""", "trips"))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation over pairs, null where either side is constant: the built-in form divides by zero there."""
    a, b = (F.when(F.col(other).isNotNull(), F.col(one)) for one, other in ((x, y), (y, x)))
    return F.covar_samp(x, y) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def load_correlation(spark: SparkSession, sf: str, days: int = 60) -> DataFrame:
    """Trips a weekday against the on-time rate, per office with ``days`` weekdays."""
    d = roles.trips(spark, sf, "office", "trip_date", "on_time").filter(F.weekday("trip_date") < 5).groupBy("office", "trip_date").agg(F.count("*").cast("double").alias("n"), F.avg("on_time").alias("rate"))
    return d.groupBy("office").agg(F.count("*").alias("days"), F.round(F.avg("n"), 4).alias("mean_trips"), F.round(correlation("n", "rate"), 5).alias("load_corr")).filter(F.col("days") >= days)


BOOK.add("L20_weekday_load", load_correlation, with_roles("""SELECT office, count(*) AS days, round(avg(n), 4) AS mean_trips, round(corr(n, rate), 5) AS load_corr
FROM (SELECT office, trip_date, CAST(count(*) AS DOUBLE) AS n, avg(on_time) AS rate FROM trips WHERE isodow(trip_date) <= 5 GROUP BY ALL) GROUP BY 1 HAVING count(*) >= 60""", "trips"))

# --- across tables ---------------------------------------------------------------------------------------------------


def coverage_vs_detractors(spark: SparkSession, sf: str, least: int = 1000) -> DataFrame:
    """Per vendor with ``least`` trips: share of trips with feedback, and share of low driver ratings in it."""
    fb = roles.feedback(spark, sf, "trip_id", "driver_rating").groupBy("trip_id").agg(F.count("driver_rating").alias("n_fb"), F.count(F.when(F.col("driver_rating") <= 2, 1)).alias("n_det"))
    v = roles.trips(spark, sf, "trip_id", "vendor_id").join(fb, "trip_id", "left").groupBy("vendor_id").agg(
        F.count("*").alias("n_trips"), F.count(F.when(F.col("n_fb") > 0, 1)).alias("with_fb"), F.coalesce(F.sum("n_det"), F.lit(0)).alias("n_det"), F.coalesce(F.sum("n_fb"), F.lit(0)).alias("n_ratings")).filter(F.col("n_trips") >= least)
    return v.select("vendor_id", "n_trips", share(F.col("with_fb"), F.col("n_trips")).alias("coverage"), share(F.col("n_det"), F.col("n_ratings")).alias("detractors"), "n_ratings")


_VENDOR_SQL = """SELECT vendor_id, count(*) AS n_trips, round(count(*) FILTER (WHERE n_fb > 0) / count(*), 6) AS coverage, round(coalesce(sum(n_det), 0) / nullif(coalesce(sum(n_fb), 0), 0), 6) AS detractors,
  CAST(coalesce(sum(n_fb), 0) AS BIGINT) AS n_ratings FROM trips LEFT JOIN (SELECT trip_id, count(driver_rating) AS n_fb, count(*) FILTER (WHERE driver_rating <= 2) AS n_det FROM feedback GROUP BY 1) USING (trip_id)
GROUP BY 1 HAVING count(*) >= {}"""
BOOK.add("X10_coverage_vs_detractors", lambda spark, sf: coverage_vs_detractors(spark, sf, SMALL), with_roles(_VENDOR_SQL.format(SMALL), "trips", "feedback"))
BOOK.add("X10_detractor_correlation", lambda spark, sf: coverage_vs_detractors(spark, sf, SMALL).agg(F.count("*").alias("vendors"), F.round(correlation("coverage", "detractors"), 4).alias("corr")),
         with_roles(f"SELECT count(*) AS vendors, round(corr(coverage, detractors), 4) AS corr FROM ({_VENDOR_SQL.format(SMALL)})", "trips", "feedback"))


def feed_days(spark: SparkSession, sf: str) -> DataFrame:
    """Trips a day and how many have feedback of the same day."""
    fb = roles.feedback(spark, sf, "trip_id", "trip_date").distinct().withColumn("answered", F.lit(1))
    return roles.trips(spark, sf, "trip_id", "trip_date").join(fb, ["trip_id", "trip_date"], "left").groupBy("trip_date").agg(F.count("*").alias("trips"), F.count("answered").alias("answered"))


BOOK.add("Q27_outage_days_by_date", lambda spark, sf: feed_days(spark, sf).withColumn("coverage", share(F.col("answered"), F.col("trips"))).filter(100.0 * F.col("answered") / F.col("trips") < 30), with_roles(
    """SELECT t.trip_date, count(DISTINCT t.trip_id) AS trips, count(DISTINCT f.trip_id) AS answered, round(count(DISTINCT f.trip_id) / count(DISTINCT t.trip_id), 6) AS coverage
FROM trips t LEFT JOIN feedback f ON f.trip_id = t.trip_id AND f.trip_date = t.trip_date GROUP BY 1 HAVING 100.0 * count(DISTINCT f.trip_id) / count(DISTINCT t.trip_id) < 30""", "trips", "feedback"))
BOOK.add("Q27_weekday_coverage", lambda spark, sf: feed_days(spark, sf).withColumns({"weekday": F.weekday("trip_date"), "cov": F.col("answered") / F.col("trips")}).filter("weekday < 5").groupBy("weekday").agg(
    F.count("*").alias("n_days"), F.round(F.avg("cov"), 6).alias("mean"), F.round(F.min("cov"), 6).alias("lowest"), F.round(F.max("cov"), 6).alias("highest")), with_roles(
    """SELECT CAST(isodow(d) - 1 AS INTEGER) AS weekday, count(*) AS n_days, round(avg(c), 6) AS mean, round(min(c), 6) AS lowest, round(max(c), 6) AS highest
FROM (SELECT t.trip_date AS d, count(DISTINCT f.trip_id) / count(DISTINCT t.trip_id) AS c FROM trips t LEFT JOIN feedback f ON f.trip_id = t.trip_id AND f.trip_date = t.trip_date GROUP BY 1)
WHERE isodow(d) <= 5 GROUP BY 1""", "trips", "feedback"))


def auto_close(spark: SparkSession, sf: str, low: int = 1400, high: int = 1500) -> DataFrame:
    """Alerts by severity, and how many were acknowledged ``low`` to ``high`` minutes later."""
    inside = F.col("ack_minutes").between(low, high)
    return roles.alerts(spark, sf, "severity_raw", "ack_minutes").groupBy(F.col("severity_raw").alias("severity")).agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("in_cluster"), share(F.count(F.when(inside, 1)), F.count("*")).alias("part"))


def _close_sql(low: int, high: int) -> str:
    return with_roles(f"""SELECT severity_raw AS severity, count(*) AS n, count(*) FILTER (WHERE ack_minutes BETWEEN {low} AND {high}) AS in_cluster,
  round(count(*) FILTER (WHERE ack_minutes BETWEEN {low} AND {high}) / count(*), 6) AS part FROM alerts GROUP BY 1""", "alerts")


BOOK.add("Y5_day_cluster", auto_close, _close_sql(1400, 1500))
BOOK.add("Y5_cluster_small_bounds", lambda spark, sf: auto_close(spark, sf, 240, 300), _close_sql(240, 300))


def matched_excess(spark: SparkSession, sf: str, reason: str = "NODELAY", least: int = 100) -> DataFrame:
    """Spend of delayed trips beyond the mean of punctual ones of the same contract, unit and month; credits left out."""
    lines = roles.bills(spark, sf, "trip_id", "contract", "trip_cost").filter("trip_id IS NOT NULL AND trip_cost >= 0")
    tb = lines.join(roles.trips(spark, sf, "trip_id", "business_unit", "month", "delay_reason"), "trip_id")
    cells = tb.groupBy("contract", "business_unit", "month", "delay_reason").agg(F.count("*").alias("n"), F.sum("trip_cost").alias("cost"))
    base = cells.filter((F.col("delay_reason") == reason) & (F.col("n") >= least)).select("contract", "business_unit", "month", (F.col("cost") / F.col("n")).alias("base"))
    late = cells.filter(F.col("delay_reason") != reason).join(base, ["contract", "business_unit", "month"])
    return late.groupBy("month", "delay_reason").agg(F.sum("n").alias("n"), F.round(F.sum("cost"), 3).alias("spend"), F.round(F.sum(F.col("cost") - F.col("n") * F.col("base")) + 1e-7, 3).alias("excess"))


def _excess_sql(reason: str, least: int) -> str:
    return with_roles(f"""SELECT month, delay_reason, count(*) AS n, round(CAST(sum(trip_cost) AS DOUBLE), 3) AS spend, round(sum(CAST(trip_cost AS DOUBLE) - base) + 0.0000001, 3) AS excess
FROM tb JOIN (SELECT contract, business_unit, month, CAST(avg(trip_cost) AS DOUBLE) AS base FROM tb WHERE delay_reason = '{reason}' GROUP BY ALL HAVING count(*) >= {least}) USING (contract, business_unit, month)
WHERE delay_reason <> '{reason}' GROUP BY 1, 2""", "bills", "trips", extra="""tb AS (SELECT b.contract, b.trip_cost, t.business_unit, t.month, t.delay_reason FROM bills b JOIN trips t ON b.trip_id = t.trip_id WHERE b.trip_cost >= 0)""")


BOOK.add("X2_matched_excess_published", lambda spark, sf: matched_excess(spark, sf), _excess_sql("NODELAY", 100))
BOOK.add("X2_matched_excess_small_gate", lambda spark, sf: matched_excess(spark, sf, least=2), _excess_sql("NODELAY", 2))

# --- every period as rows, where the cited SELECT lists a few ----------------------------------------------------------


def contract_share(spark: SparkSession, sf: str) -> DataFrame:
    """Each contract's share of a month's spend, and its shift from the month before."""
    cells = roles.bills(spark, sf, "contract", "month", "trip_cost").groupBy("contract", "month").agg(F.sum("trip_cost").alias("cost"))
    total = cells.groupBy("month").agg(F.sum("cost").alias("total"))
    s = cells.join(total, "month").withColumn("s", F.col("cost") / F.nullif(F.col("total"), F.lit(0)))
    before = F.lag("s").over(W.partitionBy("contract").orderBy("month"))
    return s.select("contract", "month", F.round("s", 6).alias("part"), F.round(F.col("s") - before, 6).alias("shift"))


BOOK.add("C6_share_every_month", contract_share, with_roles("""SELECT contract, month, round(s, 6) AS part, round(s - lag(s) OVER (PARTITION BY contract ORDER BY month), 6) AS shift
FROM (SELECT contract, month, CAST(sum(trip_cost) AS DOUBLE) / nullif(sum(CAST(sum(trip_cost) AS DOUBLE)) OVER (PARTITION BY month), 0) AS s FROM bills GROUP BY 1, 2)""", "bills"))


def _monthly(dim: str):
    def fn(spark: SparkSession, sf: str) -> DataFrame:
        cells = roles.trips(spark, sf, dim, "month", "on_time").groupBy(dim, "month").agg(F.count("*").alias("n"), F.avg("on_time").alias("rate"))
        before = F.lag("rate").over(W.partitionBy(dim).orderBy("month"))
        return cells.select(dim, "month", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - before, 6).alias("delta"))

    return fn


for _dim in ("office", "vendor_id", "product_type"):
    BOOK.add(f"L2_every_month_{_dim}", _monthly(_dim), with_roles(f"""SELECT {_dim}, month, n, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY {_dim} ORDER BY month), 6) AS delta
FROM (SELECT {_dim}, month, count(*) AS n, avg(on_time) AS rate FROM trips GROUP BY 1, 2)""", "trips"))


def no_show_every_month(spark: SparkSession, sf: str) -> DataFrame:
    return roles.legs(spark, sf, "signintype", "month", "is_no_show").groupBy("signintype", "month").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("is_no_show"), 1)).alias("noshows"), share(F.count(F.when(F.col("is_no_show"), 1)), F.count("*")).alias("rate"))


BOOK.add("E2_noshow_every_month", no_show_every_month, with_roles("""SELECT signintype, month, count(*) AS n, count(*) FILTER (WHERE is_no_show) AS noshows, round(count(*) FILTER (WHERE is_no_show) / count(*), 6) AS rate
FROM legs GROUP BY 1, 2""", "legs"))


def segment_reversal(spark: SparkSession, sf: str) -> DataFrame:
    """Unit cost by year, per billing regime and overall, with the change from the year before."""
    rows = roles.bills(spark, sf, "billing_regime", "month", "trip_cost", "total_trip_km").withColumn("year", F.year("month"))
    cells = rows.groupBy(F.col("billing_regime").alias("segment"), "year").agg(F.sum("trip_cost").alias("cost"), F.sum("total_trip_km").alias("km"))
    both = cells.unionByName(cells.groupBy("year").agg(F.sum("cost").alias("cost"), F.sum("km").alias("km")).withColumn("segment", F.lit("ALL")))
    unit = both.withColumn("unit", F.col("cost") / F.nullif(F.col("km"), F.lit(0)))
    before = F.lag("unit").over(W.partitionBy("segment").orderBy("year"))
    return unit.select("segment", "year", F.round("unit", 6).alias("unit"), F.round(F.col("unit") - before, 6).alias("change"))


BOOK.add("C24_reversal_every_year", segment_reversal, with_roles("""SELECT segment, year, round(u, 6) AS unit, round(u - lag(u) OVER (PARTITION BY segment ORDER BY year), 6) AS change
FROM (SELECT CASE WHEN grouping(billing_regime) = 1 THEN 'ALL' ELSE billing_regime END AS segment, CAST(year(month) AS INTEGER) AS year, CAST(sum(trip_cost) AS DOUBLE) / nullif(sum(total_trip_km), 0) AS u
      FROM bills GROUP BY GROUPING SETS ((billing_regime, year(month)), (year(month))))""", "bills"))
