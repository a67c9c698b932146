"""Robust statistics, movement scan, ranking, standing outliers and attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.functions import robust
from tripscope.operators import anomaly, attribution
from tripscope.operators import metrics as M
from tripscope.plans.metrics import (
    _FORMULA, GATE, KEYS, MONTHS, SPECS, kept, observations_for, observed_sql, r, rounded, sliced_sql, slices_for,
)
from tripscope.plans.registry import Book
from tripscope.plans.role_sql import with_roles
from tripscope.sources import roles

BOOK = Book()
ALL_IDS = tuple(_FORMULA)


def found_for(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.findings(observations_for(spark, sf), SPECS, GATE)


def ranked_for(spark: SparkSession, sf: str, top_n: int | None = anomaly.TOP_N) -> DataFrame:
    return anomaly.rank(found_for(spark, sf), SPECS, top_n)


def contributions_for(spark: SparkSession, sf: str) -> DataFrame:
    return kept(spark, sf, "contributions", lambda: attribution.contributions(observations_for(spark, sf), SPECS, MONTHS, GATE))


def attributed_for(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.attribution(contributions_for(spark, sf))


# --- SQL side ------------------------------------------------------------------------------------------------------

_HIGHER = "metric_id IN ('ota', 'escort_compliance', 'occupancy')"
_RATE = "metric_id NOT IN ('delay_p90', 'cost_per_km', 'cost_per_trip')"

FINDINGS_CTE = f"""
past AS (SELECT o.metric_id, o.grain, o.entity, o.period, h.value FROM measured o JOIN measured h
    ON h.metric_id = o.metric_id AND h.grain = o.grain AND h.entity = o.entity AND h.pos BETWEEN o.pos - 11 AND o.pos - 1),
pmed AS (SELECT metric_id, grain, entity, period, count(*) AS hn, median(value) AS med FROM past GROUP BY ALL),
pmad AS (SELECT metric_id, grain, entity, period, any_value(hn) AS hn, any_value(med) AS med, median(abs(value - med)) AS mad,
    avg(abs(value - med)) AS dev FROM past JOIN pmed USING (metric_id, grain, entity, period) GROUP BY 1, 2, 3, 4),
mv0 AS (SELECT * FROM obs WHERE delta IS NOT NULL AND n >= {GATE} AND prior_n >= {GATE}),
xmed AS (SELECT metric_id, grain, period, count(*) AS cn, median(delta) AS med FROM mv0 GROUP BY ALL),
xmad AS (SELECT metric_id, grain, period, any_value(cn) AS cn, any_value(med) AS med, median(abs(delta - med)) AS mad,
    avg(abs(delta - med)) AS dev FROM mv0 JOIN xmed USING (metric_id, grain, period) GROUP BY 1, 2, 3),
mv1 AS (SELECT m.*,
    CASE WHEN x.cn < 3 THEN 0 WHEN x.mad > 1e-12 THEN 0.6745 * (m.delta - x.med) / x.mad
      WHEN x.dev > 1e-12 THEN (m.delta - x.med) / (1.2533 * x.dev) ELSE 0 END AS zc,
    CASE WHEN coalesce(p.hn, 0) < 4 THEN 0 WHEN p.mad > 1e-12 THEN 0.6745 * (m.value - p.med) / p.mad
      WHEN p.dev > 1e-12 THEN (m.value - p.med) / (1.2533 * p.dev) ELSE 0 END AS zt
  FROM mv0 m LEFT JOIN xmad x USING (metric_id, grain, period) LEFT JOIN pmad p USING (metric_id, grain, entity, period)),
moves AS (SELECT *, CASE WHEN abs(zt) >= abs(zc) THEN zt ELSE zc END AS z,
    CASE WHEN {_RATE} THEN delta * 100 ELSE delta END AS points,
    CASE WHEN {_HIGHER} THEN delta < 0 ELSE delta > 0 END AS adverse FROM mv1),
found AS (SELECT *, concat_ws(':', regexp_replace(lower(metric_id), '[^a-z0-9]+', '_', 'g'),
    regexp_replace(lower(grain), '[^a-z0-9]+', '_', 'g'), regexp_replace(lower(trim(entity)), '[^a-z0-9]+', '_', 'g'),
    replace(strftime(period, '%Y-%m'), '-', '_')) AS finding_id
  FROM moves WHERE abs(z) >= 2 OR (adverse AND CASE WHEN {_RATE} THEN abs(points) >= 1.0
    ELSE abs(prior) > 1e-12 AND abs(delta) >= abs(prior) * 0.10 END))"""


def ranked_cte(source: str = "found", streak: str = "NULL", suppression: str = "0") -> str:
    return f"""
scored AS (SELECT *, rank_severity * rank_confidence * actionability * persistence * (1 - {suppression}) AS score FROM (
  SELECT *, CASE WHEN severity > 0 THEN least(severity, 1) ELSE least(abs(z) / 5, 1) * CASE WHEN adverse THEN 1 ELSE 0.5 END END
      AS rank_severity,
    least(ln(1 + n) / ln(5001), 1) * (0.6 + 0.4 * least(coverage, 1)) AS rank_confidence,
    CASE grain WHEN 'office' THEN 1.0 WHEN 'route_source' THEN 1.0 WHEN 'product_type' THEN 1.0 WHEN 'business_unit' THEN 0.9
      WHEN 'contract' THEN 0.85 WHEN 'shift_type' THEN 0.8 WHEN 'trip_direction' THEN 0.8 WHEN 'delay_reason' THEN 0.7
      WHEN 'trip_nodal' THEN 0.6 ELSE 0.5 END AS actionability,
    least(1, 0.7 + 0.15 * (CASE WHEN {streak} IS NOT NULL THEN greatest({streak}, 1) WHEN sla_breached AND CASE WHEN {_HIGHER} THEN prior < sla_target - 1e-9
      ELSE prior > sla_target + 1e-9 END THEN 2 ELSE 1 END - 1)) AS persistence
  FROM {source} WHERE (adverse OR abs(z) >= 8) AND (abs(points) >= 0.5 OR sla_breached))),
placed AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY score DESC, abs(points) DESC, finding_id) AS place
  FROM scored WHERE score > 1e-6),
ranked AS (SELECT * FROM placed WHERE place <= 20)"""


def found_sql(body: str, extra: str = "") -> str:
    return observed_sql(body, ALL_IDS, FINDINGS_CTE.strip() + (",\n" + extra.strip() if extra else ""))


ATTRIBUTION_CTE = f"""
pairs AS (SELECT coalesce(c.metric_id, p.metric_id) AS metric_id, coalesce(c.grain, p.grain) AS grain,
    coalesce(c.entity, p.entity) AS entity, coalesce(c.period, p.period) AS period, c.value AS r1, c.n AS n1, p.value AS r0, p.n AS n0
  FROM slices c FULL OUTER JOIN (SELECT metric_id, grain, entity, CAST(period + INTERVAL {MONTHS} MONTH AS DATE) AS period, value, n
    FROM slices) p ON c.metric_id = p.metric_id AND c.grain = p.grain AND c.entity = p.entity AND c.period = p.period),
whole AS (SELECT metric_id, period, r1 - r0 AS actual FROM pairs WHERE grain = 'global' AND r1 - r0 IS NOT NULL),
elig0 AS (SELECT p.*, w.actual, count(*) OVER (PARTITION BY p.metric_id, grain, p.period) AS ne
  FROM pairs p JOIN whole w ON w.metric_id = p.metric_id AND w.period = p.period
  WHERE grain <> 'global' AND greatest(coalesce(n1, 0), coalesce(n0, 0)) >= {GATE} AND (r1 IS NOT NULL OR r0 IS NOT NULL)),
elig AS (SELECT metric_id, grain, entity, period, actual, ne, coalesce(r1, 0) AS r1, coalesce(r0, 0) AS r0,
    CASE WHEN r1 IS NOT NULL THEN n1 ELSE 0 END AS w1, CASE WHEN r0 IS NOT NULL THEN n0 ELSE 0 END AS w0,
    r1 IS NOT NULL AND r0 IS NOT NULL AS in_both FROM elig0 WHERE ne >= 2),
tot AS (SELECT metric_id, grain, period, sum(w1) AS t1, sum(w0) AS t0, CASE WHEN sum(w0) > 0 THEN sum(w0 * r0) / sum(w0) ELSE 0 END AS b0,
    CASE WHEN sum(w1) > 0 THEN sum(w1 * r1) / sum(w1) ELSE 0 END AS b1 FROM elig GROUP BY ALL),
con0 AS (SELECT e.*, b0, b1, coalesce(w1 / nullif(t1, 0), 0) AS s1, coalesce(w0 / nullif(t0, 0), 0) AS s0
  FROM elig e JOIN tot USING (metric_id, grain, period)),
con1 AS (SELECT *, s1 * (r1 - r0) AS rate_effect, (s1 - s0) * (r0 - b0) AS mix_effect, s1 * (r1 - r0) + (s1 - s0) * (r0 - b0) AS total FROM con0),
con AS (SELECT *, row_number() OVER (PARTITION BY metric_id, grain, period ORDER BY round(abs(total), 9) DESC, entity) AS place FROM con1),
at0 AS (SELECT metric_id, grain, period, any_value(actual) AS delta, count(*) AS n_entities,
    sum(total) FILTER (WHERE place <= 3) AS explained_delta, sum(abs(total)) AS gross_total, sum(abs(mix_effect)) AS gross_mix,
    least(1, coalesce(sum(abs(total)) FILTER (WHERE place <= 3) / CASE WHEN sum(abs(total)) > 1e-12 THEN sum(abs(total)) END, 0)) AS concentration,
    CASE WHEN abs(any_value(actual)) > 1e-12 THEN least(1, abs(sum(total) FILTER (WHERE place <= 3)) / abs(any_value(actual))) ELSE 0 END AS explained,
    abs(sum(total) - any_value(actual)) AS reconciliation_error,
    coalesce(sum(w1 * abs(r1 - r0 - actual)) FILTER (WHERE in_both) / nullif(sum(w1) FILTER (WHERE in_both), 0), 0) AS dev,
    coalesce(sum(w1 * abs(r1 - r0)) FILTER (WHERE in_both) / nullif(sum(w1) FILTER (WHERE in_both), 0), 0) AS mov,
    CAST(sum(w1) AS BIGINT) AS sample_size, min(entity) FILTER (WHERE place = 1) AS leader FROM con GROUP BY 1, 2, 3),
at1 AS (SELECT *, CASE WHEN greatest(mov, abs(delta)) > 1e-12 THEN least(1, dev / greatest(mov, abs(delta))) ELSE 0 END AS dispersion,
    gross_mix / nullif(gross_total, 0) AS mix_fraction FROM at0),
at2 AS (SELECT *, explained * concentration * (0.25 + 0.75 * dispersion) AS power FROM at1),
att AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric_id, period ORDER BY round(power, 9) DESC, grain) AS INTEGER) AS grain_rank,
    CASE WHEN mix_fraction < 0.10 THEN 'rate' WHEN mix_fraction IS NOT NULL THEN 'mix' END AS verdict FROM at2)"""


def attributed_sql(body: str, extra: str = "") -> str:
    return sliced_sql(body, ALL_IDS, ATTRIBUTION_CTE.strip() + (",\n" + extra.strip() if extra else ""))


def everything_sql(body: str, extra: str = "") -> str:
    """Observations, findings, ranking and attribution together."""
    return found_sql(body, ranked_cte() + ",\n" + ATTRIBUTION_CTE.strip() + (",\n" + extra.strip() if extra else ""))


# --- robust statistics ---------------------------------------------------------------------------------------------

_COHORT = ["metric_id", "grain", "period"]


def _sample(spark, sf):
    """One array per cohort: the measured values of the entities of a grain in a period."""
    return (
        observations_for(spark, sf).filter("grain <> 'global' and value is not null").groupBy(*_COHORT).agg(F.collect_list("value").alias("xs"))
    )


BOOK.add(
    "A1_median",
    lambda spark, sf: _sample(spark, sf).select(*_COHORT, F.round(robust.array_median(F.col("xs")), 6).alias("median")),
    sliced_sql("SELECT metric_id, grain, period, round(median(value), 6) AS median FROM slices WHERE grain <> 'global' AND value IS NOT NULL GROUP BY 1, 2, 3"),
)
BOOK.add(
    "A2_mad",
    lambda spark, sf: _sample(spark, sf).select(*_COHORT, F.round(robust.array_mad(F.col("xs")), 6).alias("mad")),
    sliced_sql("SELECT metric_id, grain, period, round(mad(value), 6) AS mad FROM slices WHERE grain <> 'global' AND value IS NOT NULL GROUP BY 1, 2, 3"),
)
BOOK.add(
    "A3_robust_z",
    lambda spark, sf: robust.with_cohort_z(
        observations_for(spark, sf).filter("grain <> 'global' and value is not null"), "value", W.partitionBy(*_COHORT), "z"
    ).select(*KEYS, F.round("z", 6).alias("z")),
    sliced_sql(
        """SELECT metric_id, grain, entity, period, round(CASE WHEN m > 1e-12 THEN 0.6745 * (value - med) / m
  WHEN dev > 1e-12 THEN (value - med) / (1.2533 * dev) ELSE 0 END, 6) AS z
FROM (SELECT *, median(abs(value - med)) OVER w AS m, avg(abs(value - med)) OVER w AS dev
  FROM (SELECT *, median(value) OVER (PARTITION BY metric_id, grain, period) AS med FROM slices WHERE grain <> 'global' AND value IS NOT NULL)
  WINDOW w AS (PARTITION BY metric_id, grain, period))"""
    ),
)


def _ewma(spark, sf):
    last = W.partitionBy("metric_id", "grain", "entity").orderBy(F.col("period").desc())
    h = M.history(observations_for(spark, sf), 12).withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    return h.select("metric_id", "grain", "entity", "period", F.round(robust.ewma(F.col("history"), 0.3), 6).alias("ewma"))


BOOK.add(
    "A4_ewma",
    _ewma,
    sliced_sql(
        """SELECT metric_id, grain, entity, max(period) AS period,
  round(sum(value * CASE WHEN pos = 1 THEN pow(0.7, m - 1) ELSE 0.3 * pow(0.7, m - pos) END), 6) AS ewma
FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, grain, entity ORDER BY period) AS pos, count(*) OVER (PARTITION BY metric_id, grain, entity) AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY metric_id, grain, entity ORDER BY period DESC) AS back FROM slices WHERE value IS NOT NULL)
  WHERE back <= 12) GROUP BY 1, 2, 3"""
    ),
)

# --- scan and ranking ----------------------------------------------------------------------------------------------


def _cols(names: list[str], floats: list[str]) -> str:
    return ", ".join(r(c) if c in floats else c for c in names)


def _scan(name: str, fn, cols: list[str], floats: list[str], source: str, extra: str = "", where: str = "true") -> None:
    BOOK.add(
        name,
        lambda spark, sf: rounded(fn(spark, sf), *floats).select(*cols),
        found_sql(f"SELECT {_cols(cols, floats)} FROM {source} WHERE {where}", extra),
    )


_scan("A5_movement_join", lambda s, d: anomaly.movements(observations_for(s, d), SPECS, GATE), [*KEYS, "value", "prior", "delta", "n", "prior_n"], ["value", "prior", "delta"], "moves")
_scan("A6_movement_score", lambda s, d: anomaly.movements(observations_for(s, d), SPECS, GATE), [*KEYS, "z"], ["z"], "moves")
_scan("A7_significance", found_for, [*KEYS, "delta", "adverse", "z"], ["delta", "z"], "found")
_scan("A8_points_and_id", found_for, ["finding_id", "points"], ["points"], "found")
_scan("A10_worth_surfacing", lambda s, d: found_for(s, d).filter(anomaly.worth_surfacing()), ["finding_id", "points", "z", "adverse", "sla_breached"], ["points", "z"], "found", where="(adverse OR abs(z) >= 8) AND (abs(points) >= 0.5 OR sla_breached)")
_scan("A11_ranking_severity", lambda s, d: ranked_for(s, d, None), ["finding_id", "rank_severity"], ["rank_severity"], "placed", ranked_cte())
_scan("A12_confidence", lambda s, d: ranked_for(s, d, None), ["finding_id", "n", "rank_confidence"], ["rank_confidence"], "placed", ranked_cte())
_scan("A13_actionability", lambda s, d: ranked_for(s, d, None), ["finding_id", "grain", "actionability"], ["actionability"], "placed", ranked_cte())
_scan("A14_persistence", lambda s, d: ranked_for(s, d, None), ["finding_id", "persistence"], ["persistence"], "placed", ranked_cte())
_scan("A15_top_findings", ranked_for, ["period", "place", "finding_id", "score", "points", "z"], ["score", "points", "z"], "ranked", ranked_cte())


def _attached(spark, sf):
    """Global findings carry the winning grain's contributions, the others their own grain's."""
    att = attributed_for(spark, sf)
    winner = att.filter("grain_rank = 1").select("metric_id", "period", F.col("grain").alias("winner"))
    top = F.filter(F.array_sort(F.collect_list(F.struct("place", "entity", F.round("total", 6).alias("total")))), lambda c: c["place"] <= 3)
    parts = contributions_for(spark, sf).groupBy("metric_id", F.col("grain").alias("source_grain"), "period").agg(
        F.count("*").alias("n_contributions"), F.concat_ws("|", F.transform(top, lambda c: c["entity"])).alias("leaders")
    )
    return (
        found_for(spark, sf)
        .join(winner, ["metric_id", "period"], "left")
        .withColumn("source_grain", F.when(F.col("grain") == "global", F.col("winner")).otherwise(F.col("grain")))
        .join(parts, ["metric_id", "source_grain", "period"], "left")
        .select("finding_id", "source_grain", F.coalesce("n_contributions", F.lit(0).cast("bigint")).alias("n_contributions"), "leaders")
    )


BOOK.add(
    "A9_contribution_attachment",
    _attached,
    everything_sql(
        """SELECT f.finding_id, CASE WHEN f.grain = 'global' THEN w.grain ELSE f.grain END AS source_grain,
  coalesce(c.nc, 0) AS n_contributions, c.leaders
FROM found f LEFT JOIN (SELECT metric_id, period, grain FROM att WHERE grain_rank = 1) w ON w.metric_id = f.metric_id AND w.period = f.period
LEFT JOIN (SELECT metric_id, grain, period, count(*) AS nc, string_agg(entity, '|' ORDER BY place) FILTER (WHERE place <= 3) AS leaders
  FROM con GROUP BY 1, 2, 3) c ON c.metric_id = f.metric_id AND c.period = f.period
  AND c.grain = CASE WHEN f.grain = 'global' THEN w.grain ELSE f.grain END"""
    ),
)
BOOK.add(
    "A17_standing_outliers",
    lambda spark, sf: rounded(anomaly.standing_outliers(observations_for(spark, sf), SPECS), "value", "median", "z").select(
        "period", "place", "metric_id", "grain", "entity", "value", "median", "z", "rank", "peers", "n"
    ),
    sliced_sql(
        f"""SELECT period, place, metric_id, grain, entity, {r('value')}, round(med, 6) AS median, round(z, 6) AS z, rank, peers, n FROM (
  SELECT *, row_number() OVER (PARTITION BY period ORDER BY abs(z) DESC, metric_id, grain, entity) AS place FROM (
    SELECT *, 0.6745 * (value - med) / m AS z FROM (
      SELECT *, median(abs(value - med)) OVER (PARTITION BY metric_id, grain, period) AS m FROM (
        SELECT *, median(value) OVER c AS med, count(*) OVER c AS peers, row_number() OVER (PARTITION BY metric_id, grain, period
            ORDER BY CASE WHEN {_HIGHER} THEN -value ELSE value END, entity) AS rank
        FROM slices WHERE grain <> 'global' AND value IS NOT NULL WINDOW c AS (PARTITION BY metric_id, grain, period)))
    WHERE peers >= 5 AND m > 0)
  WHERE abs(z) >= 3.5 AND CASE WHEN {_HIGHER} THEN z < 0 ELSE z > 0 END
    AND CASE WHEN {_RATE} THEN abs(value - med) >= 0.01 WHEN abs(med) < 1e-9 THEN abs(value - med) > 1e-9
      ELSE abs(value - med) >= abs(med) * 0.25 END)
WHERE place <= 20"""
    ),
)
BOOK.add(
    "A17_every_standing_outlier",
    lambda spark, sf: rounded(anomaly.standing_outliers(observations_for(spark, sf), SPECS, None), "value", "median", "z").select(
        "period", "place", "metric_id", "grain", "entity", "value", "median", "z", "rank", "peers", "n"
    ),
    BOOK.sql["A17_standing_outliers"].replace("WHERE place <= 20", ""),
)

# --- attribution ---------------------------------------------------------------------------------------------------


def _att(name: str, cols: list[str], floats: list[str], detail: bool = False) -> None:
    fn = contributions_for if detail else attributed_for
    BOOK.add(
        name,
        lambda spark, sf: rounded(fn(spark, sf), *floats).select(*cols),
        attributed_sql(f"SELECT {_cols(cols, floats)} FROM {'con' if detail else 'att'}"),
    )


_att("T1_rate_mix", [*KEYS, "rate_effect", "mix_effect", "total", "place"], ["rate_effect", "mix_effect", "total"], True)
BOOK.add(
    "T2_base_rate",
    lambda spark, sf: rounded(
        contributions_for(spark, sf).groupBy(*_COHORT).agg(F.first("base_rate").alias("base_rate"), F.first("current_rate").alias("current_rate"))
        .withColumn("implied_delta", F.col("current_rate") - F.col("base_rate")), "base_rate", "current_rate", "implied_delta"
    ),
    attributed_sql("SELECT metric_id, grain, period, round(b0, 6) AS base_rate, round(b1, 6) AS current_rate, round(b1 - b0, 6) AS implied_delta FROM tot"),
)
BOOK.add(
    "T3_reconciliation",
    lambda spark, sf: rounded(
        attribution.reconciliation(contributions_for(spark, sf), _COHORT)
        .join(contributions_for(spark, sf).groupBy(*_COHORT).agg(F.max(F.greatest(F.abs("base_rate"), F.abs("current_rate"), F.lit(1.0))).alias("size")), _COHORT)
        .withColumn("reconciles", F.col("error") <= F.col("size") * 1e-9), "explained", "implied_delta"
    ).drop("error", "size"),
    attributed_sql(
        """SELECT c.metric_id, c.grain, c.period, round(sum(total), 6) AS explained, round(any_value(t.b1 - t.b0), 6) AS implied_delta,
  abs(sum(total) - any_value(t.b1 - t.b0)) <= greatest(max(abs(t.b0)), max(abs(t.b1)), 1) * 1e-9 AS reconciles FROM con c JOIN tot t USING (metric_id, grain, period) GROUP BY 1, 2, 3"""
    ),
)
_att("T4_eligibility", [*_COHORT, "n_entities", "sample_size"], [])
_att("T5_concentration", [*_COHORT, "concentration"], ["concentration"])
_att("T6_explained", [*_COHORT, "delta", "explained_delta", "explained"], ["delta", "explained_delta", "explained"])
_att("T7_dispersion", [*_COHORT, "dispersion"], ["dispersion"])
_att("T8_explanatory_power", [*_COHORT, "power", "grain_rank", "leader", "reconciliation_error"], ["power", "reconciliation_error"])
_att("T9_rate_or_mix", [*_COHORT, "mix_fraction", "verdict"], ["mix_fraction"])

_TWO_SQL = """
a AS (SELECT quarter, {e} AS entity, avg(on_time) AS v, count(*) AS n FROM trips GROUP BY 1, 2),
p AS (SELECT coalesce(c.quarter, b.q) AS period, coalesce(c.entity, b.entity) AS entity, coalesce(c.v, 0) AS r1, coalesce(c.n, 0) AS w1,
    coalesce(b.v, 0) AS r0, coalesce(b.n, 0) AS w0
  FROM a c FULL OUTER JOIN (SELECT CAST(quarter + INTERVAL 3 MONTH AS DATE) AS q, entity, v, n FROM a) b ON b.q = c.quarter AND b.entity = c.entity),
t AS (SELECT period, sum(w1) AS t1, sum(w0) AS t0, sum(w0 * r0) / sum(w0) AS b0, sum(w1 * r1) / sum(w1) AS b1 FROM p GROUP BY 1 HAVING sum(w1) > 0 AND sum(w0) > 0)"""


def _two(spark, sf):
    return attribution.two_period(roles.trips(spark, sf, "quarter", "vendor_id", "on_time"), "quarter", "vendor_id", "on_time", 3)


BOOK.add(
    "T10_two_period_vendor",
    lambda spark, sf: rounded(_two(spark, sf), "rate_effect", "mix_effect", "total").select("period", "entity", "rate_effect", "mix_effect", "total"),
    with_roles(
        """SELECT period, entity, round(w1 / t1 * (r1 - r0), 6) AS rate_effect, round((w1 / t1 - w0 / t0) * (r0 - b0), 6) AS mix_effect,
  round(w1 / t1 * (r1 - r0) + (w1 / t1 - w0 / t0) * (r0 - b0), 6) AS total FROM p JOIN t USING (period)""",
        "trips", extra=_TWO_SQL.format(e="vendor_id"),
    ),
)
BOOK.add(
    "T10_two_period_check",
    lambda spark, sf: rounded(attribution.reconciliation(_two(spark, sf), ["period"]), "explained", "implied_delta", "error"),
    with_roles("SELECT period, round(b1 - b0, 6) AS explained, round(b1 - b0, 6) AS implied_delta, 0.0::DOUBLE AS error FROM t", "trips", extra=_TWO_SQL.format(e="vendor_id")),
)
BOOK.add(
    "T11_counterfactual",
    lambda spark, sf: rounded(
        attribution.counterfactual(
            roles.bills(spark, sf, "quarter", "contract", "trip_cost", "total_trip_km", "billing_regime").filter("billing_regime = 'DISTANCE_BASED'"),
            "quarter", "contract", "trip_cost", "total_trip_km", 3,
        ),
        "rate_now", "repriced", "rate_before", "rate_effect", "mix_effect", places=4,
    ),
    with_roles(
        """SELECT period, round(rn, 4) AS rate_now, round(rp, 4) AS repriced, round(rb, 4) AS rate_before, round(rn - rp, 4) AS rate_effect,
  round(rp - rb, 4) AS mix_effect FROM (SELECT c.quarter AS period, sum(c.num) / sum(c.e) AS rn, sum(b.num / b.e * c.e) / sum(c.e) AS rp, sum(b.num) / sum(b.e) AS rb
  FROM a c JOIN a b ON b.contract = c.contract AND c.quarter = b.quarter + INTERVAL 3 MONTH WHERE c.e > 0 AND b.e > 0 GROUP BY 1)""",
        "bills",
        extra="a AS (SELECT quarter, contract, sum(trip_cost) AS num, sum(total_trip_km) AS e FROM bills WHERE billing_regime = 'DISTANCE_BASED' GROUP BY 1, 2)",
    ),
)


def _mix_adjusted(spark, sf):
    cells = roles.trips(spark, sf, "quarter", "product_type", "on_time").groupBy("quarter", "product_type").agg(F.avg("on_time").alias("rate"), F.count("*").alias("n"))
    first = F.min("quarter").over(W.partitionBy(F.lit(1)))
    cells = cells.withColumn("base_n", F.max(F.when(F.col("quarter") == first, F.col("n"))).over(W.partitionBy("product_type")))
    return cells.groupBy("quarter").agg(
        F.round(F.sum(F.col("rate") * F.col("base_n")) / F.sum("base_n"), 6).alias("adjusted"),
        F.round(F.sum(F.col("rate") * F.col("n")) / F.sum("n"), 6).alias("raw"),
    )


BOOK.add(
    "T12_mix_adjusted_rate",
    _mix_adjusted,
    with_roles(
        """SELECT c.quarter, round(sum(c.rate * b.n) / sum(b.n), 6) AS adjusted, round(sum(c.rate * c.n) / sum(c.n), 6) AS raw
FROM cells c LEFT JOIN cells b ON b.product_type = c.product_type AND b.quarter = (SELECT min(quarter) FROM trips) GROUP BY 1""",
        "trips", extra="cells AS (SELECT quarter, product_type, avg(on_time) AS rate, count(*) AS n FROM trips GROUP BY 1, 2)",
    ),
)
BOOK.add(
    "T13_mix_share",
    lambda spark, sf: roles.trips(spark, sf, "quarter", "product_type").groupBy("quarter", "product_type").agg(F.count("*").alias("n"))
    .withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("quarter")), 6)),
    with_roles("SELECT quarter, product_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quarter), 6) AS share FROM trips GROUP BY 1, 2", "trips"),
)
