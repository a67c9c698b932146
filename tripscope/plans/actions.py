"""Policy, incident, follow-up, delivery, memory and grounding queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.operators import anomaly, attribution, grounding, incidents as I, life_cycle, policy
from tripscope.operators import metrics as M
from tripscope.plans.metrics import KEYS, KEYS_SQL, MONTHS, SPECS, kept, observations_for, observed_sql, r, rounded
from tripscope.plans.movement import FINDINGS_CTE, ATTRIBUTION_CTE, attributed_for, everything_sql, found_for, found_sql, ranked_cte, ranked_for
from tripscope.plans.registry import Book
from tripscope.session import shared_dir
from tripscope.sources import roles, state

BOOK = Book()


def day(text: str) -> F.Column:
    return F.lit(text).cast("date")


def drafts_for(spark: SparkSession, sf: str, top_n: int | None = anomaly.TOP_N) -> DataFrame:
    return I.triage(ranked_for(spark, sf, top_n), max_members=None if top_n else 0)


def incidents_for(spark: SparkSession, sf: str, top_n: int | None = anomaly.TOP_N) -> DataFrame:
    """Incidents of the ``top_n`` findings of each period, or of all findings (None)."""

    def make() -> DataFrame:
        owners = attribution.owner_evidence(attributed_for(spark, sf))
        return I.incidents(drafts_for(spark, sf, top_n), owners, F.add_months("period", MONTHS), F.add_months("period", -MONTHS))

    return kept(spark, sf, "incidents" if top_n == anomaly.TOP_N else f"incidents-{top_n}", make)


def stored_for(spark: SparkSession, sf: str, top_n: int | None = anomaly.TOP_N) -> DataFrame:
    """Incident memory as an operator would leave it: fourth priorities dismissed, fifth ones purged."""
    return incidents_for(spark, sf, top_n).filter("priority <> 5").withColumn("status", F.when(F.col("priority") == 4, I.DISMISSED).otherwise(F.col("status")))


def dismissed_for(spark: SparkSession, sf: str, top_n: int | None = anomaly.TOP_N):
    ids = incidents_for(spark, sf, top_n).filter("priority = 4").select("incident_id")
    return I.dismiss(incidents_for(spark, sf, top_n), I.schedule(incidents_for(spark, sf, top_n)), ids, "dismissed by operator", day("2001-12-31"))


INCIDENT_CTE = f"""
r1 AS (SELECT *, metric_id || ':' || CASE WHEN points < 0 THEN 'down' ELSE 'up' END AS cluster_key FROM ranked),
r2 AS (SELECT *, row_number() OVER (PARTITION BY period, cluster_key ORDER BY score DESC, finding_id) AS m FROM r1),
d0 AS (SELECT period, cluster_key, min(place) AS first_place, count(*) AS n_members,
    string_agg(finding_id, '|' ORDER BY m) AS finding_ids FROM r2 GROUP BY 1, 2),
d1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY period ORDER BY first_place) AS INTEGER) AS priority FROM d0),
drafts AS (SELECT d.period, d.cluster_key, n_members, finding_ids, priority, finding_id, metric_id, grain, entity, value, prior, points, n, z, score,
    severity, coverage FROM d1 d JOIN r2 l ON l.period = d.period AND l.cluster_key = d.cluster_key AND l.m = 1),
owners AS (SELECT metric_id, period, max(grain) FILTER (WHERE grain_rank = 1) AS winner, max(leader) FILTER (WHERE grain_rank = 1) AS winner_entity,
    max(power) FILTER (WHERE grain = 'vendor') AS vendor_power FROM att GROUP BY 1, 2),
dec0 AS (SELECT d.*, CASE metric_id WHEN 'ota' THEN 'SLA-OTA-001' WHEN 'escort_compliance' THEN 'SLA-ESCORT-001' WHEN 'cost_per_km' THEN 'SLA-CPK-001'
      ELSE 'SLA-NONE-000' END AS rule_id,
    coalesce(CASE metric_id WHEN 'ota' THEN (0.95 - value) / 0.95 WHEN 'escort_compliance' THEN 1 - value WHEN 'cost_per_km' THEN (value - 85) / 85 END, 0) AS rg,
    coalesce(CASE metric_id WHEN 'ota' THEN 0.95 - prior WHEN 'escort_compliance' THEN 1 - prior WHEN 'cost_per_km' THEN prior - 85 END > 0, false) AS before
  FROM drafts d),
dec AS (SELECT *, rg > 0 AS breached, CASE WHEN rg <= 0 THEN 'NONE' WHEN rg < 0.02 THEN 'MINOR' WHEN rg < 0.05 THEN 'MAJOR' ELSE 'CRITICAL' END AS band,
    CASE WHEN rg > 0 THEN 1 + before::INT ELSE 0 END AS streak FROM dec0),
inc AS (SELECT d.*, o.winner, o.winner_entity, o.vendor_power, streak >= 2 AS escalation_permitted,
    'inc-' || regexp_replace(cluster_key, '[^a-z0-9]+', '-', 'g') || '-' || strftime(d.period, '%Y-%m') AS incident_id,
    CASE WHEN breached THEN band WHEN severity >= 0.66 THEN 'MAJOR' WHEN severity >= 0.33 THEN 'MINOR' ELSE 'NONE' END AS incident_band,
    coalesce(o.winner = 'vendor' OR o.vendor_power + 1e-12 >= 0.25, false) AS vendor_supported,
    CASE WHEN d.metric_id LIKE '%escort%' THEN 'facilities_head' WHEN o.winner = 'vendor' THEN 'transport_manager' WHEN o.winner = 'shift_type' THEN 'line_manager'
      ELSE 'transport_manager' END AS persona,
    CASE WHEN d.metric_id LIKE '%escort%' THEN 'Transport & facilities head' WHEN o.winner = 'vendor' THEN 'Vendor operations'
      WHEN o.winner = 'shift_type' THEN 'Line manager — ' || coalesce(o.winner_entity, d.entity) ELSE 'Routing desk' END AS recipient,
    CASE WHEN d.metric_id LIKE '%escort%' THEN 'safety' WHEN o.winner = 'vendor' THEN 'vendor' WHEN o.winner = 'shift_type' THEN 'shift' ELSE 'routing' END AS desk,
    CAST(d.period + INTERVAL {MONTHS} MONTH AS DATE) AS detected_on, CAST(d.period + INTERVAL {MONTHS} MONTH + INTERVAL 7 DAY AS DATE) AS follow_up_on,
    concat_ws(' ', d.metric_id, d.grain, d.entity, CASE WHEN points < 0 THEN 'down' ELSE 'up' END) AS title, 'OPEN' AS status
  FROM dec d LEFT JOIN owners o ON o.metric_id = d.metric_id AND o.period = d.period),
stored AS (SELECT * REPLACE (CASE WHEN priority = 4 THEN 'DISMISSED' ELSE status END AS status) FROM inc WHERE priority <> 5),
acts AS (SELECT incident_id, persona, title, recipient, desk, streak, vendor_supported, unnest(['notify', 'vendor_escalation', 'review_allocation', 'auto_reallocate']) AS type FROM inc),
acts2 AS (SELECT incident_id, persona, title, type, CASE WHEN type = 'vendor_escalation' AND desk <> 'vendor' THEN 'Vendor operations' ELSE recipient END AS recipient,
    type = 'notify' OR (type = 'vendor_escalation' AND streak >= 2 AND vendor_supported) AS permitted FROM acts),
sup AS (SELECT incident_id, metric_id, entity FROM inc WHERE priority = 4),
muted AS (SELECT DISTINCT f.finding_id FROM found f JOIN sup s ON lower(s.metric_id) = lower(f.metric_id) AND lower(s.entity) = lower(f.entity)),
fu AS (SELECT incident_id, metric_id, grain, entity, period AS origin, CAST(detected_on + 7 AS DATE) AS due_on, 'PENDING' AS state FROM inc)"""


def incident_sql(body: str, extra: str = "") -> str:
    return everything_sql(body, INCIDENT_CTE.strip() + (",\n" + extra.strip() if extra else ""))


# --- policy ----------------------------------------------------------------------------------------------------------

_RULED = ("ota", "escort_compliance", "cost_per_km", "noshow_rate")
_RULED_SPECS = {k: SPECS[k] for k in _RULED}


def _ruled(spark, sf):
    return observations_for(spark, sf).filter(F.col("metric_id").isin(*_RULED) & F.col("value").isNotNull())


_REL = "CASE metric_id WHEN 'ota' THEN (0.95 - value) / 0.95 WHEN 'escort_compliance' THEN 1 - value WHEN 'cost_per_km' THEN (value - 85) / 85 END"
_where = "metric_id IN ('ota', 'escort_compliance', 'cost_per_km', 'noshow_rate') AND value IS NOT NULL"


def _lookup(spark, sf):
    spelled = F.upper(F.replace("metric_id", F.lit("_"), F.lit(" - ")))
    rule = policy.RuleColumns.of(spelled)
    return observations_for(spark, sf).groupBy("metric_id").agg(F.count("*").alias("n")).select(
        "metric_id", "n", policy.canonical(spelled).alias("canonical"), rule.rule_id.alias("rule_id"), rule.target.alias("target"))


BOOK.add("G1_rule_lookup", _lookup, observed_sql(
    """SELECT metric_id, count(*) AS n, metric_id AS canonical, CASE metric_id WHEN 'ota' THEN 'SLA-OTA-001' WHEN 'escort_compliance' THEN 'SLA-ESCORT-001'
  WHEN 'cost_per_km' THEN 'SLA-CPK-001' END AS rule_id, CAST(CASE metric_id WHEN 'ota' THEN 0.95 WHEN 'escort_compliance' THEN 1.0 WHEN 'cost_per_km' THEN 85.0 END AS DOUBLE) AS target
FROM slices GROUP BY 1"""))


def _rescale(spark, sf):
    rule = policy.RuleColumns.of(F.col("metric_id"))
    return _ruled(spark, sf).filter("metric_id = 'ota' and value > 0.02").select(*KEYS, F.round(rule.rescaled(F.col("value") * 100), 6).alias("rescaled"), F.round("value", 6).alias("value"))


BOOK.add("G2_ratio_rescale", _rescale, observed_sql(f"SELECT {KEYS_SQL}, round(value, 6) AS rescaled, {r('value')} FROM slices WHERE metric_id = 'ota' AND value > 0.02"))


def _gaps(spark, sf):
    rule = policy.RuleColumns.of(F.col("metric_id"))
    v = F.col("value")
    return _ruled(spark, sf).select(*KEYS, F.round(rule.gap(v), 6).alias("gap"), F.round(rule.relative_gap(v), 6).alias("relative_gap"), rule.breached(v).alias("breached"))


BOOK.add("G3_gap_and_breach", _gaps, observed_sql(
    f"""SELECT {KEYS_SQL}, round(CASE metric_id WHEN 'ota' THEN 0.95 - value WHEN 'escort_compliance' THEN 1 - value WHEN 'cost_per_km' THEN value - 85 END, 6) AS gap,
  round({_REL}, 6) AS relative_gap, coalesce({_REL} > 0, false) AS breached FROM slices WHERE {_where}"""))
BOOK.add("G4_severity_band", lambda spark, sf: _ruled(spark, sf).select(*KEYS, policy.band(F.coalesce(policy.RuleColumns.of(F.col("metric_id")).relative_gap(F.col("value")), F.lit(0.0))).alias("band")),
         observed_sql(f"""SELECT {KEYS_SQL}, CASE WHEN coalesce({_REL}, 0) <= 0 THEN 'NONE' WHEN {_REL} < 0.02 THEN 'MINOR' WHEN {_REL} < 0.05 THEN 'MAJOR' ELSE 'CRITICAL' END AS band FROM slices WHERE {_where}"""))
BOOK.add("G5_breach_streaks", lambda spark, sf: policy.breach_streaks(observations_for(spark, sf), MONTHS).select(*KEYS, "streak", "escalation_permitted"), observed_sql(
    f"""SELECT {KEYS_SQL}, CAST(streak AS INTEGER) AS streak, streak >= 2 AS escalation_permitted FROM (
  SELECT *, row_number() OVER (PARTITION BY metric_id, grain, entity, island ORDER BY period) AS streak FROM (
    SELECT *, date_diff('month', DATE '1970-01-01', period) // {MONTHS} - row_number() OVER (PARTITION BY metric_id, grain, entity ORDER BY period) AS island
    FROM obs WHERE sla_breached))"""))
BOOK.add("G5_decisions", lambda spark, sf: policy.decide(ranked_for(spark, sf)).select("finding_id", "rule_id", "breached", "band", "streak", "escalation_permitted"), found_sql(
    """SELECT finding_id, rule_id, rg > 0 AS breached, CASE WHEN rg <= 0 THEN 'NONE' WHEN rg < 0.02 THEN 'MINOR' WHEN rg < 0.05 THEN 'MAJOR' ELSE 'CRITICAL' END AS band,
  CASE WHEN rg > 0 THEN 1 + before::INT ELSE 0 END AS streak, rg > 0 AND before AS escalation_permitted
FROM (SELECT finding_id, CASE metric_id WHEN 'ota' THEN 'SLA-OTA-001' WHEN 'escort_compliance' THEN 'SLA-ESCORT-001' WHEN 'cost_per_km' THEN 'SLA-CPK-001' ELSE 'SLA-NONE-000' END AS rule_id,
  coalesce(CASE metric_id WHEN 'ota' THEN (0.95 - value) / 0.95 WHEN 'escort_compliance' THEN 1 - value WHEN 'cost_per_km' THEN (value - 85) / 85 END, 0) AS rg,
  coalesce(CASE metric_id WHEN 'ota' THEN 0.95 - prior WHEN 'escort_compliance' THEN 1 - prior WHEN 'cost_per_km' THEN prior - 85 END > 0, false) AS before FROM ranked)""", ranked_cte()))
BOOK.add("G6_permitted_actions", lambda spark, sf, top_n=anomaly.TOP_N: incidents_for(spark, sf, top_n).select("incident_id", F.inline("actions")).drop("reason"),
         incident_sql("SELECT incident_id, type, recipient, permitted FROM acts2"))
BOOK.add("G7_vendor_evidence", lambda spark, sf, top_n=anomaly.TOP_N: incidents_for(spark, sf, top_n).select("incident_id", "winner", F.round("vendor_power", 6).alias("vendor_power"), "vendor_supported"),
         incident_sql("SELECT incident_id, winner, round(vendor_power, 6) AS vendor_power, vendor_supported FROM inc"))
BOOK.add("G8_owner_routing", lambda spark, sf, top_n=anomaly.TOP_N: incidents_for(spark, sf, top_n).select("incident_id", "persona", "recipient", "desk"), incident_sql("SELECT incident_id, persona, recipient, desk FROM inc"))

# --- incidents -------------------------------------------------------------------------------------------------------

BOOK.add("I1_triage", lambda spark, sf: drafts_for(spark, sf).select("period", "cluster_key", "priority", "n_members", "finding_id", F.array_join("finding_ids", "|").alias("finding_ids")),
         incident_sql("SELECT period, cluster_key, priority, n_members, finding_id, finding_ids FROM drafts"))
BOOK.add("I2_incident_band", lambda spark, sf, top_n=anomaly.TOP_N: incidents_for(spark, sf, top_n).select("incident_id", "incident_band"), incident_sql("SELECT incident_id, incident_band FROM inc"))
BOOK.add("I3_incident_rows", lambda spark, sf, top_n=anomaly.TOP_N: incidents_for(spark, sf, top_n).select(
    "incident_id", "title", "priority", "rule_id", "breached", "streak", "escalation_permitted", "detected_on", "follow_up_on", "status",
    F.size("evidence").alias("n_evidence"), F.size("actions").alias("n_actions"), F.element_at("evidence", 1)["entity"].alias("lead_entity")),
    incident_sql("SELECT incident_id, title, priority, rule_id, breached, streak, escalation_permitted, detected_on, follow_up_on, status, 1 AS n_evidence, 4 AS n_actions, entity AS lead_entity FROM inc"))
BOOK.add("I4_keep_operator_status", lambda spark, sf, top_n=anomaly.TOP_N: I.keep_operator_status(incidents_for(spark, sf, top_n), stored_for(spark, sf, top_n)).select("incident_id", "priority", "status"),
         incident_sql("SELECT incident_id, priority, CASE WHEN priority = 4 THEN 'DISMISSED' ELSE 'OPEN' END AS status FROM inc"))
BOOK.add("I5_dismiss_incidents", lambda spark, sf, top_n=anomaly.TOP_N: dismissed_for(spark, sf, top_n)[0].select("incident_id", "status"), incident_sql("SELECT incident_id, 'DISMISSED' AS status FROM inc WHERE priority = 4"))
BOOK.add("I5_dismiss_suppressions", lambda spark, sf, top_n=anomaly.TOP_N: dismissed_for(spark, sf, top_n)[1].drop("created_on", "expires_on"),
         incident_sql("SELECT 'sup-' || incident_id AS suppression_id, metric_id, '*' AS grain, entity, 'dismissed by operator' AS reason, incident_id FROM sup"))
BOOK.add("I5_dismiss_follow_ups", lambda spark, sf, top_n=anomaly.TOP_N: dismissed_for(spark, sf, top_n)[2].select("incident_id", "state", "note"),
         incident_sql("SELECT incident_id, 'RECOVERED' AS state, 'cancelled: incident dismissed' AS note FROM inc WHERE priority = 4"))


def _muted(spark, sf, top_n: int | None = anomaly.TOP_N):
    return I.suppressed(found_for(spark, sf), dismissed_for(spark, sf, top_n)[1], day("2001-12-31"))


BOOK.add("I6_suppression_match", _muted, incident_sql("SELECT finding_id FROM muted"))


def _scheduled(spark, sf, top_n: int | None = anomaly.TOP_N):
    return I.schedule(incidents_for(spark, sf, top_n))


def _marked(spark, sf, top_n: int | None = anomaly.TOP_N):
    first = incidents_for(spark, sf, top_n).filter("priority = 1").select("incident_id")
    return I.mark_due(_scheduled(spark, sf, top_n), first, day("1998-01-01")).select("incident_id", "metric_id", "grain", "entity", "origin", "due_on", "state")


BOOK.add("I7_schedule_and_mark", _marked, incident_sql(
    "SELECT f.incident_id, f.metric_id, f.grain, f.entity, origin, CASE WHEN i.priority = 1 THEN DATE '1998-01-01' ELSE due_on END AS due_on, state FROM fu f JOIN inc i USING (incident_id)"))
BOOK.add("I8_due_follow_ups", lambda spark, sf, top_n=anomaly.TOP_N: I.due(_scheduled(spark, sf, top_n), day("1998-12-31")).select("incident_id", "due_on"), incident_sql("SELECT incident_id, due_on FROM fu WHERE due_on <= DATE '1998-12-31'"))
BOOK.add("I9_recheck_period", lambda spark, sf, top_n=anomaly.TOP_N: I.recheck_period(_scheduled(spark, sf, top_n), M.periods(observations_for(spark, sf))).select("incident_id", "origin", "recheck"), incident_sql(
    "SELECT incident_id, origin, CASE WHEN latest > origin THEN latest END AS recheck FROM fu JOIN (SELECT metric_id, max(period) AS latest FROM slices WHERE grain = 'global' GROUP BY 1) USING (metric_id)"))


def _outcomes(spark, sf, top_n: int | None = anomaly.TOP_N):
    asked = _scheduled(spark, sf, top_n).withColumn("override", F.add_months("origin", MONTHS))
    return I.outcome(I.recheck_period(asked, M.periods(observations_for(spark, sf))), stored_for(spark, sf, top_n), observations_for(spark, sf))


OUTCOME_CTE = f"""
oc AS (SELECT f.incident_id, f.metric_id, f.grain, f.entity, o.period AS recheck, o.value AS recheck_value, o.n AS recheck_n,
    CASE WHEN s.incident_id IS NULL THEN 'UNRESOLVED' WHEN s.status = 'DISMISSED' THEN 'RECOVERED' WHEN o.value IS NULL THEN 'PENDING'
      WHEN {_REL.replace("metric_id", "f.metric_id").replace("value", "o.value")} > 0 THEN 'ESCALATED' ELSE 'RECOVERED' END AS state,
    s.status, s.title, s.priority, s.streak, s.persona, s.recipient
  FROM fu f LEFT JOIN stored s USING (incident_id) LEFT JOIN slices o ON o.metric_id = f.metric_id AND o.grain = f.grain AND o.entity = f.entity
    AND o.period = f.origin + INTERVAL {MONTHS} MONTH)"""
BOOK.add("I10_follow_up_outcome", lambda spark, sf, top_n=anomaly.TOP_N: _outcomes(spark, sf, top_n).select("incident_id", F.round("recheck_value", 6).alias("recheck_value"), "recheck_n", "state"),
         incident_sql("SELECT incident_id, round(recheck_value, 6) AS recheck_value, recheck_n, state FROM oc", OUTCOME_CTE))
BOOK.add("I11_escalations", lambda spark, sf, top_n=anomaly.TOP_N: I.escalations(_outcomes(spark, sf, top_n), stored_for(spark, sf, top_n), day("2001-12-31")).select(
    "incident_id", "parent_id", "title", "priority", "streak", "incident_band", "status", "follow_up_on", F.size("evidence").alias("n_evidence")), incident_sql(
    f"""SELECT incident_id || '-esc' || greatest(streak, 1) AS incident_id, incident_id AS parent_id, 'ESCALATED: ' || title AS title, greatest(priority - 1, 1) AS priority,
  greatest(streak, 1) + 1 AS streak, CASE WHEN rg < 0.02 THEN 'MINOR' WHEN rg < 0.05 THEN 'MAJOR' ELSE 'CRITICAL' END AS incident_band, 'OPEN' AS status, DATE '2002-01-07' AS follow_up_on, 2 AS n_evidence
FROM (SELECT *, {_REL.replace("value", "recheck_value")} AS rg FROM oc WHERE state = 'ESCALATED')""", OUTCOME_CTE))
BOOK.add("I10_resolved_incidents", lambda spark, sf, top_n=anomaly.TOP_N: I.settled(stored_for(spark, sf, top_n), _outcomes(spark, sf, top_n)).select("incident_id", "status"), incident_sql(
    """SELECT s.incident_id, CASE WHEN s.status = 'OPEN' AND o.state = 'RECOVERED' AND o.recheck_value IS NOT NULL THEN 'RESOLVED' ELSE s.status END AS status
FROM stored s LEFT JOIN oc o USING (incident_id)""", OUTCOME_CTE))


def _escalated(spark, sf, top_n: int | None = anomaly.TOP_N):
    return I.escalations(_outcomes(spark, sf, top_n), stored_for(spark, sf, top_n), day("2001-12-31"))


_ESC = "(SELECT oc.incident_id || '-esc' || greatest(oc.streak, 1) AS incident_id, 'ESCALATED: ' || oc.title AS title, oc.persona, oc.recipient, s.vendor_supported, s.desk, oc.metric_id, oc.grain, oc.entity, s.period FROM oc JOIN stored s USING (incident_id) WHERE oc.state = 'ESCALATED')"
BOOK.add("I11_escalation_outbox", lambda spark, sf, top_n=anomaly.TOP_N: I.outbox(_escalated(spark, sf, top_n)), incident_sql(
    f"""SELECT incident_id || '/' || type AS message_id, incident_id, type, persona, CASE WHEN type = 'vendor_escalation' AND desk <> 'vendor' THEN 'Vendor operations' ELSE recipient END AS recipient,
  CASE WHEN type = 'notify' THEN 'Attention required — ' ELSE 'Not permitted — ' END || title AS subject, CASE WHEN type = 'notify' THEN 'SENT' ELSE 'BLOCKED' END AS state
FROM (SELECT *, unnest(['notify', 'vendor_escalation', 'auto_reallocate']) AS type FROM {_ESC}) WHERE type <> 'vendor_escalation' OR NOT vendor_supported""", OUTCOME_CTE))
BOOK.add("I11_escalation_follow_ups", lambda spark, sf, top_n=anomaly.TOP_N: I.schedule(_escalated(spark, sf, top_n)).drop("note"), incident_sql(
    f"SELECT incident_id, metric_id, grain, entity, CAST(date_trunc('month', period) AS DATE) AS origin, DATE '2002-01-07' AS due_on, 'PENDING' AS state FROM {_ESC}", OUTCOME_CTE))
BOOK.add("S7_follow_up_audit", lambda spark, sf, top_n=anomaly.TOP_N: I.follow_up_audit(_outcomes(spark, sf, top_n)).select("run_id", "stage", "at", F.substring_index("detail", " ", 2).alias("detail")), incident_sql(
    "SELECT 'follow-up-' || strftime(f.due_on, '%Y-%m') AS run_id, 'follow_up' AS stage, strftime(f.due_on, '%Y-%m-%d') AS \"at\", oc.incident_id || ' ' || oc.state AS detail FROM oc JOIN fu f USING (incident_id)", OUTCOME_CTE))
BOOK.add("I12_outbox", lambda spark, sf, top_n=anomaly.TOP_N: I.outbox(incidents_for(spark, sf, top_n)), incident_sql(
    """SELECT incident_id || '/' || type AS message_id, incident_id, type, persona, recipient, CASE WHEN type = 'notify' THEN 'Attention required — ' ELSE 'Not permitted — ' END || title AS subject,
  CASE WHEN type = 'notify' THEN 'SENT' ELSE 'BLOCKED' END AS state FROM acts2 WHERE (type = 'notify' AND permitted) OR (type IN ('vendor_escalation', 'auto_reallocate') AND NOT permitted)"""))
BOOK.add("I12_outcome_messages", lambda spark, sf, top_n=anomaly.TOP_N: I.outcome_messages(_outcomes(spark, sf, top_n), stored_for(spark, sf, top_n)), incident_sql(
    """SELECT incident_id || '/' || lower(state) AS message_id, incident_id, 'notify' AS type, CASE WHEN state = 'ESCALATED' THEN 'facilities_head' ELSE persona END AS persona,
  CASE WHEN state = 'ESCALATED' THEN 'Transport & facilities head' ELSE recipient END AS recipient, CASE WHEN state = 'ESCALATED' THEN 'ESCALATED — still breaching — ' ELSE 'Closed — ' END || title AS subject, 'SENT' AS delivery
FROM oc WHERE state IN ('RECOVERED', 'ESCALATED') AND recheck_value IS NOT NULL AND status = 'OPEN'""", OUTCOME_CTE))


def _summary(spark, sf, top_n: int | None = anomaly.TOP_N):
    trips = roles.trips(spark, sf, "quarter").groupBy(F.col("quarter").alias("period")).agg(F.count("*").alias("trips"))
    count = lambda df, name: df.groupBy("period").agg(F.count("*").alias(name))
    out = trips
    for part in (count(observations_for(spark, sf).filter("prior_n is not null"), "series"), count(found_for(spark, sf), "findings"), count(ranked_for(spark, sf, top_n), "candidates"), count(incidents_for(spark, sf, top_n), "incidents")):
        out = out.join(part, "period", "left")
    return out.fillna(0, ["series", "findings", "candidates", "incidents"])


BOOK.add("I13_run_summary", _summary, incident_sql(
    """SELECT t.period, trips, coalesce(series, 0) AS series, coalesce(findings, 0) AS findings, coalesce(candidates, 0) AS candidates, coalesce(incidents, 0) AS incidents
FROM (SELECT quarter AS period, count(*) AS trips FROM trips GROUP BY 1) t LEFT JOIN (SELECT period, count(*) AS series FROM obs WHERE prior_n IS NOT NULL GROUP BY 1) USING (period)
LEFT JOIN (SELECT period, count(*) AS findings FROM found GROUP BY 1) USING (period) LEFT JOIN (SELECT period, count(*) AS candidates FROM ranked GROUP BY 1) USING (period)
LEFT JOIN (SELECT period, count(*) AS incidents FROM inc GROUP BY 1) USING (period)"""))
BOOK.add("I14_entity_ranking", lambda spark, sf: rounded(I.ranking(observations_for(spark, sf), SPECS), "median", "leader_value", "tail_value"), observed_sql(
    """SELECT metric_id, grain, period, count(*) AS entities, arg_min(entity, peer_rank) AS leader, arg_max(entity, peer_rank) AS tail, max(entity) FILTER (WHERE peer_rank = 2) AS runner_up,
  round(max(peer_median), 6) AS median, round(arg_min(value, peer_rank), 6) AS leader_value, round(arg_max(value, peer_rank), 6) AS tail_value
FROM obs WHERE value IS NOT NULL AND peer_rank IS NOT NULL GROUP BY 1, 2, 3"""))
_PROFILE = ["value", "prior", "delta", "robust_z", "sla_gap", "peer_median", "severity"]
BOOK.add("I15_entity_profile", lambda spark, sf: rounded(observations_for(spark, sf).filter("grain = 'business_unit' and entity = 'EUROPE'"), *_PROFILE).select("metric_id", "period", *_PROFILE, "peer_rank", "sla_breached", "confidence"), observed_sql(
    f"SELECT metric_id, period, {', '.join(r(c) for c in _PROFILE)}, peer_rank, sla_breached, confidence FROM obs WHERE grain = 'business_unit' AND entity = 'EUROPE'"))

BOOK.add("I15_every_unit_profile", lambda spark, sf: rounded(observations_for(spark, sf).filter("grain = 'business_unit'"), *_PROFILE).select("metric_id", "entity", "period", *_PROFILE, "peer_rank", "sla_breached", "confidence"), observed_sql(
    f"SELECT metric_id, entity, period, {', '.join(r(c) for c in _PROFILE)}, peer_rank, sla_breached, confidence FROM obs WHERE grain = 'business_unit'"))


def _grounded(spark, sf, top_n: int | None = anomaly.TOP_N):
    """Texts built from each ranked finding; every fourth one cites a figure nothing supports."""
    text = F.concat_ws(
        " ", F.lit("metric"), "metric_id", F.lit("for"), "entity", F.lit("moved by"), F.format_number(F.round("points", 2), 2), F.lit("to"), F.format_number(F.round("value", 3), 3),
        F.lit("on"), F.format_number("n", 0), F.lit("rows in"), F.date_format("period", "yyyy-MM"), F.when(F.col("place") % 4 == 0, "at a cost of 987,654.3"))
    rows = ranked_for(spark, sf, top_n).withColumns(
        {
            "text": text, "allowed": F.array("value", "prior", "points", F.col("n").cast("double"), "z", "score", "severity", "coverage", "delta", "sla_target", "sla_gap", "peer_median"),
            "literals": F.array("metric_id", "entity", "grain", "finding_id", F.date_format("period", "yyyy-MM")),
        }
    )
    checked = grounding.ground(rows, "text", "allowed", "literals")
    return checked.select("finding_id", "n_numbers", "grounded", F.array_join("offending", "|").alias("offending"))


BOOK.add("I16_numeric_grounding", _grounded, found_sql(
    "SELECT finding_id, CAST(3 + (place % 4 = 0)::INT AS INTEGER) AS n_numbers, place % 4 <> 0 AS grounded, CASE WHEN place % 4 = 0 THEN '987,654.3' ELSE '' END AS offending FROM ranked", ranked_cte()))

# --- memory ----------------------------------------------------------------------------------------------------------


def _remembered(spark, sf, top_n: int | None = anomaly.TOP_N):
    open_rows = stored_for(spark, sf, top_n).filter("status = 'OPEN'").select("incident_id", "period", "streak", F.inline("evidence"))
    return anomaly.memory_context(found_for(spark, sf), open_rows, _muted(spark, sf, top_n))


MEMORY_CTE = """
mem AS (SELECT f.*, CASE WHEN u.finding_id IS NOT NULL THEN 1.0 WHEN d.depth IS NOT NULL THEN 0.6 ELSE 0.0 END AS suppression,
    CASE WHEN u.finding_id IS NULL THEN d.depth + 1 END AS known_streak
  FROM found f LEFT JOIN muted u USING (finding_id) LEFT JOIN (SELECT f.finding_id, max(greatest(s.streak, 1)) AS depth FROM found f JOIN stored s
    ON s.metric_id = f.metric_id AND s.entity = f.entity AND s.period <> f.period AND s.status = 'OPEN' GROUP BY 1) d USING (finding_id))"""
BOOK.add("A16_memory_context", lambda spark, sf, top_n=anomaly.TOP_N: _remembered(spark, sf, top_n).select("finding_id", "suppression", "known_streak"),
         incident_sql("SELECT finding_id, CAST(suppression AS DOUBLE) AS suppression, CAST(known_streak AS INTEGER) AS known_streak FROM mem", MEMORY_CTE))
_again = ranked_cte("mem", "known_streak", "suppression").replace("scored AS", "scored2 AS").replace("FROM scored WHERE", "FROM scored2 WHERE").replace("placed AS", "placed2 AS").replace("ranked AS (SELECT * FROM placed WHERE", "ranked2 AS (SELECT * FROM placed2 WHERE")
BOOK.add("A16_ranking_with_memory", lambda spark, sf, top_n=anomaly.TOP_N: anomaly.rank(_remembered(spark, sf, top_n), SPECS, top_n).select("period", "place", "finding_id", F.round("score", 6).alias("score")),
         incident_sql("SELECT period, place, finding_id, round(score, 6) AS score FROM ranked2", MEMORY_CTE.strip() + ",\n" + _again.strip()))

# --- state -----------------------------------------------------------------------------------------------------------


def _fresh_path(spark, sf, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/state-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:8]}"


def _audit(spark, sf, top_n: int | None = anomaly.TOP_N):
    entries = ranked_for(spark, sf, top_n).select(
        F.col("place").cast("bigint").alias("seq"), F.concat(F.lit("run-"), F.date_format("period", "yyyy-MM")).alias("run_id"),
        F.when(F.col("place") <= 10, "scan").otherwise("rank").alias("stage"), F.date_format("period", "yyyy-MM-dd").alias("at"), F.col("finding_id").alias("detail"))
    path = _fresh_path(spark, sf, "audit")
    state.append_audit(entries.filter("stage = 'scan'"), path)
    state.append_audit(entries.filter("stage = 'rank'"), path)
    one = state.audit_for_run(spark, path, "run-1998-07").withColumn("view", F.lit("run"))
    return one.unionByName(state.audit_tail(spark, path, 15).withColumn("view", F.lit("tail")))


_audit_rows = "SELECT place AS seq, 'run-' || strftime(period, '%Y-%m') AS run_id, CASE WHEN place <= 10 THEN 'scan' ELSE 'rank' END AS stage, strftime(period, '%Y-%m-%d') AS \"at\", finding_id AS detail FROM ranked"
BOOK.add("S7_audit_log", _audit, found_sql(
    f"SELECT *, 'run' AS view FROM ({_audit_rows}) WHERE run_id = 'run-1998-07' UNION ALL (SELECT *, 'tail' AS view FROM ({_audit_rows}) ORDER BY \"at\" DESC, seq DESC LIMIT 15)", ranked_cte()))


def _upserted(spark, sf, top_n: int | None = anomaly.TOP_N):
    rows = incidents_for(spark, sf, top_n).select("incident_id", "priority", "status")
    path = _fresh_path(spark, sf, "incidents")
    state.upsert(rows.filter("priority <= 3"), path, "incident_id")
    state.upsert(rows.filter("priority >= 3").withColumn("status", F.lit(I.RESOLVED)), path, "incident_id")
    return state.current(spark, path)


BOOK.add("S8_state_upsert", _upserted, incident_sql("SELECT incident_id, priority, CASE WHEN priority >= 3 THEN 'RESOLVED' ELSE 'OPEN' END AS status FROM inc"))


def _life(spark, sf, top_n: int | None = anomaly.TOP_N):
    """Every incident folded over all later periods; fourth priorities are dismissed and fifth ones purged when they are detected."""
    opened = incidents_for(spark, sf, top_n)
    did = F.when(F.col("priority") == 4, life_cycle.DISMISS).when(F.col("priority") == 5, life_cycle.PURGE)
    done = life_cycle.operator_events(opened.select("incident_id", F.col("detected_on").alias("at"), did.alias("kind")).filter("kind is not null"))
    return life_cycle.folded(opened, life_cycle.measured_series(observations_for(spark, sf), MONTHS), done).drop("steps")


LIFE_CTE = f"""
later AS (SELECT i.incident_id, o.period AS p, o.value AS v, coalesce({_REL.replace("metric_id", "i.metric_id").replace("value", "o.value")} > 0, false) AS bad
  FROM inc i JOIN slices o ON o.metric_id = i.metric_id AND o.grain = i.grain AND o.entity = i.entity AND o.period > i.period),
back AS (SELECT incident_id, min(p) FILTER (v IS NOT NULL AND NOT bad) AS good FROM later GROUP BY 1),
life AS (SELECT i.incident_id, any_value(priority) AS priority, any_value(streak) AS streak, any_value(detected_on) AS detected_on, any_value(good) AS good,
    count(*) FILTER (v IS NOT NULL AND bad AND (good IS NULL OR p < good)) AS worse, count(*) FILTER (p IS NOT NULL AND v IS NULL AND (good IS NULL OR p < good)) AS unseen
  FROM inc i LEFT JOIN later USING (incident_id) LEFT JOIN back USING (incident_id) GROUP BY 1)"""
BOOK.add("I10_life_cycle", _life, incident_sql(
    f"""SELECT incident_id, CASE priority WHEN 4 THEN 'DISMISSED' WHEN 5 THEN 'UNRESOLVED' ELSE CASE WHEN good IS NULL THEN 'OPEN' ELSE 'RESOLVED' END END AS status,
  CAST(CASE WHEN priority IN (4, 5) THEN 0 ELSE worse END AS INTEGER) AS escalations, CAST(CASE WHEN priority IN (4, 5) THEN 0 ELSE unseen END AS INTEGER) AS waiting,
  CASE WHEN priority IN (4, 5) THEN detected_on ELSE CAST(good + INTERVAL {MONTHS} MONTH AS DATE) END AS closed_on,
  CASE WHEN priority NOT IN (4, 5) AND worse > 0 THEN incident_id || '-esc' || (greatest(streak, 1) + worse - 1) END AS last_escalation FROM life""", LIFE_CTE))


# The same from all findings of a period, not only its first twenty.


def _every(name: str, fn, cut: str) -> None:
    BOOK.add(name, fn, BOOK.sql[cut].replace("FROM ranked", "FROM placed"))


_every("G5_every_decision", lambda spark, sf: policy.decide(ranked_for(spark, sf, None)).select("finding_id", "rule_id", "breached", "band", "streak", "escalation_permitted"), "G5_decisions")
_every("I1_every_triage", lambda spark, sf: I.triage(ranked_for(spark, sf, None)).select("period", "cluster_key", "priority", "n_members", "finding_id", F.array_join("finding_ids", "|").alias("finding_ids")), "I1_triage")
_every("I2_every_incident_band", lambda spark, sf: incidents_for(spark, sf, None).select("incident_id", "incident_band"), "I2_incident_band")
_every("I3_every_incident", lambda spark, sf: incidents_for(spark, sf, None).select(
    "incident_id", "title", "priority", "rule_id", "breached", "streak", "escalation_permitted", "detected_on", "follow_up_on", "status",
    F.size("evidence").alias("n_evidence"), F.size("actions").alias("n_actions"), F.element_at("evidence", 1)["entity"].alias("lead_entity")), "I3_incident_rows")
BOOK.add("I1_every_member", lambda spark, sf: I.members(ranked_for(spark, sf, None)).drop("incident_id"), found_sql(
    "SELECT period, metric_id || ':' || CASE WHEN points < 0 THEN 'down' ELSE 'up' END AS cluster_key, finding_id FROM placed", ranked_cte()))


def _every_entry(spark, sf):
    """Two stages of every period's run appended to one log, and the whole log read back."""
    entries = ranked_for(spark, sf, None).select(
        F.col("place").cast("bigint").alias("seq"), F.concat(F.lit("run-"), F.date_format("period", "yyyy-MM")).alias("run_id"),
        F.when(F.col("place") <= 10, "scan").otherwise("rank").alias("stage"), F.date_format("period", "yyyy-MM-dd").alias("at"), F.col("finding_id").alias("detail"))
    path = _fresh_path(spark, sf, "every-audit")
    for stage in ("scan", "rank"):
        state.append_audit(entries.filter(F.col("stage") == stage), path)
    return state.audit_log(spark, path)


BOOK.add("S7_every_audit_entry", _every_entry, found_sql(_audit_rows.replace("FROM ranked", "FROM placed"), ranked_cte()))
for _cut, _whole in {
    "G6_permitted_actions": "G6_every_permitted_action", "G7_vendor_evidence": "G7_every_vendor_evidence", "G8_owner_routing": "G8_every_owner", "I4_keep_operator_status": "I4_every_operator_status",
    "I5_dismiss_incidents": "I5_every_dismissed_incident", "I5_dismiss_suppressions": "I5_every_suppression", "I5_dismiss_follow_ups": "I5_every_cancelled_follow_up", "I6_suppression_match": "I6_every_suppression_match",
    "I7_schedule_and_mark": "I7_every_schedule", "I8_due_follow_ups": "I8_every_due_follow_up", "I9_recheck_period": "I9_every_recheck_period", "I10_follow_up_outcome": "I10_every_outcome",
    "I10_resolved_incidents": "I10_every_resolved_incident", "I10_life_cycle": "I10_every_life_cycle", "I11_escalations": "I11_every_escalation", "I11_escalation_outbox": "I11_every_escalation_message",
    "I11_escalation_follow_ups": "I11_every_escalation_follow_up", "S7_follow_up_audit": "S7_every_follow_up_audit", "I12_outbox": "I12_every_message", "I12_outcome_messages": "I12_every_outcome_message",
    "I13_run_summary": "I13_every_run_summary", "I16_numeric_grounding": "I16_every_numeric_grounding", "A16_memory_context": "A16_every_memory_context", "A16_ranking_with_memory": "A16_every_ranking_with_memory",
    "S8_state_upsert": "S8_every_upsert",
}.items():
    _every(_whole, partial(BOOK.queries[_cut], top_n=None), _cut)
