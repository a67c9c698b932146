"""From ranked findings to incidents, actions, messages and follow-ups.

These are transforms of small tables (at most a few findings per period). Memory (incidents, suppressions, follow-ups) comes
in as tables and goes out as tables; ``sources.state`` merges them by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripscope.operators import policy

# Fixed values of the action contract: limits, delays, action names, desks and states.
FOLLOW_UP_DAYS = 7
MAJOR_SEVERITY = 0.66
MINOR_SEVERITY = 0.33
VENDOR_MIN_POWER = 0.25
NOTIFY = "notify"
VENDOR_ESCALATION = "vendor_escalation"
REVIEW_ALLOCATION = "review_allocation"
AUTO_REALLOCATE = "auto_reallocate"
OPEN, DISMISSED, RESOLVED = "OPEN", "DISMISSED", "RESOLVED"
PENDING, RECOVERED, ESCALATED, UNRESOLVED = "PENDING", "RECOVERED", "ESCALATED", "UNRESOLVED"
ESCALATED_TITLE = "ESCALATED: "
WILDCARD = "*"


def _dash(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def triage(ranked: DataFrame, max_incidents: int | None = None, max_members: int | None = None) -> DataFrame:
    """Clusters of one metric moving one way in a period, led by the best score.

    ``max_incidents`` (per period) and ``max_members`` (ids listed per cluster) cut the report for a desk with room for so many; by default
    nothing is left out. With 0 no ids are listed: ``members`` has them as rows, which is the form for clusters of any size.
    """
    rows = ranked.withColumn("cluster_key", cluster_key())
    keep = ("finding_id", "metric_id", "grain", "entity", "value", "prior", "points", "n", "z", "score", "severity", "coverage", "confidence", "known_streak")
    # The lead is a minimum, kept map-side, so a cluster may have any number of members.
    lead = F.min_by(F.struct(*keep), F.struct(-F.col("score"), F.col("finding_id"))).alias("__lead")
    drafts = rows.groupBy("period", "cluster_key").agg(F.min("place").alias("__first"), F.count("*").alias("n_members"), lead).select("period", "cluster_key", "__first", "n_members", "__lead.*")
    if max_members != 0:
        places = W.partitionBy("period", "cluster_key").orderBy(F.col("score").desc(), "finding_id")
        listed = rows.withColumn("__m", F.row_number().over(places)).filter(F.lit(True) if max_members is None else F.col("__m") <= max_members)
        ids = listed.groupBy("period", "cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("__m", "finding_id"))), lambda s: s["finding_id"]).alias("finding_ids"))
        drafts = drafts.join(ids, ["period", "cluster_key"])
    else:
        drafts = drafts.withColumn("finding_ids", F.array().cast("array<string>"))
    order = W.partitionBy("period").orderBy("__first")
    drafts = drafts.withColumn("priority", F.row_number().over(order)).drop("__first")
    return drafts if max_incidents is None else drafts.filter(F.col("priority") <= max_incidents)


def cluster_key() -> Column:
    """One metric moving one way."""
    return F.concat_ws(":", "metric_id", F.when(F.col("points") < 0, "down").otherwise("up"))


def members(ranked: DataFrame) -> DataFrame:
    """The findings of every cluster as rows: (period, cluster_key, incident_id, finding_id)."""
    return ranked.select("period", cluster_key().alias("cluster_key"), incident_id(cluster_key(), F.col("period")).alias("incident_id"), "finding_id")


def incident_id(cluster: Column, period: Column) -> Column:
    return F.concat(F.lit("inc-"), _dash(cluster), F.lit("-"), F.date_format(period, "yyyy-MM"))


def incident_band(breached: Column, band: Column, severity: Column) -> Column:
    """The target band when breached, else one from the observation's severity."""
    return F.when(breached, band).when(severity >= MAJOR_SEVERITY, "MAJOR").when(severity >= MINOR_SEVERITY, "MINOR").otherwise("NONE")


def route(metric: Column, winner: Column, winner_entity: Column, entity: Column) -> dict[str, Column]:
    """Persona, recipient and desk that own an incident."""
    safety = F.lower(metric).contains("escort")
    vendor = F.coalesce(winner.isin("vendor", "vendor_id"), F.lit(False))
    shift = F.coalesce(winner.isin("shift_type", "shift"), F.lit(False))
    return {
        "persona": F.when(safety, "facilities_head").when(vendor, "transport_manager").when(shift, "line_manager").otherwise("transport_manager"),
        "recipient": F.when(safety, "Transport & facilities head").when(vendor, "Vendor operations")
        .when(shift, F.concat(F.lit("Line manager — "), F.coalesce(winner_entity, entity))).otherwise("Routing desk"),
        "desk": F.when(safety, "safety").when(vendor, "vendor").when(shift, "shift").otherwise("routing"),
    }


def vendor_evidence(winner: Column, vendor_power: Column) -> Column:
    """Whether vendors explain the movement: they win, or their power reaches the bar."""
    wins = F.coalesce(winner.isin("vendor", "vendor_id"), F.lit(False))
    return wins | F.coalesce(vendor_power + 1e-12 >= VENDOR_MIN_POWER, F.lit(False))


def permitted_actions(streak: Column, evidence: Column, recipient: Column, desk: Column) -> Column:
    """The four actions with their verdicts; only notifying, and an earned vendor escalation, are ever permitted."""
    earned = streak >= policy.ESCALATION_STREAK

    def action(kind: str, to: Column, ok: Column, why: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), to.alias("recipient"), ok.alias("permitted"), why.alias("reason"))

    why = (
        F.when(earned & evidence, "breach sustained and vendor evidence present")
        .when(earned, "breach sustained but vendors do not explain it")
        .when(evidence, "vendor evidence present but the breach is not sustained")
        .otherwise("neither sustained nor explained by vendors")
    )
    return F.array(
        action(NOTIFY, recipient, F.lit(True), F.lit("informing is always permitted")),
        action(VENDOR_ESCALATION, F.when(desk == "vendor", recipient).otherwise("Vendor operations"), earned & evidence, why),
        action(REVIEW_ALLOCATION, recipient, F.lit(False), F.lit("needs human approval")),
        action(AUTO_REALLOCATE, recipient, F.lit(False), F.lit("never permitted")),
    )


def incidents(drafts: DataFrame, owners: DataFrame, detected: Column, prior_period: Column) -> DataFrame:
    """Incident rows with policy verdict, evidence, actions and follow-up date.

    ``owners`` has one row per metric and period: winner, winner_entity, vendor_power.
    """
    decided = policy.decide(drafts, known_streak="known_streak").join(owners, ["metric_id", "period"], "left")
    owner = route(F.col("metric_id"), F.col("winner"), F.col("winner_entity"), F.col("entity"))
    evidence = F.array(
        F.struct(
            F.format_string(
                "%s on %s=%s measured %.4f in %s against %.4f in %s across %d rows.", "metric_id", "grain", "entity", "value",
                F.date_format("period", "yyyy-MM"), "prior", F.date_format(prior_period, "yyyy-MM"), "n",
            ).alias("claim"),
            F.col("metric_id"), F.col("entity"),
        )
    )
    return (
        decided.withColumns(owner)
        .withColumns(
            {
                "incident_id": incident_id(F.col("cluster_key"), F.col("period")),
                "incident_band": incident_band(F.col("breached"), F.col("band"), F.col("severity")),
                "vendor_supported": vendor_evidence(F.col("winner"), F.col("vendor_power")),
                "evidence": evidence,
                "detected_on": detected,
                "follow_up_on": F.date_add(detected, FOLLOW_UP_DAYS),
                "title": F.concat_ws(" ", "metric_id", "grain", "entity", F.when(F.col("points") < 0, "down").otherwise("up")),
                "status": F.lit(OPEN),
            }
        )
        .withColumn("actions", permitted_actions(F.col("streak"), F.col("vendor_supported"), F.col("recipient"), F.col("desk")))
    )


def keep_operator_status(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """A re-run refreshes an incident but does not reopen one an operator has closed."""
    old = stored.select("incident_id", F.col("status").alias("__old"))
    closed = F.col("__old").isNotNull() & (F.trim("__old") != "") & (F.upper("__old") != OPEN)
    return fresh.join(old, "incident_id", "left").withColumn("status", F.when(closed, F.col("__old")).otherwise(F.col("status"))).drop("__old")


def dismiss(stored: DataFrame, follow_ups: DataFrame, ids: DataFrame, reason: str, today: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dismissed incidents, the suppressions they leave behind, and the follow-ups that are cancelled."""
    closed = stored.join(ids, "incident_id", "left_semi").withColumn("status", F.lit(DISMISSED))
    lead = F.element_at("evidence", 1)
    muted = closed.select(
        F.concat(F.lit("sup-"), "incident_id").alias("suppression_id"), F.coalesce(lead["metric_id"], F.lit(WILDCARD)).alias("metric_id"),
        F.lit(WILDCARD).alias("grain"), F.coalesce(lead["entity"], F.lit(WILDCARD)).alias("entity"), F.lit(reason).alias("reason"),
        "incident_id", today.alias("created_on"), F.lit(None).cast("date").alias("expires_on"),
    )
    cancelled = follow_ups.join(ids, "incident_id", "left_semi").filter(F.col("state") == PENDING).withColumns(
        {"state": F.lit(RECOVERED), "note": F.lit("cancelled: incident dismissed")}
    )
    return closed, muted, cancelled


def suppressed(findings: DataFrame, suppressions: DataFrame, today: Column) -> DataFrame:
    """Ids of findings a live suppression covers; null and ``*`` in a suppression match anything, case is ignored.

    Each finding is spelled in its eight wildcard forms and matched by equality, so the join stays a hash join however
    many suppressions there are.
    """
    fields = ("metric_id", "grain", "entity")
    live = suppressions.filter(F.col("expires_on").isNull() | (today < F.col("expires_on")))
    pattern = F.struct(*[F.lower(F.coalesce(f, F.lit(WILDCARD))).alias(f) for f in fields])
    forms = F.array(
        *[
            F.struct(*[(F.lit(WILDCARD) if bits >> i & 1 else F.lower(F.col(f))).alias(f) for i, f in enumerate(fields)])
            for bits in range(8)
        ]
    )
    spelled = findings.select("finding_id", F.explode(forms).alias("__p"))
    return spelled.join(live.select(pattern.alias("__p")).distinct(), "__p", "left_semi").select("finding_id").distinct()


def schedule(opened: DataFrame, days: int = FOLLOW_UP_DAYS) -> DataFrame:
    """A pending follow-up per incident; the origin period is read off the incident id."""
    return opened.select(
        "incident_id", "metric_id", "grain", "entity",
        F.to_date(F.concat(F.regexp_extract("incident_id", r"(\d{4}-\d{2})(?:-esc\d+)*$", 1), F.lit("-01"))).alias("origin"),
        F.date_add("detected_on", days).alias("due_on"), F.lit(PENDING).alias("state"), F.lit(None).cast("string").alias("note"),
    )


def mark_due(follow_ups: DataFrame, ids: DataFrame, today: Column) -> DataFrame:
    """Brings the due date of the named pending follow-ups forward to today."""
    asked = ids.select("incident_id").distinct().withColumn("__asked", F.lit(True))
    hit = F.coalesce("__asked", F.lit(False)) & (F.col("state") == PENDING)
    return follow_ups.join(asked, "incident_id", "left").withColumn("due_on", F.when(hit, today).otherwise(F.col("due_on"))).drop("__asked")


def due(follow_ups: DataFrame, today: Column) -> DataFrame:
    """Pending follow-ups whose date has come."""
    return follow_ups.filter((F.col("state") == PENDING) & (F.col("due_on") <= today))


def recheck_period(follow_ups: DataFrame, latest: DataFrame) -> DataFrame:
    """Adds the period to measure again: an ``override``, else the metric's latest if later than the origin, else none (wait)."""
    joined = follow_ups.join(latest.select("metric_id", "latest_period"), "metric_id", "left")
    if "override" not in follow_ups.columns:
        joined = joined.withColumn("override", F.lit(None).cast("date"))
    later = F.col("latest_period").isNotNull() & (F.col("origin").isNull() | (F.col("latest_period") > F.col("origin")))
    return joined.withColumn("recheck", F.coalesce("override", F.when(later, F.col("latest_period")))).drop("latest_period", "override")


def outcome(due_rows: DataFrame, stored: DataFrame, observations: DataFrame) -> DataFrame:
    """What became of each due follow-up; waiting and unmeasurable ones stay pending."""
    memory = stored.select("incident_id", F.col("status").alias("__status"))
    seen = observations.select("metric_id", "grain", "entity", F.col("period").alias("recheck"), F.col("value").alias("recheck_value"), F.col("n").alias("recheck_n"))
    joined = due_rows.join(memory, "incident_id", "left").join(seen, ["metric_id", "grain", "entity", "recheck"], "left")
    breached = policy.RuleColumns.of(F.col("metric_id")).breached(F.col("recheck_value"))
    status = F.upper(F.coalesce("__status", F.lit("")))
    state = (
        F.when(F.col("__status").isNull(), UNRESOLVED).when(status.isin(DISMISSED, RESOLVED), RECOVERED)
        .when(F.col("recheck").isNull() | F.col("recheck_value").isNull(), PENDING).when(breached, ESCALATED).otherwise(RECOVERED)
    )
    note = (
        F.when(F.col("__status").isNull(), "incident no longer in memory").when(status.isin(DISMISSED, RESOLVED), "closed before it came due")
        .when(F.col("recheck").isNull(), "waiting for a later period").when(F.col("recheck_value").isNull(), "could not be measured")
        .when(breached, "still breaching").otherwise("back within target")
    )
    return joined.withColumns({"state": state, "note": note}).drop("__status")


def settled(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Incident memory after the follow-ups: an open incident measured back within target is resolved."""
    back = outcomes.filter((F.col("state") == RECOVERED) & F.col("recheck_value").isNotNull()).select("incident_id", F.lit(True).alias("__back")).distinct()
    closes = F.coalesce("__back", F.lit(False)) & (F.upper("status") == OPEN)
    return stored.join(back, "incident_id", "left").withColumn("status", F.when(closes, RESOLVED).otherwise(F.col("status"))).drop("__back")


def follow_up_audit(outcomes: DataFrame) -> DataFrame:
    """One audit entry for each follow-up of a pass: what it led to, under the day it was due."""
    return outcomes.select(
        F.lit(1).cast("bigint").alias("seq"), F.concat(F.lit("follow-up-"), F.date_format("due_on", "yyyy-MM")).alias("run_id"), F.lit("follow_up").alias("stage"),
        F.date_format("due_on", "yyyy-MM-dd").alias("at"), F.concat_ws(" ", "incident_id", "state", "note").alias("detail"),
    )


def escalations(outcomes: DataFrame, stored: DataFrame, today: Column) -> DataFrame:
    """A new incident per follow-up that still breaches: one deeper, one priority higher, due again in seven days."""
    old = stored.select("incident_id", "title", "priority", "streak", "rule_id", "finding_ids", "evidence", "persona", "recipient", "desk", "vendor_supported")
    rows = outcomes.filter(F.col("state") == ESCALATED).select("incident_id", "metric_id", "grain", "entity", "recheck", "recheck_value", "recheck_n").join(old, "incident_id")
    depth = F.greatest(F.coalesce("streak", F.lit(1)), F.lit(1)) + 1
    rule = policy.RuleColumns.of(F.col("metric_id"))
    root = F.regexp_replace("incident_id", r"(-esc\d+)+$", "")
    claim = F.struct(
        F.format_string("On follow-up %s measured %.4f over %d rows.", "metric_id", "recheck_value", "recheck_n").alias("claim"), F.col("metric_id"), F.col("entity")
    )
    return rows.select(
        F.concat(root, F.lit("-esc"), (depth - 1).cast("string")).alias("incident_id"), F.col("incident_id").alias("parent_id"), "metric_id", "grain", "entity",
        F.when(F.col("title").startswith(ESCALATED_TITLE), F.col("title")).otherwise(F.concat(F.lit(ESCALATED_TITLE), "title")).alias("title"),
        F.greatest(F.col("priority") - 1, F.lit(1)).alias("priority"), depth.cast("int").alias("streak"), "rule_id",
        policy.band(rule.relative_gap(F.col("recheck_value"))).alias("incident_band"), "finding_ids",
        F.array_append("evidence", claim).alias("evidence"), F.lit(OPEN).alias("status"), today.alias("detected_on"), F.date_add(today, FOLLOW_UP_DAYS).alias("follow_up_on"),
        "persona", "recipient", "desk", "vendor_supported", permitted_actions(depth, F.col("vendor_supported"), F.col("recipient"), F.col("desk")).alias("actions"),
    )


def outbox(opened: DataFrame) -> DataFrame:
    """Messages of an incident: a permitted notice is sent, refused vendor letters and reallocations are recorded as blocked."""
    rows = opened.select("incident_id", "persona", "title", F.inline("actions"))
    sent = (F.col("type") == NOTIFY) & F.col("permitted")
    blocked = F.col("type").isin(VENDOR_ESCALATION, AUTO_REALLOCATE) & ~F.col("permitted")
    return rows.filter(sent | blocked).select(
        F.concat_ws("/", "incident_id", "type").alias("message_id"), "incident_id", "type", "persona", "recipient",
        F.concat(F.when(sent, "Attention required — ").otherwise("Not permitted — "), F.col("title")).alias("subject"), F.when(sent, "SENT").otherwise("BLOCKED").alias("state"),
    )


def outcome_messages(outcomes: DataFrame, stored: DataFrame) -> DataFrame:
    """Quiet closing notes for recoveries and urgent notices for escalations."""
    joined = outcomes.filter(F.col("state").isin(RECOVERED, ESCALATED) & F.col("recheck_value").isNotNull() & F.col("note").isin("still breaching", "back within target")).join(
        stored.select("incident_id", "title", "persona", "recipient"), "incident_id"
    )
    up = F.col("state") == ESCALATED
    return joined.select(
        F.concat_ws("/", "incident_id", F.lower("state")).alias("message_id"), "incident_id", F.lit(NOTIFY).alias("type"),
        F.when(up, "facilities_head").otherwise(F.col("persona")).alias("persona"), F.when(up, "Transport & facilities head").otherwise(F.col("recipient")).alias("recipient"),
        F.concat(F.when(up, "ESCALATED — still breaching — ").otherwise("Closed — "), F.col("title")).alias("subject"), F.lit("SENT").alias("delivery"),
    )


def ranking(observations: DataFrame, specs) -> DataFrame:
    """Per metric, grain and period: best and worst measured entity, runner-up, median."""
    from tripscope.operators import metrics as M

    measured = observations.filter((F.col("grain") != M.GLOBAL) & F.col("value").isNotNull() & F.col("peer_rank").isNotNull())
    return measured.groupBy("metric_id", "grain", "period").agg(
        F.count("*").alias("entities"), F.min_by("entity", "peer_rank").alias("leader"), F.max_by("entity", "peer_rank").alias("tail"),
        F.max(F.when(F.col("peer_rank") == 2, F.col("entity"))).alias("runner_up"), F.max("peer_median").alias("median"),
        F.min_by("value", "peer_rank").alias("leader_value"), F.max_by("value", "peer_rank").alias("tail_value"),
    )
