"""What becomes of each incident, as one fold over its events in the order of time.

An incident is opened, may be dismissed or purged from memory, and is measured again in every later period of its series. The fold carries
one small state from event to event: still breaching, it escalates one deeper; back within target, it is resolved; without a value it
waits; once closed, it stays closed. All incidents of all periods are folded in one pass. A series (metric, grain, entity) is gathered
once and joined to the incidents it opened, so events are never spread into rows; its length is the number of periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripscope.operators import policy
from tripscope.operators.incidents import DISMISSED, OPEN, RESOLVED, UNRESOLVED

SERIES = ("metric_id", "grain", "entity")
# Order of events of one day: what an operator does comes before what is measured.
DISMISS, PURGE, MEASURE = 0, 1, 2
_EVENT = "array<struct<at:date,kind:int,period:date,value:double,breached:boolean>>"
_STATE = "struct<status:string,depth:int,waiting:int,closed_on:date,steps:array<struct<period:date,value:double,depth:int>>>"


def measured_series(observations: DataFrame, seen_after: int) -> DataFrame:
    """One row per series: its measurements as events, each on the day its period has ended (``seen_after`` months after it began)."""
    breached = F.coalesce(policy.RuleColumns.of(F.col("metric_id")).breached(F.col("value")), F.lit(False))
    event = F.struct(F.add_months("period", seen_after).alias("at"), F.lit(MEASURE).alias("kind"), F.col("period"), F.col("value").cast("double").alias("value"), breached.alias("breached"))
    return observations.select(*SERIES, event.alias("e")).groupBy(*SERIES).agg(F.collect_list("e").alias("measured"))


def operator_events(rows: DataFrame) -> DataFrame:
    """One row per incident from ``rows(incident_id, at, kind)``: what operators did to it."""
    nothing = F.lit(None)
    event = F.struct(F.col("at"), F.col("kind"), nothing.cast("date").alias("period"), nothing.cast("double").alias("value"), F.lit(False).alias("breached"))
    return rows.groupBy("incident_id").agg(F.collect_list(event).alias("done"))


def _step(state: Column, e: Column) -> Column:
    is_open = state["status"] == OPEN
    measured = is_open & (e["kind"] == MEASURE)
    deeper = measured & e["value"].isNotNull() & e["breached"]
    back = measured & e["value"].isNotNull() & ~e["breached"]
    shut = is_open & e["kind"].isin(DISMISS, PURGE)
    status = F.when(is_open & (e["kind"] == DISMISS), DISMISSED).when(is_open & (e["kind"] == PURGE), UNRESOLVED).when(back, RESOLVED).otherwise(state["status"])
    depth = state["depth"] + F.when(deeper, 1).otherwise(0)
    step = F.struct(e["period"].alias("period"), e["value"].alias("value"), depth.alias("depth"))
    return F.struct(
        status.alias("status"), depth.alias("depth"), (state["waiting"] + F.when(measured & e["value"].isNull(), 1).otherwise(0)).alias("waiting"),
        F.when(back | shut, e["at"]).otherwise(state["closed_on"]).alias("closed_on"), F.when(deeper, F.array_append(state["steps"], step)).otherwise(state["steps"]).alias("steps"),
    ).cast(_STATE)


def folded(opened: DataFrame, series: DataFrame, done: DataFrame) -> DataFrame:
    """Per incident of ``opened(incident_id, metric_id, grain, entity, period, streak)`` its end state.

    ``status``, ``escalations`` (how many), ``waiting`` (periods without a value before it closed), ``closed_on``, ``last_escalation`` (the
    id of the deepest one) and ``steps`` (period, value and depth of each). An incident looks at periods after its own.
    """
    joined = opened.join(series, list(SERIES), "left").join(done, "incident_id", "left")
    later = F.filter(F.coalesce("measured", F.array().cast(_EVENT)), lambda e: e["period"] > F.col("period"))
    events = F.array_sort(F.concat(F.coalesce(F.col("done").cast(_EVENT), F.array().cast(_EVENT)), later))
    start = F.greatest(F.coalesce("streak", F.lit(1)), F.lit(1)).cast("int")
    first = F.struct(F.lit(OPEN).alias("status"), start.alias("depth"), F.lit(0).alias("waiting"), F.lit(None).cast("date").alias("closed_on"), F.array().alias("steps")).cast(_STATE)
    out = joined.withColumn("end", F.aggregate(events, first, _step))
    root = F.regexp_replace("incident_id", r"(-esc\d+)+$", "")
    n = F.size("end.steps")
    return out.select(
        "incident_id", F.col("end.status").alias("status"), n.alias("escalations"), F.col("end.waiting").alias("waiting"), F.col("end.closed_on").alias("closed_on"),
        F.when(n > 0, F.concat(root, F.lit("-esc"), (F.col("end.depth") - 1).cast("string"))).alias("last_escalation"), F.col("end.steps").alias("steps"),
    )
