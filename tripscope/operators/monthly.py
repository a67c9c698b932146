"""Slices from mergeable monthly state, so that a new or changed month is read once and old months never again.

A month's state holds what its slices add up from: sums and counts per grain and entity, counts per value for quantiles, and one bitmap
per entity and bucket of ids for distinct counts. All three merge by addition or OR, so months, quarters or any other periods of whole
months follow from the state alone. The state is three plain Parquet tables partitioned by month. Each row carries the mark of the source
files it was computed from (names, sizes, times); a refresh compares marks, reads the months that differ and overwrites their partitions.

Ids of distinct counts have to be whole numbers. A bitmap takes 4 KB per entity and 32,768 ids before compression, which suits ids that
are dense in a month, such as serial numbers.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripscope.operators.metrics import MetricSpec, _by_grain, _plan, cell_totals, decomposed, gated, grain_columns, grained_rows  # noqa: F401
from tripscope.session import input_mark

KEYS = ("month", "grain", "entity")


class State(NamedTuple):
    """The mergeable tables: ``sums`` and, where some metric needs them, counts per ``values`` and bitmaps of ``ids``."""

    sums: DataFrame
    values: DataFrame | None
    ids: DataFrame | None


def partials(df: DataFrame, specs: list[MetricSpec]) -> State:
    """The state of every month in ``df``; all specs read the same relation."""
    column_of = grain_columns(specs)
    rows, flag = grained_rows(df, specs, "month", column_of)
    parts = [F.expr(s.compiled(p.aggregate, flag[s.id])).alias(p.name) for s in specs for _, of in _plan(specs)[s.id].values() for p in of]
    names = [p.name for s in specs for _, of in _plan(specs)[s.id].values() for p in of]
    sums = cell_totals(rows, [f"g_{g}" for g in column_of], parts, [F.sum(n).alias(n) for n in names])
    values = ids = None
    for s in specs:
        kept = rows.filter(flag[s.id]) if flag[s.id] else rows
        if s.quantile:
            column = s.quantile[0]
            spread = kept.filter(F.col(column).isNotNull()).select("period", F.col(column).cast("double").alias("v"), F.inline(_by_grain(s)))
            part = spread.groupBy(F.lit(s.id).alias("metric_id"), F.col("period").alias("month"), "grain", "entity", "v").agg(F.count("*").alias("c"))
            values = part if values is None else values.unionByName(part)
        if s.distinct:
            number = F.col(s.distinct).cast("long")
            spread = kept.filter(number.isNotNull()).select("period", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"), F.inline(_by_grain(s)))
            part = spread.groupBy(F.lit(s.id).alias("metric_id"), F.col("period").alias("month"), "grain", "entity", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
            ids = part if ids is None else ids.unionByName(part)
    return State(sums.select(F.col("period").alias("month"), "grain", "entity", *names), values, ids)


def merged(state: State, specs: list[MetricSpec], period: Column | None = None) -> DataFrame:
    """The slices table of ``metrics.slices`` for the months in the state, or for ``period``, an expression over ``month``."""
    period = (F.col("month") if period is None else period).alias("period")
    measures = []
    for s in specs:
        parts = {tag: text for tag, (text, _) in _plan(specs)[s.id].items()}
        measures += [F.expr(parts["v"]).cast("double").alias(f"v_{s.id}"), F.expr(parts["n"]).alias(f"n_{s.id}"), F.expr(parts["c"]).alias(f"c_{s.id}")]
    wide = state.sums.groupBy(period, "grain", "entity").agg(*measures)
    stacked = F.array(*[F.struct(F.lit(s.id).alias("metric_id"), F.array(*[F.lit(g) for g in s.grains]).alias("grains"), F.col(f"v_{s.id}").alias("raw"), F.col(f"n_{s.id}").alias("n"), F.col(f"c_{s.id}").alias("covered")) for s in specs])
    out = wide.select("period", "grain", "entity", F.inline(stacked)).filter((F.col("n") > 0) & F.array_contains("grains", F.col("grain"))).drop("grains")
    extra = None
    if state.ids is not None:
        buckets = state.ids.groupBy("metric_id", period, "grain", "entity", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        extra = buckets.groupBy("metric_id", "period", "grain", "entity").agg(F.sum(F.bitmap_count("bits")).alias("divisor")).withColumn("quantile", F.lit(None).cast("double"))
    if state.values is not None:
        counts = state.values.groupBy("metric_id", period, "grain", "entity", "v").agg(F.sum("c").alias("c"))
        for s in specs:
            if s.quantile:
                part = counts.filter(F.col("metric_id") == s.id).groupBy("metric_id", "period", "grain", "entity").agg(F.percentile("v", s.quantile[1], F.col("c")).alias("quantile"))
                part = part.withColumn("divisor", F.lit(None).cast("long"))
                extra = part if extra is None else extra.unionByName(part)
    if extra is not None:
        own = F.when(F.col("divisor").isNotNull(), F.col("raw") / F.nullif(F.col("divisor"), F.lit(0))).otherwise(F.coalesce("quantile", "raw"))
        out = out.join(extra, ["metric_id", "grain", "entity", "period"], "left").withColumn("raw", own)
    return gated(out, {s.id: s for s in specs})


def _home(store: str, specs: list[MetricSpec]) -> str:
    """The state of other definitions lies elsewhere, so a changed catalog is computed afresh."""
    return f"{store.rstrip('/')}/{specs[0].source}-{hashlib.sha256(repr(specs).encode()).hexdigest()[:16]}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _source_marks(spark: SparkSession, source: str) -> dict[str, str]:
    """Month to the mark of its files, from the folders of a relation partitioned by month."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    months = sorted(n.removeprefix("month=") for n in names if n.startswith("month=") and "__HIVE" not in n)
    return {m: hashlib.sha256(repr(input_mark(spark, f"{source.rstrip('/')}/month={m}")).encode()).hexdigest()[:16] for m in months}


def _current(table: DataFrame, marks: dict[str, str]) -> DataFrame:
    """Rows of the months' present marks; what an older state of a month left behind is not among them."""
    fits = F.create_map(*[x for m, k in marks.items() for x in (F.lit(m), F.lit(k))]) if marks else None
    if fits is None:
        return table.limit(0)
    return table.filter(F.col("month").isin(list(marks)) & (F.col("mark") == F.try_element_at(fits, F.col("month").cast("string")))).drop("mark")


def refresh(spark: SparkSession, source: str, store: str, specs: list[MetricSpec]) -> list[str]:
    """Brings the state up to date with a relation that is partitioned by month; the months that were read.

    ``sums`` is written last and decides what is up to date, so a refresh that was cut short is done again.
    """
    home, marks = _home(store, specs), _source_marks(spark, source)
    known = {}
    if _exists(spark, f"{home}/sums"):
        known = {str(r["month"]): r["mark"] for r in spark.read.parquet(f"{home}/sums").select("month", "mark").distinct().collect() if r["mark"] == marks.get(str(r["month"]))}
    changed = [m for m in marks if m not in known]
    if changed:
        # Only the folders of these months are listed and opened.
        rows = spark.read.option("basePath", source).parquet(*[f"{source.rstrip('/')}/month={m}" for m in changed])
        state = partials(rows, specs)
        mark = F.try_element_at(F.create_map(*[x for m in changed for x in (F.lit(m), F.lit(marks[m]))]), F.col("month").cast("string"))
        for name in ("values", "ids", "sums"):
            part = getattr(state, name)
            if part is not None:
                part.withColumn("mark", mark).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{home}/{name}")
    return changed


def stored(spark: SparkSession, source: str, store: str, specs: list[MetricSpec]) -> State:
    """The state of the source's present months."""
    home, marks = _home(store, specs), _source_marks(spark, source)
    tables = {n: _current(spark.read.parquet(f"{home}/{n}"), marks) for n in ("sums", "values", "ids") if _exists(spark, f"{home}/{n}")}
    return State(tables["sums"], tables.get("values"), tables.get("ids"))
