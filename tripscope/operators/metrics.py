"""Declarative metrics and the one-pass slice compiler.

A metric is a few SQL expression strings. All metrics that read the same relation are computed together by a single
``GROUPING SETS`` aggregation over (period, grains of a bin) for a few bins of grains, whose cells are added up per grain, so the
relation is scanned once and only partial aggregates are shuffled. The result is the long table

    slices(metric_id, grain, entity, period, value, n, covered, coverage)

``{f}`` after an aggregate in a formula marks where the metric's row filter goes; ``{f:cond}`` adds a further condition.
``{distinct}`` stands for the number of distinct values of the metric's ``distinct`` column, and ``{quantile}`` for the exact
quantile of its ``quantile`` column. Both take a pass of their own: a distinct count would otherwise shuffle every row once
per grain, and a quantile is taken from value counts instead of from rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripscope.session import ensure_checkpoint_dir

GLOBAL = "global"
ALL = "ALL"
#: Grains with at most this many entities are counted by bitmap; 1,024 entities are 16 longs an id.
MAX_ENTITIES = 1024
_IDENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_HOLE = re.compile(r"\{f(?::([^}]*))?\}")
_AGG = re.compile(r"\b(avg|sum|count)\((.*?)\)(\{f(?::[^}]*)?\})")
#: Names that may stand around the aggregates of a formula whose parts are added up.
_AROUND = {"nullif", "coalesce", "cast", "null", "as", "double", "d"}
#: Grains are totalled together while their entities make up at most this many cells a period, as seen in the first rows.
CELLS = 256
CELL_ROWS = 20_000


@dataclass(frozen=True)
class MetricSpec:
    id: str
    label: str
    source: str
    formula: str
    coverage: str
    direction: str
    unit: str
    min_sample: int
    grains: tuple[str, ...]
    rate_metric: bool = True
    where: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    segment_by: str | None = None
    valid_segments: tuple[str, ...] = ()
    sla_target: float | None = None
    sla_advisory: bool = False
    industry: float | None = None
    distinct: str | None = None
    quantile: tuple[str, float] | None = None

    def __post_init__(self) -> None:
        names = [self.id, self.source, *self.grains, *self.columns.values()] + ([self.segment_by] if self.segment_by else [])
        for name in names:
            if not _IDENT.match(name or ""):
                raise ValueError(f"{self.id}: {name!r} is not a plain identifier")
        if not self.formula.strip() or not self.coverage.strip():
            raise ValueError(f"{self.id}: formula and coverage are required")
        if self.direction not in ("higher_is_better", "lower_is_better"):
            raise ValueError(f"{self.id}: unknown direction {self.direction!r}")
        if self.min_sample < 1:
            raise ValueError(f"{self.id}: min_sample must be positive")
        if GLOBAL not in self.grains:
            raise ValueError(f"{self.id}: grains must include {GLOBAL!r}")
        if len(set(self.grains)) != len(self.grains):
            raise ValueError(f"{self.id}: repeated grain")
        if ("{distinct}" in self.formula) != bool(self.distinct) or ("{quantile}" in self.formula) != bool(self.quantile):
            raise ValueError(f"{self.id}: formula and its distinct or quantile column do not fit")
        if bool(self.segment_by) != bool(self.valid_segments):
            raise ValueError(f"{self.id}: segment_by and valid_segments go together")
        if self.segment_by and self.segment_by in self.grains:
            raise ValueError(f"{self.id}: the guard column cannot also be a grain")

    @property
    def higher_is_better(self) -> bool:
        return self.direction == "higher_is_better"

    def column(self, grain: str) -> str:
        return self.columns.get(grain, grain)

    def condition(self) -> str:
        """Row filter with the mandatory segment guard."""
        parts = [f"({self.where})"] if self.where else []
        if self.segment_by:
            allowed = ", ".join("'" + s.replace("'", "''") + "'" for s in self.valid_segments)
            parts.append(f"({self.segment_by} IN ({allowed}))")
        return " AND ".join(parts)

    def compiled(self, template: str, base: str | None = None) -> str:
        """The template with its filters filled in; ``base`` names a column that already holds the row filter."""
        base = self.condition() if base is None else base

        def fill(m: re.Match) -> str:
            conds = [c for c in (base, f"({m.group(1)})" if m.group(1) else "") if c]
            return f" FILTER (WHERE {' AND '.join(conds)})" if conds else ""

        return _HOLE.sub(fill, template)


def spec_from_dict(raw: dict) -> MetricSpec:
    """A spec from parsed configuration; unknown keys are errors."""
    known = {f.name for f in fields(MetricSpec)}
    unknown = sorted(set(raw) - known)
    if unknown:
        raise ValueError(f"unknown metric keys {unknown}")
    return MetricSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def load_catalog(spark, path: str) -> dict[str, MetricSpec]:
    """The metrics defined by the JSON files of a location. Definitions are small; they are read whole.

    A file holds an object or a list of objects, or several of them one after the other, as when Spark writes them as lines.
    """
    import json

    decoder = json.JSONDecoder()
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").collect()
    raw: list[dict] = []
    for f in sorted(files, key=lambda f: f["file"]):
        text, at = f["value"].strip(), 0
        while at < len(text) or not at:  # a blank file is an error
            try:
                found, at = decoder.raw_decode(text, at)
            except json.JSONDecodeError as e:
                raise ValueError(f"{f['file']}: {e}") from e
            raw += found if isinstance(found, list) else [found]
            at += len(text[at:]) - len(text[at:].lstrip())
    return catalog(spec_from_dict(r) for r in raw)


def spec_to_dict(spec: MetricSpec) -> dict:
    """A spec as configuration that ``spec_from_dict`` reads."""
    return {f.name: list(v) if isinstance(v := getattr(spec, f.name), tuple) else v for f in fields(spec)}


def catalog(specs: Iterable[MetricSpec]) -> dict[str, MetricSpec]:
    out: dict[str, MetricSpec] = {}
    for s in specs:
        if s.id in out:
            raise ValueError(f"duplicate metric {s.id}")
        out[s.id] = s
    return out


_TRIP_GRAINS = ("global", "business_unit", "office", "vendor", "product_type", "trip_direction", "shift_type")
_VENDOR = {"vendor": "vendor_id"}
_FUEL = {"vendor": "vendor_id", "fuel_type": "actual_cab_fuel_type"}
_HOUR = "try_cast(substr(shift_type, 1, 2) as int)"

# Production definitions: formulas, gates, targets and benchmarks are fixed values of the metric contract.
DEFAULT_CATALOG = catalog(
    [
        MetricSpec(
            "ota", "On-time arrival", "trips", "avg(on_time){f}", "count(delay_minutes){f}", "higher_is_better", "rate", 500,
            (*_TRIP_GRAINS, "trip_nodal", "route_source", "fuel_type"), columns=_FUEL, sla_target=0.95, industry=0.93,
        ),
        MetricSpec(
            "delay_p90", "90th percentile delay of delayed trips", "trips", "{quantile}",
            "count(delay_minutes){f}", "lower_is_better", "minutes", 300,
            (*_TRIP_GRAINS, "trip_nodal", "route_source", "delay_reason"), rate_metric=False, where="delay_minutes > 0",
            columns=_VENDOR, quantile=("delay_minutes", 0.9),
        ),
        MetricSpec(
            "escort_compliance", "Night escort cover", "trips",
            "avg(CASE WHEN coalesce(actual_escort, false) THEN 1.0D ELSE 0.0D END){f}", "count(actual_escort){f}",
            "higher_is_better", "rate", 300, (*_TRIP_GRAINS[:-1], "trip_nodal", "route_source"),
            where=f"{_HOUR} >= 20 OR {_HOUR} <= 5", columns=_VENDOR, sla_target=1.0, sla_advisory=True,
        ),
        MetricSpec(
            "noshow_rate", "No-show rate", "trips", "sum(noshow){f} / nullif(sum(emp_planned){f}, 0)", "count(emp_planned){f}",
            "lower_is_better", "rate", 500, (*_TRIP_GRAINS, "trip_nodal", "route_source"), columns=_VENDOR, industry=0.06,
        ),
        MetricSpec(
            "occupancy", "Seat occupancy", "trips", "sum(emp_actual){f} / nullif(sum(cab_capacity){f}, 0)",
            "count(cab_capacity){f}", "higher_is_better", "rate", 500,
            (*_TRIP_GRAINS, "trip_nodal", "route_source", "fuel_type"), columns=_FUEL,
        ),
        MetricSpec(
            "driver_noncompliance", "Driver non-compliance", "trips",
            "avg(CASE WHEN is_driver_nc THEN 1.0D ELSE 0.0D END){f}", "count(is_driver_nc){f}", "lower_is_better", "rate", 5000,
            (*_TRIP_GRAINS, "route_source"), columns=_VENDOR,
        ),
        MetricSpec(
            "cab_noncompliance", "Cab non-compliance", "trips", "avg(CASE WHEN is_cab_nc THEN 1.0D ELSE 0.0D END){f}",
            "count(is_cab_nc){f}", "lower_is_better", "rate", 5000, (*_TRIP_GRAINS, "route_source"), columns=_VENDOR,
        ),
        MetricSpec(
            "cost_per_km", "Cost per kilometre", "bills",
            "sum(trip_cost){f:trip_cost >= 0} / nullif(sum(total_trip_km){f:trip_cost >= 0}, 0)", "count(total_trip_km){f}",
            "lower_is_better", "currency", 500, ("global", "business_unit", "office", "vendor", "contract", "slab_name"),
            rate_metric=False, segment_by="billing_regime", valid_segments=("DISTANCE_BASED",), sla_target=85.0,
        ),
        MetricSpec(
            "cost_per_trip", "Cost per trip", "bills",
            "sum(trip_cost){f:trip_id IS NOT NULL} / nullif({distinct}, 0)", "count(trip_cost){f}",
            "lower_is_better", "currency", 500,
            ("global", "business_unit", "office", "vendor", "contract", "slab_name", "billing_regime"), rate_metric=False,
            distinct="trip_id",
        ),
    ]
)


def regated(specs: dict[str, MetricSpec], gate: int) -> dict[str, MetricSpec]:
    """The same metrics with one volume gate, for small data."""
    return {k: replace(s, min_sample=gate) for k, s in specs.items()}


def lookup(key: Column, table: dict, kind: str) -> Column:
    """Constant per key from a small fixed table, as one map literal; null where absent."""
    known = {k: v for k, v in table.items() if v is not None}
    if not known:
        return F.lit(None).cast(kind)
    pairs = [x for k, v in known.items() for x in (F.lit(k), F.lit(v).cast(kind))]
    return F.try_element_at(F.create_map(*pairs), key)


def per_metric(specs: dict[str, MetricSpec], attribute: str, kind: str) -> Column:
    return lookup(F.col("metric_id"), {k: getattr(s, attribute) for k, s in specs.items()}, kind)


def slices(relations: dict[str, DataFrame], specs: dict[str, MetricSpec], period: str = "month", grains: Iterable[str] | None = None) -> DataFrame:
    """Every metric × grain × entity × period, one aggregation per source relation; of the named ``grains`` only, if any are named.

    Values below the gate, and values that are null, NaN or infinite, are null; the sample size is kept.
    """
    out = None
    if grains is not None:
        wanted = {GLOBAL, *grains}
        specs = {k: replace(s, grains=tuple(g for g in s.grains if g in wanted)) for k, s in specs.items()}
    for source in dict.fromkeys(s.source for s in specs.values()):
        part = _slices_of(relations[source], [s for s in specs.values() if s.source == source], period)
        out = part if out is None else out.unionByName(part)
    return gated(out, specs).filter(F.lit(True) if grains is None else F.col("grain").isin(list(grains)))


def gated(raw: DataFrame, specs: dict[str, MetricSpec]) -> DataFrame:
    """The slices table from raw values: those below the gate, null, NaN or infinite are null."""
    usable = (F.col("n") >= per_metric(specs, "min_sample", "bigint")) & ~F.isnan("raw") & (F.abs("raw") != F.lit(float("inf")))
    return raw.select(
        "metric_id", "grain", "entity", "period", F.when(usable, F.col("raw")).alias("value"), "n", "covered",
        (F.col("covered") / F.col("n")).alias("coverage"),
    )


def grain_columns(specs: list[MetricSpec]) -> dict[str, str]:
    """Source column of every grain but the global one."""
    column_of: dict[str, str] = {}
    for s in specs:
        for g in s.grains:
            if g != GLOBAL:
                column_of.setdefault(g, s.column(g))
    return column_of


def grained_rows(df: DataFrame, specs: list[MetricSpec], period: str, column_of: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Rows with their period and entities, and per metric the column that holds its row filter.

    Row filters are evaluated here, once per row, not once per row and grain.
    """
    rows = df.filter(F.col(period).isNotNull()).withColumns(
        {
            "period": F.col(period),
            **{f"g_{g}": F.coalesce(F.col(c).cast("string"), F.lit("NA")) for g, c in column_of.items()},
            **{f"f_{s.id}": F.expr(s.condition()) for s in specs if s.condition()},
        }
    )
    return rows, {s.id: f"f_{s.id}" if s.condition() else "" for s in specs}


class Partial(NamedTuple):
    """One additive part of a formula: its column in the state and the aggregate that fills it."""

    name: str
    aggregate: str


def decomposed(spec: MetricSpec, template: str, tag: str) -> tuple[str, list[Partial]]:
    """A formula over merged parts, and the parts. An average becomes a sum over a count; sums and counts are their own parts."""
    parts: list[Partial] = []

    def part(fn: str, body: str, hole: str) -> str:
        parts.append(Partial(f"{tag}_{spec.id}_{len(parts)}", f"{fn}({body}){hole}"))
        return f"sum({parts[-1].name})"

    def replaced(m: re.Match) -> str:
        fn, body, hole = m.groups()
        if fn == "avg":
            return f"(cast({part('sum', body, hole)} as double) / nullif({part('count', body, hole)}, 0))"
        return f"coalesce({part(fn, body, hole)}, 0)" if fn == "count" else part(fn, body, hole)

    merged = _AGG.sub(replaced, template)
    if "{f" in merged:
        raise ValueError(f"{spec.id}: {template!r} has an aggregate that does not add up over months")
    return merged, parts


def _plan(specs: list[MetricSpec]) -> dict[str, dict[str, tuple[str, list[Partial]]]]:
    """Per metric, the merged form and parts of its value, row count and coverage."""
    out = {}
    for s in specs:
        plain = s.formula.replace("{quantile}", "cast(null as double)").replace("nullif({distinct}, 0)", "1")
        out[s.id] = {"v": decomposed(s, plain, "v"), "n": decomposed(s, "count(*){f}", "n"), "c": decomposed(s, s.coverage, "c")}
    return out


def adds_up(spec: MetricSpec) -> bool:
    """Whether the formula and coverage are made of sums, counts and averages only, so that totals of cells add up to them."""
    for template in (spec.formula.replace("{quantile}", "null").replace("nullif({distinct}, 0)", "1"), spec.coverage):
        for body in (m.group(2) for m in _AGG.finditer(template)):
            depth = 0
            for c in body:
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    return False
            if depth or "{" in body or re.search(r"\bdistinct\b", body, re.I):
                return False
        around = _AGG.sub("0", template)
        if "{" in around or not {w.lower() for w in re.findall(r"[A-Za-z_]\w*", around)} <= _AROUND:
            return False
    return True


def binned(rows: DataFrame, keys: list[str]) -> list[list[str]]:
    """The grain columns, laid together while their entities make few cells. The first rows decide on the layout only, never on a result."""
    if not keys:
        return [[]]
    found = rows.select(*keys).limit(CELL_ROWS).agg(*[F.count_distinct(k).alias(k) for k in keys]).first()
    bins: list[list] = []
    for k in sorted(keys, key=lambda k: -found[k]):
        n = max(found[k], 1)
        fits = next((b for b in bins if b[0] * n <= CELLS), None)
        if fits is None:
            bins.append([n, k])
        else:
            fits[0] *= n
            fits.append(k)
    return [b[1:] for b in bins]


def cell_totals(rows: DataFrame, keys: list[str], parts: list[Column], measures: list[Column]) -> DataFrame:
    """``measures`` of the summed ``parts`` by (period, grain, entity).

    A row is totalled once for each bin of grains instead of once for each grain, and the cells are spread over the bin's grains.
    """
    bins = binned(rows, keys)
    cells = rows.groupingSets([["period", *b] for b in bins], "period", *keys).agg(*parts, *[F.grouping(b[0]).alias(f"not_{i}") for i, b in enumerate(bins) if b])
    whole = [F.struct(F.lit(GLOBAL).alias("grain"), F.lit(ALL).alias("entity"))]
    pairs = [F.array(*(whole if not i else []), *[F.struct(F.lit(k[2:]).alias("grain"), F.col(k).alias("entity")) for k in b]) for i, b in enumerate(bins)]
    own = pairs[0]
    for i, p in enumerate(pairs[1:], 1):
        own = F.when(F.col(f"not_{i}") == 0, p).otherwise(own)
    return cells.withColumn("__pairs", own).drop(*keys).select("*", F.inline("__pairs")).groupBy("period", "grain", "entity").agg(*measures)


def stacked_grain(keys: list[str]) -> tuple[Column, Column]:
    """(grain, entity) of a row of the grouping sets."""
    grain = F.lit(GLOBAL)
    for k in keys:
        grain = F.when(F.col(f"is_{k}") == 0, F.lit(k[2:])).otherwise(grain)
    return grain, F.coalesce(*keys, F.lit(ALL))


def _added(rows: DataFrame, specs: list[MetricSpec], flag: dict[str, str], keys: list[str]) -> DataFrame:
    """Value, row count and coverage of every metric by (period, grain, entity), added up from cells."""
    plan = _plan(specs)
    parts = [F.expr(s.compiled(p.aggregate, flag[s.id])).alias(p.name) for s in specs for _, of in plan[s.id].values() for p in of]
    measures = [F.expr(text).cast("double" if tag == "v" else "bigint").alias(f"{tag}_{s.id}") for s in specs for tag, (text, _) in plan[s.id].items()]
    return cell_totals(rows, keys, parts, measures)


def _direct(rows: DataFrame, specs: list[MetricSpec], flag: dict[str, str], keys: list[str]) -> DataFrame:
    """The same for formulas that do not add up: every row is grouped once for each grain."""
    measures: list[Column] = []
    for s in specs:
        plain = s.formula.replace("{quantile}", "cast(null as double)").replace("nullif({distinct}, 0)", "1")
        measures += [
            F.expr(s.compiled(plain, flag[s.id])).cast("double").alias(f"v_{s.id}"),
            F.expr(s.compiled("count(*){f}", flag[s.id])).alias(f"n_{s.id}"),
            F.expr(s.compiled(s.coverage, flag[s.id])).alias(f"c_{s.id}"),
        ]
    wide = rows.groupingSets([["period"], *[["period", k] for k in keys]], "period", *keys).agg(
        *measures, *[F.grouping(k).alias(f"is_{k}") for k in keys]
    )
    grain, entity = stacked_grain(keys)
    return wide.withColumns({"grain": grain, "entity": entity})


def _stacked(wide: DataFrame, specs: list[MetricSpec]) -> DataFrame:
    """One row per metric, grain, entity and period that has rows."""
    stacked = F.array(
        *[
            F.struct(
                F.lit(s.id).alias("metric_id"),
                F.array(*[F.lit(g) for g in s.grains]).alias("grains"),
                F.col(f"v_{s.id}").alias("raw"),
                F.col(f"n_{s.id}").alias("n"),
                F.col(f"c_{s.id}").alias("covered"),
            )
            for s in specs
        ]
    )
    return (
        wide.select("period", "grain", "entity", F.inline(stacked))
        .filter((F.col("n") > 0) & F.array_contains("grains", F.col("grain")))
        .select("metric_id", "grain", "entity", "period", "raw", "n", "covered")
    )


def _slices_of(df: DataFrame, specs: list[MetricSpec], period: str) -> DataFrame:
    column_of = grain_columns(specs)
    keys = [f"g_{g}" for g in column_of]
    rows, flag = grained_rows(df, specs, period, column_of)
    additive = [s for s in specs if adds_up(s)]
    out = None
    for some, wide in ((additive, _added), ([s for s in specs if s not in additive], _direct)):
        if some:
            part = _stacked(wide(rows, some, flag, keys), some)
            out = part if out is None else out.unionByName(part)
    if any(s.distinct for s in specs):
        # The entities that the distinct counts give bits to are read from it, and it is not computed again.
        ensure_checkpoint_dir(df.sparkSession)
        out = out.checkpoint()
    extra: DataFrame | None = None
    for s in specs:
        for part in ([_distinct_counts(rows, s, flag[s.id], _entities(out, s))] if s.distinct else []) + ([_quantiles(rows, s, flag[s.id])] if s.quantile else []):
            extra = part if extra is None else extra.unionByName(part)
    if extra is None:
        return out
    own = F.when(F.col("divisor").isNotNull(), F.col("raw") / F.nullif(F.col("divisor"), F.lit(0))).otherwise(F.coalesce("quantile", "raw"))
    joined = out.join(extra, ["metric_id", "grain", "entity", "period"], "left")
    return joined.select("metric_id", "grain", "entity", "period", own.alias("raw"), "n", "covered")


def _by_grain(spec: MetricSpec) -> Column:
    """One (grain, entity) pair per grain of the metric."""
    return F.array(
        *[F.struct(F.lit(g).alias("grain"), (F.lit(ALL) if g == GLOBAL else F.col(f"g_{g}")).alias("entity")) for g in spec.grains]
    )


def _entities(out: DataFrame, spec: MetricSpec) -> dict[str, list[str]]:
    """Entity names of the metric's grains that have at most ``MAX_ENTITIES`` of them: a bounded list, whatever the rows."""
    names = out.filter(F.col("metric_id") == spec.id).select("grain", "entity").distinct()
    most = MAX_ENTITIES * len(spec.grains)
    rows = names.limit(most + 1).collect()
    if len(rows) > most:  # some grain has too many: read those that have not
        small = names.groupBy("grain").count().filter(F.col("count") <= MAX_ENTITIES).select("grain")
        rows = names.join(small, "grain", "left_semi").collect()
    found: dict[str, list[str]] = {}
    for r in rows:
        found.setdefault(r["grain"], []).append(r["entity"])
    return {g: sorted(found[g]) for g in spec.grains if g in found and len(found[g]) <= MAX_ENTITIES}


def _distinct_counts(rows: DataFrame, spec: MetricSpec, flag: str, entities: dict[str, list[str]]) -> DataFrame:
    """Distinct ids per grain, entity and period, from one bitmap over all entities per id.

    Every entity has a bit, the bits of all grains lie side by side in a few longs. A row sets its entities' bits, ``bit_or`` gathers an
    id's bits of a period (map-side first, so an id that holds a third of all rows is one short row a task), and ids with the same word
    are counted together before bits are read. One exchange on the id, whatever the number of grains. Grains with more entities than
    fit are counted one by one from their distinct (id, entity) pairs.
    """
    kept = (rows.filter(flag) if flag else rows).filter(F.col(spec.distinct).isNotNull()).withColumn("__id", F.col(spec.distinct))
    parts = [
        kept.select("__id", "period", (F.lit(ALL) if g == GLOBAL else F.col(f"g_{g}")).alias("entity")).distinct().groupBy("period", "entity").agg(F.count("*").alias("divisor"))
        .select(F.lit(g).alias("grain"), "entity", "period", "divisor")
        for g in spec.grains
        if g not in entities
    ]
    if entities:
        parts.append(_counted_by_bit(kept, entities))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.lit(spec.id).alias("metric_id"), "grain", "entity", "period", "divisor", F.lit(None).cast("double").alias("quantile"))


def _local(spark, columns: dict[str, list], schema: str) -> DataFrame:
    """A small table as a local relation, which needs no job of its own."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns), schema)


def _counted_by_bit(kept: DataFrame, entities: dict[str, list[str]]) -> DataFrame:
    spark = kept.sparkSession
    bit_of = {pair: i for i, pair in enumerate((g, e) for g, names in entities.items() for e in names)}
    n_words = -(-len(bit_of) // 64)
    marked, places = kept, []
    for g, names in entities.items():
        if g == GLOBAL:
            places.append((F.lit(bit_of[g, ALL]), bit_of[g, ALL], bit_of[g, ALL]))
            continue
        bits = [bit_of[g, e] for e in names]
        # At most MAX_ENTITIES names, counted before they were read.
        named = _local(spark, {f"__e_{g}": names, f"__b_{g}": bits}, f"__e_{g} string, __b_{g} int")
        marked = marked.join(F.broadcast(named), F.col(f"g_{g}") == F.col(f"__e_{g}"))
        places.append((F.col(f"__b_{g}"), min(bits), max(bits)))

    def word(w: int) -> Column:
        out = F.lit(0).cast("long")
        for place, low, high in places:
            if low < 64 * (w + 1) and high >= 64 * w:
                inside = F.lit(True) if 64 * w <= low and high < 64 * (w + 1) else (place >= 64 * w) & (place < 64 * (w + 1))
                one = F.call_function("shiftleft", F.lit(1).cast("long"), place - 64 * w)
                out = out.bitwiseOR(F.when(inside, one).otherwise(F.lit(0).cast("long")))
        return out

    ids = marked.select("__id", "period", *[word(w).alias(f"__w{w}") for w in range(n_words)]).groupBy("__id", "period").agg(*[F.bit_or(f"__w{w}").alias(f"__w{w}") for w in range(n_words)])
    words = ids.select("period", F.inline(F.array(*[F.struct(F.lit(w).alias("__at"), F.col(f"__w{w}").alias("__word")) for w in range(n_words)])))
    counted = words.filter("__word <> 0").groupBy("period", "__at", "__word").agg(F.count("*").alias("__c"))
    pairs = list(bit_of)
    meaning = _local(
        spark, {"__at": [i // 64 for i in range(len(pairs))], "__bit": [i % 64 for i in range(len(pairs))], "grain": [p[0] for p in pairs], "entity": [p[1] for p in pairs]},
        "__at int, __bit int, grain string, entity string",
    )
    read = counted.join(F.broadcast(meaning), "__at").filter(F.expr("(shiftrightunsigned(__word, __bit) & 1) = 1"))
    return read.groupBy("grain", "entity", "period").agg(F.sum("__c").alias("divisor"))


def _quantiles(rows: DataFrame, spec: MetricSpec, flag: str) -> DataFrame:
    """Exact quantile per grain, entity and period from value counts, which combine map-side."""
    column, p = spec.quantile
    kept = (rows.filter(flag) if flag else rows).filter(F.col(column).isNotNull())
    cols = [f"g_{g}" for g in spec.grains if g != GLOBAL]
    counted = kept.groupBy("period", *cols, F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    spread = counted.select("period", "__v", "__c", F.inline(_by_grain(spec))).groupBy("grain", "entity", "period", "__v").agg(F.sum("__c").alias("__c"))
    return spread.groupBy("grain", "entity", "period").agg(F.percentile("__v", p, F.col("__c")).alias("quantile")).select(
        F.lit(spec.id).alias("metric_id"), "grain", "entity", "period", F.lit(None).cast("bigint").alias("divisor"), "quantile"
    )


def overall(slices_df: DataFrame) -> DataFrame:
    """Un-sliced totals; they come from rows, not from adding slices up."""
    return slices_df.filter(F.col("grain") == GLOBAL)


def series(slices_df: DataFrame) -> DataFrame:
    """Measurable entities only."""
    return slices_df.filter("value is not null").select("metric_id", "grain", "entity", "period", "value", "n")


def measure(slices_df: DataFrame, asked: DataFrame) -> DataFrame:
    """One slice per asked (metric_id, grain, entity, period); an unknown one comes back empty with n = 0."""
    keys = ["metric_id", "grain", "entity", "period"]
    return asked.join(slices_df.select(*keys, "value", "n", "coverage"), keys, "left").withColumns(
        {"n": F.coalesce("n", F.lit(0).cast("bigint")), "coverage": F.coalesce("coverage", F.lit(0.0))}
    )


def history(slices_df: DataFrame, lookback: int) -> DataFrame:
    """Per slice and period: the last ``lookback`` measured values up to it, oldest first. Gated periods are left out.

    The window is one entity's periods, so its length is the number of periods.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("metric_id", "grain", "entity").orderBy("period").rowsBetween(-(lookback - 1), 0)
    return series(slices_df).withColumn("history", F.collect_list("value").over(w))


def periods(slices_df: DataFrame) -> DataFrame:
    """Periods in each metric's own population, with its latest."""
    return overall(slices_df).groupBy("metric_id").agg(
        F.count("*").alias("n_periods"), F.min("period").alias("first_period"), F.max("period").alias("latest_period")
    )


def parse_period(text: Column) -> Column:
    """First of the month of ``yyyy-MM`` or an ISO date; null for anything else."""
    t = F.trim(text)
    asdate = F.when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    return F.trunc(F.try_to_date(asdate, "yyyy-MM-dd"), "MM")


def previous(period: Column, months: int = 1) -> Column:
    return F.add_months(period, -months)


def quality(specs: dict[str, MetricSpec]) -> dict[str, Column]:
    """Confidence label and caveat list for rows carrying value, n and coverage."""
    gate = per_metric(specs, "min_sample", "bigint")
    value, n, cov = F.col("value"), F.col("n"), F.col("coverage")
    confidence = (
        F.when(value.isNull() & (n < gate), "insufficient_sample")
        .when(value.isNull(), "not_computable")
        .when((cov >= 0.98) & (n >= gate * 4), "HIGH")
        .when(cov >= 0.90, "MEDIUM")
        .otherwise("LOW")
    )
    caveats = F.array_compact(
        F.array(
            F.when(value.isNull() & (n < gate), F.format_string("%d rows are below the %d-row gate; no value is given", n, gate)),
            F.when(value.isNull() & (n >= gate), F.format_string("%d rows matched but the denominator is empty or zero", n)),
            F.when(value.isNotNull() & (cov < 0.98), F.format_string("%d of %d rows carry no usable value", n - F.col("covered"), n)),
            F.when(value.isNotNull() & (n >= gate) & (n < gate * 2), F.format_string("%d rows only just clear the %d-row gate", n, gate)),
        )
    )
    return {"confidence": confidence, "caveats": caveats}
