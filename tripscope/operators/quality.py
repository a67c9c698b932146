"""Counting what is wrong with the data: nothing here filters or repairs a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """One row of conditional counts; ``checks`` maps a name to a condition."""
    return df.agg(F.count("*").alias("rows_read"), *[F.count_if(F.expr(c)).alias(a) for a, c in checks.items()])


def as_rows(wide: DataFrame, names: list[str], key: str = "check", value: str = "n", keep: list[str] | None = None) -> DataFrame:
    """A one-row table of counts turned into (name, count) rows."""
    cells = F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])
    return wide.select(*(keep or []), F.inline(cells))


def coverage_by_field(df: DataFrame, fields: list[str], headline: list[str]) -> DataFrame:
    """Non-null share per field, and the share of rows with all ``headline`` fields present."""
    whole = " and ".join(f"{h} is not null" for h in headline)
    wide = df.agg(
        F.count("*").alias("__n"), *[F.count(f).alias(f) for f in fields], F.count_if(F.expr(whole)).alias("headline")
    )
    rows = as_rows(wide, [*fields, "headline"], "field", "present", ["__n"])
    return rows.select("field", "present", (F.col("present") / F.nullif(F.col("__n"), F.lit(0))).alias("coverage"))


def confidence_band(coverage: Column, n: Column) -> Column:
    return F.when((coverage >= 0.98) & (n >= 10_000), "HIGH").when((coverage >= 0.90) & (n >= 500), "MEDIUM").otherwise("LOW")


def caveats(counts: DataFrame, wording: dict[str, str], rows: str = "rows_read") -> DataFrame:
    """A sentence per counter that is not zero. ``%d`` in the wording is the count, ``%.1f`` its share of rows in percent."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("counter"), F.col(k).alias("n"), F.lit(text).alias("__text")) for k, text in wording.items()]
    )
    long = counts.select(F.col(rows).alias("__rows"), F.inline(cells)).filter("n > 0")
    sentence = F.lit("")
    for k, text in wording.items():
        share = F.round(F.col("n") * 100.0 / F.col("__rows"), 1)
        filled = F.format_string(text, F.col("n"), share) if "%.1f" in text else F.format_string(text, F.col("n"))
        sentence = F.when(F.col("counter") == k, filled).otherwise(sentence)
    return long.withColumn("caveat", sentence).drop("__rows", "__text")


def column_profile(df: DataFrame, columns: list[str], cast_to: str = "bigint") -> DataFrame:
    """Per column: nulls, distinct values, blanks, padding, failed casts, smallest and largest text.

    Columns are stacked and counted by (column, value) first, so a value in a third of the rows is combined map-side and
    every figure, exact distinct included, comes from that one small table.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    counted = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count("*").alias("c"))
    v, c = F.col("v"), F.col("c")
    tally = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0).cast("bigint"))
    return counted.groupBy("column").agg(
        F.sum("c").alias("n"), tally(v.isNull()).alias("nulls"), F.count("v").alias("distinct_values"), tally(v == "").alias("empty"),
        tally(v != F.trim(v)).alias("padded"), tally(v.isNotNull() & v.try_cast(cast_to).isNull()).alias("cast_failures"),
        F.min("v").alias("lowest"), F.max("v").alias("highest"),
    ).withColumn("null_pct", F.round(F.col("nulls") * 100 / F.col("n"), 4))


def text_hygiene(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: padding, double spaces, other alphabets, blanks, and distinct values raw, trimmed and lower-cased."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    counted = df.select(F.inline(cells)).groupBy("column", "v").agg(F.count("*").alias("c"))
    v, c = F.col("v"), F.col("c")
    tally = lambda cond: F.coalesce(F.sum(F.when(cond, c)), F.lit(0).cast("bigint"))
    return counted.groupBy("column").agg(
        tally(v != F.trim(v)).alias("padded"), tally(v.contains("  ")).alias("double_space"), tally(v.rlike(r"[^\x00-\x7F]")).alias("non_ascii"),
        tally(v == "").alias("empty"), F.count("v").alias("distinct_raw"), F.count_distinct(F.trim(v)).alias("distinct_trimmed"),
        F.count_distinct(F.lower(F.trim(v))).alias("distinct_lower"),
    )


def key_report(df: DataFrame, keys: dict[str, list[str]], where: str | None = None) -> DataFrame:
    """Rows, distinct keys and excess rows per candidate key; nulls are part of a key."""
    rows = df.filter(where) if where else df
    out: DataFrame | None = None
    for name, cols in keys.items():
        counted = rows.groupBy(*cols).agg(F.count("*").alias("c"))
        part = counted.agg(
            F.sum("c").alias("n"), F.count("*").alias("distinct_keys"), F.max("c").alias("most_copies"), F.count_if(F.col("c") > 1).alias("repeated_keys")
        ).select(F.lit(name).alias("key_name"), "n", "distinct_keys", (F.col("n") - F.col("distinct_keys")).alias("excess"), "repeated_keys", "most_copies")
        out = part if out is None else out.unionByName(part)
    return out


#: A set of columns whose estimated number of values is this far below the number of rows is no key: ten standard errors of the sketch.
SKETCH_SLACK = 0.16
#: Sets that may be keys are first judged on one of this many parts of their hashes.
SHARES = 32
HASHES_PER_TASK = 2_000_000


def minimal_keys(df: DataFrame, columns: list[str], largest: int | None = None) -> DataFrame:
    """All minimal keys among ``columns``: sets whose values no two rows share, and that lose this without any of their columns.

    The lattice of column sets is searched level by level. A set with a key inside it is a key but not a minimal one, so it is never
    looked at. Of a level's other sets, one scan estimates the number of values of each by a mergeable sketch, and only sets that may be
    keys are judged exactly, by one hash per row. Nulls are values like others. Returns (key_columns, size), sets in ``columns``'
    order; keys of more than ``largest`` columns are not looked for if it is given.
    """
    spark = df.sparkSession
    rows = df.select(*columns)
    keys: list[tuple[int, ...]] = []
    level = [()]
    total = rows.count()
    for size in range(0, min(largest or len(columns), len(columns)) + 1):
        if size:
            # Grow the sets that are no keys by a later column; all their other subsets must be no keys either.
            known = set(level)
            grown = [(*s, c) for s in level for c in range(s[-1] + 1 if s else 0, len(columns))]
            level = [g for g in grown if all((*g[:i], *g[i + 1 :]) in known for i in range(size))]
        if not level:
            break
        found = set(level) if total <= 1 else _unique_sets(rows, columns, [s for s in level if s], total)
        keys += sorted(found)
        level = [s for s in level if s not in found]
    return spark.createDataFrame([([columns[c] for c in k], len(k)) for k in keys], "key_columns array<string>, size int")


def _unique_sets(rows: DataFrame, columns: list[str], sets: list[tuple[int, ...]], total: int) -> set[tuple[int, ...]]:
    """Those of the column sets that no two rows share."""
    if not sets:
        return set()
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[columns[c] for c in s], *[F.col(columns[c]).isNull() for c in s]), F.lit(12))) for s in sets]
    estimates = rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(sketches)]).first()
    maybe = [s for s, e in zip(sets, estimates) if e >= (1 - SKETCH_SLACK) * total]
    if not maybe:
        return set()
    # A small share of the hashes refutes almost every set that is no key; the others are judged on all of them.
    for share in (SHARES, 1):
        refuted = _repeated_sets(rows, columns, maybe, total, share)
        maybe = [s for s in maybe if s not in refuted]
        if not maybe:
            break
    return set(maybe)


def _repeated_sets(rows: DataFrame, columns: list[str], sets: list[tuple[int, ...]], total: int, share: int) -> set[tuple[int, ...]]:
    """Those of the column sets that some two rows share, looking at one of ``share`` parts of all hashes.

    Only one long per row and set is shuffled: the hash of the set's values, with the set's number in its lowest bits. Different hashes
    are different values; of equal ones, the lowest and the highest per set are compared by their values, and should both prove to be
    chance, the set is grouped by its values.
    """
    width = len(sets).bit_length()
    marks = [
        F.shiftleft(F.xxhash64(*[columns[c] for c in s], *[F.col(columns[c]).isNull() for c in s]), width).bitwiseOR(F.lit(i).cast("long")) for i, s in enumerate(sets)
    ]
    number = F.col("h").bitwiseAND(F.lit((1 << width) - 1).cast("long")).cast("int")
    hashes = rows.select(F.explode(F.array(*marks)).alias("h"))
    if share > 1:
        hashes = hashes.filter(F.pmod(F.shiftright("h", width), F.lit(share)) == 0)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * len(sets) // share // HASHES_PER_TASK)
    # Nearly all are different: they are not combined before the exchange, which would only fill memory.
    shared = hashes.repartition(parts, "h").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    suspects = shared.groupBy(number.alias("i")).agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).collect()
    if not suspects:
        return set()
    asked = sorted({h for r in suspects for h in (r["low"], r["high"])})
    values = [F.when(number.isin([i for i, s in enumerate(sets) if c in s]), F.col(name)).alias(f"v{c}") for c, name in enumerate(columns)]
    named = rows.select(F.explode(F.array(*marks)).alias("h"), *columns).filter(F.col("h").isin(asked)).select(number.alias("i"), *values)
    found = {r["i"] for r in named.groupBy("i", *[f"v{c}" for c in range(len(columns))]).count().filter("count > 1").select("i").distinct().collect()}
    for r in suspects:
        if r["i"] not in found and r["n"] > 2 and rows.groupBy(*[columns[c] for c in sets[r["i"]]]).count().filter("count > 1").head(1):
            found.add(r["i"])
    return {sets[i] for i in found}


def schema_drift(raw: DataFrame, file_tag: str, hints: dict[str, str]) -> DataFrame:
    """Per file and column: null rate, failed casts to the hinted type, and how many texts carry a thousands comma or a dot."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias("failed"))
            for c, t in hints.items()
        ]
    )
    return raw.select(file_tag, F.inline(cells)).groupBy(file_tag, "column").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if("failed").alias("cast_failures"),
        F.count_if(F.col("v").contains(",")).alias("with_comma"), F.count_if(F.col("v").contains(".")).alias("with_dot"),
    )


def calendar(dates: DataFrame, column: str) -> DataFrame:
    """Every day between the first and the last one, as a table of its own."""
    return dates.agg(F.min(column).alias("a"), F.max(column).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
