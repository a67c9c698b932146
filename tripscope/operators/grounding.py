"""Checks that every number in a text is one the finding behind it supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns and tolerances of the check.
NUMBER = r"([-+]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[-+]?\d+(?:\.\d+)?)"
PERIOD_LIKE = r"\d{4}-\d{2}(?:-\d{2})?"
YEAR_LIKE = r"\b(?:19|20)\d{2}\b"
PLACES = (0, 1, 2, 3)
EPSILON = 1e-6


def allowed_values(values: Column) -> Column:
    """The values, their magnitudes, and both in percent where they are at most 1."""
    known = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    both = F.concat(known, F.transform(known, lambda v: F.abs(v)))
    percent = F.transform(F.filter(both, lambda v: F.abs(v) <= 1.0), lambda v: v * 100.0)
    return F.array_distinct(F.concat(both, percent))


def mask(text: Column, literals: Column) -> Column:
    """The text without the names and periods that may contain digits."""
    digits = F.filter(literals, lambda s: s.isNotNull() & s.rlike(r"\d"))
    longest_first = F.reverse(F.array_sort(F.transform(digits, lambda s: F.struct(F.length(s).alias("n"), s.alias("s")))))
    named = F.aggregate(longest_first, text, lambda t, s: F.replace(t, s["s"], F.lit(" ")))
    return F.regexp_replace(F.regexp_replace(named, PERIOD_LIKE, " "), YEAR_LIKE, " ")


def _supported(cited: Column, allowed: Column) -> Column:
    near = lambda v: F.abs(cited - v) <= EPSILON + EPSILON * F.abs(v)
    rounded = lambda v: F.greatest(*[(F.abs(F.round(v, p) - cited) <= EPSILON).cast("int") for p in PLACES]) == 1
    return F.exists(allowed, lambda v: near(v) | rounded(v))


def ground(df: DataFrame, text: str, values: str, literals: str, max_reported: int | None = None) -> DataFrame:
    """Adds ``n_numbers``, ``offending`` (distinct numbers; ``max_reported`` of them, by default all) and ``grounded``.

    Allowed values sit in the row as a short array, so no pairs of numbers and values are ever produced.
    """
    tokens = F.regexp_extract_all(mask(F.col(text), F.col(literals)), F.lit(NUMBER), F.lit(1))
    df = df.withColumns({"__tokens": tokens, "__allowed": allowed_values(F.col(values))})
    bad = F.array_distinct(
        F.filter("__tokens", lambda t: ~_supported(F.replace(t, F.lit(","), F.lit("")).cast("double"), F.col("__allowed")))
    )
    return (
        df.withColumns({"n_numbers": F.size("__tokens"), "offending": bad if max_reported is None else F.slice(bad, 1, max_reported)})
        .withColumn("grounded", F.size("offending") == 0)
        .drop("__tokens", "__allowed")
    )
