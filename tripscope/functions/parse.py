"""Typing expressions for text extracts. Each gives null for what it cannot read and never drops a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts of the extracts (fixed values).
LONG_DATE = "MMMM d, yyyy"
LONG_TIMESTAMP = "MMMM d, yyyy, h:mm a"

# Severities kept as a category; contract marks and slab names billed at a fixed rate.
SEVERITIES = ["SEV-1", "SEV-2", "SEV-3"]
FIXED_CONTRACT_MARKS = ["HYD", "ORRNEW", "EV-Z"]
FIXED_SLABS = ["Short", "Medium", "Long"]
GRACE_MINUTES = 5


def _plain(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def comma_long(c: Column) -> Column:
    """Whole numbers, with or without a decimal part, which is rounded; ids of any length pass exactly."""
    return F.round(_plain(c).try_cast("decimal(38,6)"), 0).try_cast("bigint")


def comma_double(c: Column) -> Column:
    return _plain(c).try_cast("double")


def float_epoch(c: Column) -> Column:
    """Epoch seconds written as a float."""
    return comma_double(c).try_cast("bigint")


def whole_number(c: Column) -> Column:
    """Integer text, a decimal part rounded away as the extracts' reader does."""
    return F.round(c.try_cast("double")).try_cast("int")


def long_date(c: Column) -> Column:
    return F.try_to_date(c, LONG_DATE)


def long_timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(LONG_TIMESTAMP))


def iso_date(c: Column) -> Column:
    """Only the ten-character form; a bare year or month is no date."""
    return F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), c.try_cast("date"))


def boolean3(c: Column) -> Column:
    """True, false or unknown."""
    return c.try_cast("boolean")


def text_or_null(c: Column) -> Column:
    """Trimmed text; the word ``null`` and blanks are null."""
    return F.nullif(F.nullif(F.trim(c), F.lit("null")), F.lit(""))


def rider_id(c: Column) -> tuple[Column, Column]:
    """The id with the placeholder 0 nulled, and whether it was the placeholder (or unreadable)."""
    v = comma_long(c)
    return F.nullif(v, F.lit(0).cast("bigint")), F.coalesce(v, F.lit(0)) == 0


def severity(c: Column) -> tuple[Column, Column]:
    """Known severities, and the raw text beside them."""
    return F.when(F.upper(F.trim(c)).isin(SEVERITIES), F.trim(c)), c


def rating(c: Column) -> Column:
    """Zero means not rated."""
    return F.nullif(whole_number(c), F.lit(0))


def na_category(c: Column) -> Column:
    return F.coalesce(c, F.lit("NA"))


def row_average(parts: Sequence[Column]) -> Column:
    """Mean of the parts present; null when none is."""
    total, present = F.lit(0), F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0))
        present = present + p.isNotNull().cast("int")
    return total / F.nullif(present, F.lit(0))


def billing_regime(contract: Column, slab: Column, marks: Sequence[str] = FIXED_CONTRACT_MARKS, slabs: Sequence[str] = FIXED_SLABS) -> Column:
    fixed = slab.isin(*slabs)
    for m in marks:
        fixed = fixed | contract.ilike(f"%{m}%")
    return F.when(fixed, "FIXED_RATE").otherwise("DISTANCE_BASED")


def unit_cost(regime: Column, cost: Column, km: Column) -> Column:
    """Cost per kilometre where distance is what is billed."""
    return F.when((regime == "DISTANCE_BASED") & (km > 0) & cost.isNotNull(), cost / km)


def ack_minutes(start: Column, ack: Column) -> Column:
    """Minute boundaries between two times; null when either is missing."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", ack))


def on_time(delay: Column) -> Column:
    """1 within the grace, else 0; an unknown delay counts as late."""
    return F.when(delay <= GRACE_MINUTES, 1).otherwise(0)


def on_time_known(delay: Column) -> Column:
    """The same with unknown kept unknown."""
    return F.when(delay.isNotNull(), on_time(delay))


def shift_hour(c: Column) -> Column:
    """Hour of ``HH:MM`` labels, null for any other text."""
    return F.when(c.rlike(r"^\d{1,2}:\d{2}$"), F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int"))


def shift_band(hour: Column) -> Column:
    return (
        F.when(hour.isNull(), "none").when((hour >= 21) | (hour <= 5), "night").when(hour <= 11, "morning").when(hour <= 16, "day").otherwise("evening")
    )


def is_night(hour: Column, start: int = 20, end: int = 5) -> Column:
    return (hour >= start) | (hour <= end)


def cycle_label(start: Column) -> Column:
    return F.concat(F.date_format(start, "yyyy-MM"), F.when(F.dayofmonth(start) == 1, "-A").otherwise("-B"))


def slab_label(c: Column) -> Column:
    """Upper case, one space between words, no space around dashes; blank becomes UNLABELLED."""
    flat = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"\s*-\s*", "-"), r"\s+", " ")
    return F.when(F.coalesce(flat, F.lit("")) == "", "UNLABELLED").otherwise(flat)


def local_hour(epoch: Column, offset_hours: int) -> Column:
    """Hour of day of an epoch a fixed number of hours behind UTC; the session zone is UTC."""
    return F.hour(F.timestamp_seconds(epoch - F.lit(offset_hours * 3600)))
