"""Strings: flag tokens, tolerant numbers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(flags: Column) -> Column:
    """Distinct tokens of a semicolon-joined string, in order."""
    return F.array_distinct(F.filter(F.split(F.coalesce(flags, F.lit("")), ";"), lambda t: t != ""))


def has_bad_time(tok: Column) -> Column:
    return F.exists(tok, lambda t: t.contains("future_timestamp") | t.contains("invalid_timestamp"))


def valid_pm25(value: Column, tok: Column) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.coalesce(ok & ~F.array_contains(tok, "invalid_pm25"), F.lit(False))


def control_id(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, r"\s+", ""))


#: What stands for a number that is not there.
MISSING = ["", "-", "--", "na", "n/a", "null", "none", "x"]


def checked_number(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """struct(value, invalid) of a text: null and valid for the missing markers, null and invalid for what is no finite number or lies outside the bounds."""
    t = F.lower(F.trim(x))
    absent = x.isNull() | t.isin(*MISSING)
    v = t.try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    for bound, test in ((low, v >= (low or 0.0)), (high, v <= (high or 0.0))):
        ok = ok if bound is None else ok & test
    good = ~absent & F.coalesce(ok, F.lit(False))
    return F.struct(F.when(good, v).alias("value"), (~absent & ~good).alias("invalid"))


def number(x: Column) -> Column:
    """A number, or null for the missing markers and for what is none."""
    t = F.lower(F.trim(x))
    return F.when(~t.isin("", "x", "-", "-99", "na", "n/a", "null", "none", "nan"), t.try_cast("double"))
