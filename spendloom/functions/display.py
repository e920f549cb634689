"""Columns formatted for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import whole_div


def fixed(x: Column, digits: int) -> Column:
    """Fixed number of decimals, rounding the exact binary value as C's printf does."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def duration(seconds: Column) -> Column:
    """1h02m, 3m04s, 5s, 250ms or 0s."""
    total = seconds.cast("bigint")
    h = whole_div(total, 3600)
    m = whole_div(total % 3600, 60)
    s = total % 60
    return (
        F.when(seconds <= 0, F.lit("0s"))
        .when(seconds < 1, F.concat(fixed(seconds * 1000, 0), F.lit("ms")))
        .when(h > 0, F.format_string("%dh%02dm", h, m))
        .when(m > 0, F.format_string("%dm%02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def grouped(n: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(n, 0)


def compact(n: Column) -> Column:
    """1,234 below a thousand grouped, then 1.2k, 1.2M, 1.2B."""
    return (
        F.when(n < 1000, grouped(n))
        .when(n < 1_000_000, F.concat(fixed(n / F.lit(1e3), 1), F.lit("k")))
        .when(n < 1_000_000_000, F.concat(fixed(n / F.lit(1e6), 1), F.lit("M")))
        .otherwise(F.concat(fixed(n / F.lit(1e9), 1), F.lit("B")))
    )


def age(seconds: Column) -> Column:
    """How long ago, in the coarsest useful unit."""
    n = seconds.cast("bigint")
    return (
        F.when(seconds < 2, F.lit("just now"))
        .when(seconds < 60, F.format_string("%ds ago", n))
        .when(seconds < 3600, F.format_string("%dm ago", whole_div(n, 60)))
        .when(seconds < 86400, F.format_string("%dh %dm ago", whole_div(n, 3600), whole_div(n, 60) % 60))
        .otherwise(F.format_string("%dd ago", whole_div(n, 86400)))
    )


def minute_text(ts: Column) -> Column:
    """Local date and minute, or 'unknown'."""
    return F.when(ts == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm"))


def second_text(ts: Column) -> Column:
    """Local date and second, or 'unknown'."""
    return F.when(ts == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss"))
