"""Typed access to decoded JSON. A field of the wrong type reads as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
# Epoch numbers below this are seconds, from here on milliseconds.
MILLIS_FROM = 100_000_000_000


def member(value: Column, path: str) -> Column:
    """Field of a VARIANT, still a VARIANT; null when missing."""
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    """A JSON string, else ''."""
    return F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise("")


def is_number(value: Column) -> Column:
    """Whether a scalar VARIANT is a JSON number."""
    return (
        kind(value).isin("BIGINT", "DOUBLE", "FLOAT")
        | F.startswith(kind(value), F.lit("DECIMAL"))
    )


def count(value: Column) -> Column:
    """A JSON number as a non-negative whole number, truncating; anything else 0."""
    whole = F.coalesce(
        F.try_variant_get(value, "$", "bigint"),
        F.try_variant_get(value, "$", "double").try_cast("bigint"),
        F.lit(0),
    )
    return F.when(is_number(value), F.greatest(whole, F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def number(value: Column) -> Column:
    """A JSON number as DOUBLE; anything else 0."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).otherwise(F.lit(0.0))


def truth(value: Column) -> Column:
    """A JSON boolean; anything else false."""
    return F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).otherwise(F.lit(False))


def is_filled_object(value: Column) -> Column:
    """Whether a VARIANT is an object with at least one member."""
    shape = kind(value)
    return F.coalesce(F.startswith(shape, F.lit("OBJECT<")) & (shape != "OBJECT<>"), F.lit(False))


def items(value: Column) -> Column:
    """Elements of a JSON array; anything else is the empty array."""
    empty = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), empty)


def epoch_micros(n: Column) -> Column:
    """Epoch seconds or milliseconds, told apart by size, as microseconds; 0 is unknown."""
    seconds = F.try_multiply(n, F.lit(MICROS).cast("bigint"))
    millis = F.try_multiply(n, F.lit(1000).cast("bigint"))
    return F.when(n == 0, F.lit(None).cast("bigint")).when(n < MILLIS_FROM, seconds).otherwise(millis)


# RFC 3339 with a zone, the same without one, and the blank-separated form.
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
ZONED = rf"\A{_DATE}T{_CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})\z"
UNZONED = rf"\A{_DATE}[T ]{_CLOCK}\z"


def text_micros(value: Column) -> Column:
    """A timestamp string as microseconds since the epoch, null if it is none."""
    dotted = F.translate(value, ",", ".")
    zoned = F.when(F.rlike(value, F.lit(ZONED)), dotted).when(
        F.rlike(value, F.lit(UNZONED)), F.concat(dotted, F.lit("Z"))
    )
    digits = F.when(F.rlike(value, F.lit(r"\A-?[0-9]+\z")), value)
    return F.coalesce(
        F.unix_micros(zoned.try_cast("timestamp")),
        epoch_micros(digits.try_cast("bigint")),
    )


def time_micros(value: Column) -> Column:
    """Any timestamp shape the logs use, from a VARIANT, as microseconds; null if unknown."""
    whole = F.coalesce(
        F.try_variant_get(value, "$", "bigint"),
        F.try_variant_get(value, "$", "double").try_cast("bigint"),
    )
    return F.when(
        kind(value) == "STRING", text_micros(F.try_variant_get(value, "$", "string"))
    ).when(is_number(value), epoch_micros(whole))


def span_seconds(start_us: Column, end_us: Column, below: int | None = None) -> Column:
    """Seconds from start to end, 0 unless end is later (and, if given, the gap is below a bound)."""
    gap = (end_us - start_us) / F.lit(float(MICROS))
    good = end_us > start_us
    if below is not None:
        good = good & (gap < below)
    return F.when(good, gap).otherwise(F.lit(0.0))


def epoch_seconds(us: Column) -> Column:
    """Whole seconds, 0 when unknown."""
    return F.coalesce(whole_div(us - F.pmod(us, F.lit(MICROS)), MICROS), F.lit(0).cast("bigint"))


def local_day(us: Column) -> Column:
    """Calendar day in the session's time zone, '' when unknown."""
    return F.coalesce(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd"), F.lit(""))


def day_of_ts(ts: Column) -> Column:
    """Calendar day of an epoch-seconds column, '' when it is 0."""
    return F.when(ts == 0, F.lit("")).otherwise(F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd"))


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer division that stays in BIGINT."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)
