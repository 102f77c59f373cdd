"""Scalar rules on text and numbers, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HTTP_METHODS, OBJECT_ID

# Number texts that script-style conversion reads.
_DECIMAL = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_RADIX = {"[xX]": ("[0-9a-fA-F]", 16, 13), "[oO]": ("[0-7]", 8, 17), "[bB]": ("[01]", 2, 52)}  # digits a double holds exactly


def missing(c: Column) -> Column:
    """Null and the empty text both count as not given."""
    return c.isNull() | (c == "")


def default_text(c: Column, fallback: str) -> Column:
    return F.when(missing(c), F.lit(fallback)).otherwise(c)


def to_number(text: Column) -> Column:
    """Number in text form under script-style rules; null when it is none.

    Blank is 0; exponents, Infinity and 0x/0o/0b integers of any length are read. Give a plain column: the text is
    looked at several times.
    """
    number = (
        F.when(text.rlike(_DECIMAL), text.try_cast("double"))
        .when(text.rlike(r"^\s*$"), F.lit(0.0))
        .when(text.rlike(r"^\s*\+?Infinity\s*$"), F.lit(float("inf")))
    )
    for letter, (digit, base, exact) in _RADIX.items():
        pattern = rf"^\s*0{letter}(?={digit})0*({digit}*)\s*$"
        number = number.when(text.rlike(pattern), _radix_value(F.regexp_extract(text, pattern, 1), base, exact))
    return number


def _radix_value(digits: Column, base: int, exact: int) -> Column:
    """Digits without leading zeros: two exact parts, the rest as a power; what lies below both parts cannot be seen."""
    def part(first: int) -> Column:
        return F.coalesce(F.conv(F.nullif(F.substring(digits, first, exact), F.lit("")), base, 10).cast("double"), F.lit(0.0))

    size = F.length(digits)
    second = F.greatest(F.least(size - exact, F.lit(exact)), F.lit(0))
    rest = F.greatest(size - 2 * exact, F.lit(0))
    return (part(1) * F.pow(F.lit(float(base)), second) + part(exact + 1)) * F.pow(F.lit(float(base)), rest)


def http_method(c: Column) -> Column:
    """Upper-cased method, null when it is not one of the known seven."""
    upper = F.upper(c)
    return F.when(upper.isin(HTTP_METHODS), upper)


def is_object_id(c: Column) -> Column:
    return F.coalesce(c.rlike(OBJECT_ID), F.lit(False))


def is_error(status: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False))


def microseconds(latency_ms: Column) -> Column:
    """Latency rounded to three decimals of a millisecond, as whole microseconds.

    Null when it does not fit ten digits.
    """
    return (latency_ms.try_cast("decimal(10,3)") * F.lit(1000)).cast("long")


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number quotient rounded half away from zero, without a detour over doubles."""
    magnitude = F.call_function(
        "div", F.abs(numerator) * 2 + denominator, denominator * 2)
    return F.when(numerator < 0, -magnitude).otherwise(magnitude)


def rate_percent(part: Column, total: Column) -> Column:
    """Percentage with two decimals; 0 for an empty total."""
    return F.when(
        F.coalesce(total, F.lit(0)) > 0, _half_up(part * 10000, total) / F.lit(100.0)
    ).otherwise(F.lit(0.0))


def mean_ms(latency_us: Column, hits: Column) -> Column:
    """Unrounded mean in milliseconds; 0 when there are no hits."""
    return F.coalesce(
        latency_us.cast("double") / F.nullif(hits, F.lit(0)).cast("double") / F.lit(1000.0), F.lit(0.0))


def mean_ms_2dp(latency_us: Column, hits: Column) -> Column:
    """Mean in milliseconds with two decimals; 0 when there are no hits."""
    return F.when(
        F.coalesce(hits, F.lit(0)) > 0, _half_up(latency_us, hits * 10) / F.lit(100.0)
    ).otherwise(F.lit(0.0))


def ms_2dp(latency_us: Column) -> Column:
    return F.coalesce(_half_up(latency_us, F.lit(10)) / F.lit(100.0), F.lit(0.0))


def fixed_2dp(number: Column) -> Column:
    """Two-decimal text form of an already rounded number."""
    return F.format_string("%.2f", number)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lit(needle.lower()))


def any_contains_ignoring_case(texts: Column, needle: str) -> Column:
    return F.exists(texts, lambda t: contains_ignoring_case(t, needle))


def new_event_id() -> Column:
    """Random id. It changes when the plan runs again: write it before using it twice."""
    return F.uuid()
