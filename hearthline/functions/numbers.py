"""Number cleaning: text to numbers, cent rounding, numbers back to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANK, as_column

_DIGITS = "[0-9]++(?:_[0-9]++)*+"
_DECIMAL = rf"(?:{_DIGITS}\.?+(?:{_DIGITS})?+|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?+"
_PLAIN = r"^-?[0-9]++(?:\.[0-9]++)?\z"
_WORD = "[+-]?(?i:inf|infinity)|(?i:nan)"
# Group 1 is a number or word the cast reads; it takes no sign before nan.
_FLOAT = rf"(?U)^{BLANK}*+(?:[+-](?=(?i:nan)))?([+-]?{_DECIMAL}|{_WORD}){BLANK}*+$"
_PRICE = r"^(?:[0-9]++\.?[0-9]*+|\.[0-9]++)$"
_WHOLE_CENTS = r"^(?:[0-9]++\.?[0-9]{0,2}|\.[0-9]{1,2})$"


def parse_float(c: Column | str) -> Column:
    """Double for decimal, exponent, inf and nan notation, else NULL.

    The pattern keeps out Java-only forms such as ``1.0d`` and ``0x1p3`` that a
    plain cast would take; text that does not match becomes empty and casts to NULL.
    Plain numbers and empty fields, which is most of them, are settled before it.
    """
    text = as_column(c)
    number = F.replace(F.regexp_extract(text, _FLOAT, 1), F.lit("_"), F.lit(""))
    return F.when(text.rlike(_PLAIN), text.try_cast("double")).when(
        text != "", number.try_cast("double")
    )


def clean_float(c: Column | str) -> Column:
    return F.coalesce(parse_float(c), F.lit(0.0))


def clean_int(c: Column | str) -> Column:
    """Whole part of a number; 0 for anything unreadable or beyond 64 bits."""
    return F.coalesce(parse_float(c).try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_percentage(c: Column | str) -> Column:
    return clean_float(F.replace(as_column(c), F.lit("%"), F.lit("")))


def exact_text(c: Column, places: int) -> Column:
    """Fixed-point text of a double, rounded on its exact binary value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))


def round_exact(c: Column | str, places: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    To two places 85.0 / 8 = 10.625 gives 10.62, and 2.675, which lies just below
    the tie, gives 2.67; ``round`` would give 10.63 and 2.68. Arithmetic settles
    every value that is not next to a tie; only the rest goes through the exact
    decimal formatter.
    """
    x = as_column(c)
    unit = 10**places
    scaled = x * unit
    clear = (F.abs(x) < 1e9 / unit) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6)
    exact = exact_text(x, places).try_cast("double")
    return F.when(clear, F.rint(scaled) / unit).otherwise(F.coalesce(exact, x))


def round_cents(c: Column | str) -> Column:
    return round_exact(c, 2)


def clean_price(c: Column | str) -> Column:
    """Keep digits and dots, read them as a number, round to cents; else 0. Never NULL.

    Text with two decimals at most needs no rounding; most of it has nothing to drop but a
    dollar sign and commas. A number beyond a double is infinite; only then has the formatted
    text no number.
    """
    text = as_column(c)
    # Read twice each, as a filter pushed below the text's projection makes the text again for every mention.
    amount = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    digits = F.regexp_replace(text, "[^0-9.]++", "")
    return (
        F.when(amount.rlike(_WHOLE_CENTS), amount.try_cast("double"))
        .when(digits.rlike(_PRICE), F.coalesce(exact_text(digits.try_cast("double"), 2).try_cast("double"), F.lit(float("inf"))))
        .otherwise(0.0)
    )


def price_per_guest(price: Column | str, guests: Column | str) -> Column:
    return round_cents(as_column(price) / F.greatest(as_column(guests), F.lit(1)))


def float_text(c: Column | str) -> Column:
    """Shortest positional text of a double: ``12345678.0``, not ``1.2345678E7``.

    Numbers from 0.001 to below 10**7, and 0, are cast to positional text anyway.
    """
    x = as_column(c)
    text = x.cast("string")
    size = F.abs(x)
    digits = F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", "")
    positional = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    power_text = F.abs(power).cast("string")
    padded = F.when(F.length(power_text) < 2, F.lpad(power_text, 2, "0")).otherwise(power_text)
    return (
        F.when((size >= 1e-3) & (size < 1e7) | (size == 0), text)
        .when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(F.concat(mantissa, sign, padded))
    )
