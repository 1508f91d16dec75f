"""Guarded casts from staging text to the typed table: bad text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import float_text
from .text import as_column

# Accepted number and date forms, and texts that mean "no value".
INTEGER = "^[0-9]+$"
WHOLE_REAL = r"^[0-9]+(\.0+)?$"
DECIMAL = r"^[0-9]+(\.[0-9]+)?$"
SIGNED_DECIMAL = r"^[-+]?[0-9]*\.?[0-9]+$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LONG_DATE = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
SHORT_DATE = "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})$"
FIRST_YEAR = 70  # two-digit years from here on are 19xx
NULL_TOKENS = ["N/A", "NA", "NULL"]
# End of fixed values.


def _trimmed(c: Column | str) -> Column:
    return F.trim(as_column(c))


def is_null_token(c: Column | str) -> Column:
    return F.upper(_trimmed(c)).isin(NULL_TOKENS)


def _guarded(text: Column, pattern: str, kind: str) -> Column:
    """Cast text of the given form only: a failed cast to bigint costs an exception."""
    return F.when(text.rlike(pattern), text.try_cast(kind))


def typed_integer(c: Column | str, lenient: bool = False) -> Column:
    """Unsigned whole number; ``lenient`` also takes ``10.0``."""
    text = _trimmed(c)
    if lenient:
        return F.when(text.rlike(WHOLE_REAL), F.substring_index(text, ".", 1).try_cast("bigint"))
    return _guarded(text, INTEGER, "bigint")


def typed_decimal(c: Column | str, kind: str) -> Column:
    return _guarded(_trimmed(c), DECIMAL, kind)


def currency_text(c: Column | str) -> Column:
    """Trimmed text without dollar signs and thousands commas."""
    text = F.replace(_trimmed(c), F.lit("$"), F.lit(""))
    return F.replace(text, F.lit(","), F.lit(""))


def typed_currency(c: Column | str, kind: str = "decimal(10,2)") -> Column:
    return _guarded(currency_text(c), DECIMAL, kind)


def typed_signed_decimal(c: Column | str, kind: str = "decimal(12,8)") -> Column:
    return _guarded(_trimmed(c), SIGNED_DECIMAL, kind)


def typed_date(c: Column | str) -> Column:
    """m/d/yy, m/d/yyyy and yyyy-mm-dd; null tokens and anything else are NULL."""
    text = _trimmed(c)
    short_year = F.substring_index(text, "/", -1)
    century = F.when(short_year >= str(FIRST_YEAR), "19").otherwise("20")
    short = F.concat(century, F.regexp_replace(text, SHORT_DATE, "$3-$1-$2"))
    return (
        F.when(text.rlike(ISO_DATE), text.try_cast("date"))
        .when(text.rlike(LONG_DATE), F.regexp_replace(text, LONG_DATE, "$3-$1-$2").try_cast("date"))
        .when(text.rlike(SHORT_DATE), short.try_cast("date"))
    )


def typed_column(name: str, target: str, lenient_int: bool = False) -> Column:
    """The typed form of text column ``name``."""
    if target == "bigint":
        return typed_integer(name, lenient_int)
    if target == "decimal(10,2)":
        return typed_currency(name, target)
    if target == "decimal(12,8)":
        return typed_signed_decimal(name, target)
    if target.startswith("decimal"):
        return typed_decimal(name, target)
    if target == "date":
        return typed_date(name)
    return _trimmed(name)


def typed_number(name: str, kind: str, target: str, lenient_int: bool = False) -> Column:
    """The typed form of a cleaned number, without the trip through text.

    Gives what ``typed_column`` gives for the number's text form: only latitude and
    longitude take signs, whole numbers written as ``10.0`` are refused unless
    ``lenient_int``, and so are sizes whose text has an exponent.
    """
    x = F.col(name)
    is_double = kind == "double"
    if target == "string":
        return float_text(x) if is_double else x.cast("string")
    if target == "bigint":
        if not is_double:
            return F.when(x >= 0, x.cast("bigint"))
        whole = F.lit(lenient_int) & (x >= 0) & (x < 1e16) & (x == F.floor(x))
        return F.when(whole, x.try_cast("bigint"))
    plain = (F.abs(x) >= 1e-4) | (x == 0) if is_double else F.lit(True)
    if target != "decimal(12,8)":
        plain = plain & (x >= 0)
    return F.when(plain & ~F.isnan(x) if is_double else plain, x.try_cast(target))
