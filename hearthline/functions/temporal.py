"""Database text to temporal values. Text that is no valid value is kept as ``raw``.

A Spark column has one type, so each decoder returns a struct in which exactly one
field is set (all are NULL for a NULL input).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, strip

# The text forms that are read.
_CLOCK = r"([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})(?:.([0-9]{1,6}))?"
_DATETIME = (
    r"^([0-9]{1,4})(-[0-9]{1,2}-[0-9]{1,2}[T ][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})(?:.([0-9]{1,6}))?"
)
_TIME = rf"^{_CLOCK}"
_INTERVAL = r"^(-)?([0-9]{1,3}):([0-9]{1,2}):([0-9]{1,2})(?:.([0-9]{1,6}))?"
_WHOLE = r"^[+]?[0-9]+$"
# End of fixed values.


def _group(c: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(c, pattern, index)


def _date_text(year: Column, month: Column, day: Column) -> Column:
    """Text that casts to a date only when the parts form one (no year 0)."""
    padded = F.lpad(year, 4, "0")
    return F.when(padded != "0000", F.concat_ws("-", padded, month, day))


def _clock_text(hour: Column, minute: Column, second: Column, fraction: Column) -> Column:
    return F.concat(
        F.concat_ws(":", F.lpad(hour, 2, "0"), F.lpad(minute, 2, "0"), F.lpad(second, 2, "0")),
        F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""),
    )


def _plain_date(c: Column) -> Column:
    parts = F.split(c, "-", 3)
    pieces = [strip(F.get(parts, F.lit(i))) for i in range(3)]
    whole = pieces[0].rlike(_WHOLE) & pieces[1].rlike(_WHOLE) & pieces[2].rlike(_WHOLE)
    # Leading zeros carry no meaning here and would make the cast fail.
    year, month, day = (
        F.coalesce(F.nullif(F.regexp_replace(p, "^[+]?0*", ""), F.lit("")), F.lit("0"))
        for p in pieces
    )
    fits = F.length(year) <= 4
    return F.when(whole & fits, _date_text(year, month, day).try_cast("date"))


def decode_date(c: Column | str) -> Column:
    """struct(value date, raw string)."""
    text = as_column(c)
    value = _plain_date(text)
    return F.struct(value.alias("value"), F.when(value.isNull(), text).alias("raw"))


def decode_datetime(c: Column | str) -> Column:
    """struct(value timestamp_ntz, day date, raw string); a bare date sets ``day``."""
    text = as_column(c)
    year = F.lpad(_group(text, _DATETIME, 1), 4, "0")  # "0000" without a match, too
    rest, fraction = _group(text, _DATETIME, 2), _group(text, _DATETIME, 3)
    stamp = F.concat(year, rest, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""))
    value = F.when(year != "0000", stamp.try_cast("timestamp_ntz"))
    plain = F.when(value.isNull(), _plain_date(text))
    return F.struct(
        value.alias("value"),
        plain.alias("day"),
        F.when(value.isNull() & plain.isNull(), text).alias("raw"),
    )


def decode_interval(c: Column | str) -> Column:
    """struct(value day-time interval, raw string); hours may go up to 999."""
    text = as_column(c)
    sign, hour, minute, second, fraction = (_group(text, _INTERVAL, i) for i in range(1, 6))
    seconds = F.concat(second, F.lit("."), F.rpad(fraction, 6, "0")).try_cast("decimal(18,6)")
    span = F.make_dt_interval(
        F.lit(0), hour.try_cast("int"), minute.try_cast("int"), seconds
    )
    signed = F.when(sign == "-", -span).otherwise(span)
    value = F.when(text.rlike(_INTERVAL), signed)
    return F.struct(value.alias("value"), F.when(value.isNull(), text).alias("raw"))


def decode_time(c: Column | str) -> Column:
    """struct(value ``HH:mm:ss[.ffffff]`` text, raw string) for a time of day."""
    text = as_column(c)
    hour, minute, second, fraction = (_group(text, _TIME, i) for i in range(1, 5))
    in_range = (
        (hour.try_cast("int") < 24)
        & (minute.try_cast("int") < 60)
        & (second.try_cast("int") < 60)
    )
    value = F.when(text.rlike(_TIME) & in_range, _clock_text(hour, minute, second, fraction))
    return F.struct(value.alias("value"), F.when(value.isNull(), text).alias("raw"))


def _instant(ticks: Column | str) -> Column:
    return F.timestamp_seconds(F.floor(as_column(ticks)))


def date_from_ticks(ticks: Column | str) -> Column:
    """Epoch seconds to the local date of the session time zone."""
    return F.to_date(_instant(ticks))


def time_from_ticks(ticks: Column | str) -> Column:
    """Epoch seconds to the local time of day, as text."""
    return F.date_format(_instant(ticks), "HH:mm:ss")


def timestamp_from_ticks(ticks: Column | str) -> Column:
    """Epoch seconds to the local wall-clock timestamp."""
    return _instant(ticks).cast("timestamp_ntz")
