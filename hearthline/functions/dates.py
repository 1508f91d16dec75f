"""Date cleaning on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

_MONTH_FIRST = r"^([0-9]{1,2})/([0-9]{1,2}| [0-9])/([0-9]{4})\z"
_YEAR_FIRST = r"^(?!0000)[0-9]{4}(?:/[0-9]{1,2}/|-[0-9]{1,2}-)(?:[0-9]{1,2}| [0-9])\z"
_CANONICAL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def clean_date(c: Column | str) -> Column:
    """``yyyy-MM-dd`` text for y/m/d, y-m-d and m/d/y; any other text unchanged.

    Text is rearranged and cast: casts return NULL on bad dates, where pattern
    parsers raise and catch one exception per row. Canonical text comes back as it
    is whether or not it names a day, so it is not parsed at all.
    """
    text = as_column(c)
    ordered = F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2")
    readable = F.translate(F.regexp_extract(ordered, _YEAR_FIRST, 0), "/ ", "-")
    parsed = F.coalesce(readable.try_cast("date").cast("string"), text)
    return F.when(text.isNull(), "").when(text.rlike(_CANONICAL), text).otherwise(parsed)
