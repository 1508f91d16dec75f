"""Text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Texts that mean "yes".
YES_WORDS = ["t", "true", "1", "yes"]

# The same characters as a pattern; one property test is far faster than a list of
# ranges. Runs that are a lone space already are left out, so most words are skipped.
BLANK = r"[\s\x1c-\x1f]"
_UNEVEN_RUN = rf"(?U)(?! [^\s\x1c-\x1f]){BLANK}+"
# Text of these characters alone has no blanks but spaces; one range is the cheapest test there is.
_BEYOND_ASCII = "[^ -~]"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop white space at both ends."""
    return F.btrim(as_column(c), F.lit(BLANKS))


def clean_text(c: Column | str, max_length: int | None = None) -> Column:
    """Collapse white space, trim, and shorten with an ellipsis."""
    given = F.coalesce(as_column(c), F.lit(""))
    # Most text is plain, and its runs are pairs of spaces at most.
    halved = F.replace(given, F.lit("  "), F.lit(" "))
    settled = ~given.rlike(_BEYOND_ASCII) & ~halved.contains("  ")
    text = F.trim(F.when(settled, halved).otherwise(F.regexp_replace(given, _UNEVEN_RUN, " ")))
    if max_length is None:
        return text
    shortened = F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    # Text of few bytes has few characters, and need not be counted.
    too_long = (F.octet_length(text) > max_length) & (F.char_length(text) > max_length)
    return F.when(too_long, shortened).otherwise(text)


def parse_flag(c: Column | str) -> Column:
    """1 for a yes-word in any case, else 0. No trimming."""
    return F.coalesce(F.lower(as_column(c)).isin(YES_WORDS), F.lit(False)).cast("int")


def count_items(c: Column | str) -> Column:
    """Number of comma-separated items in ``{a,b,...}``."""
    body = F.btrim(as_column(c), F.lit("{}"))
    # A comma is one byte, so byte lengths count commas without splitting.
    commas = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(","), F.lit("")))
    return F.when(body != "", commas + 1).otherwise(0)


def rekey_url(url: Column | str, old: Column, new: Column) -> Column:
    """Replace every ``/rooms/<old>`` in a URL by ``/rooms/<new>``."""
    room = F.lit("/rooms/")
    return F.replace(as_column(url), F.concat(room, old), F.concat(room, new))
