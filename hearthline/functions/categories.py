"""Derived categories and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

# Upper bounds (exclusive) and labels of the bands.
PRICE_BANDS = [(75, "budget"), (150, "moderate"), (300, "expensive")]
REVIEW_BANDS = [(5, "few"), (20, "moderate"), (50, "many")]
AVAILABILITY_BANDS = [
    (30, "rarely_available"),
    (180, "occasionally_available"),
    (300, "mostly_available"),
]
# Words looked for in a room type, in this order.
ROOM_WORDS = [("entire", "Entire"), ("private", "Private"), ("shared", "Shared")]


def bands(c: Column, bounds: list[tuple[float, str]], above: str, first: Column) -> Column:
    """Extend the case ``first`` with one label per upper bound, then ``above``."""
    case = first
    for bound, label in bounds:
        case = case.when(c < bound, label)
    return case.otherwise(above)


def price_category(price: Column | str) -> Column:
    p = as_column(price)
    return bands(p, PRICE_BANDS, "luxury", F.when(p <= 0, "unknown"))


def review_category(count: Column | str) -> Column:
    n = as_column(count)
    return bands(n, REVIEW_BANDS, "very_popular", F.when(n == 0, "no_reviews"))


def availability_category(days: Column | str) -> Column:
    d = as_column(days)
    return bands(d, AVAILABILITY_BANDS, "highly_available", F.when(d == 0, "not_available"))


def host_category(superhost: Column | str, rate: Column | str) -> Column:
    # Spark sorts NaN above every number, so it is kept out of the comparisons.
    r = F.nanvl(as_column(rate), F.lit(0.0))
    return (
        F.when(as_column(superhost) == 1, "superhost")
        .when(r >= 90, "responsive")
        .when(r >= 50, "moderate")
        .otherwise("low_response")
    )


def simplify_room_type(room_type: Column | str, apt_is_entire: bool = False) -> Column:
    text = F.lower(as_column(room_type))
    case = F
    for word, label in ROOM_WORDS:
        hit = text.contains(word)
        if word == "entire" and apt_is_entire:
            hit = hit | text.contains("apt")
        case = case.when(hit, label)
    return case.otherwise("Other")


def is_professional_host(listings: Column | str) -> Column:
    return (as_column(listings) > 3).cast("int")


def has_cleaning_fee(fee: Column | str) -> Column:
    return (as_column(fee) > 0).cast("int")
