"""The cleaning and derived-column projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import CLEANED_FIELDS, LISTING_COLUMNS, Field
from .gates import CLEAN, OUTCOME, PRICE, VARIANTS, Variant, judge_rows, raw_column

_GUESTS = "_guests"
_ROOM = "_room"
_READS = {
    "price_category": ["price"],
    "review_category": ["number_of_reviews"],
    "host_category": ["host_is_superhost", "host_response_rate"],
    "availability_category": ["availability_365"],
    "room_type_simplified": [],
    "is_professional_host": ["host_listings_count"],
    "has_cleaning_fee": ["cleaning_fee"],
    "price_per_guest": ["price"],
}


def _cleaned(df: DataFrame, field: Field, variant: Variant) -> Column:
    if field.name == "price":
        return F.col(PRICE)
    default = variant.accommodates_default if field.name == "accommodates" else None
    raw = raw_column(df, field.name, default)
    match field.clean:
        case "strip":
            return fn.strip(raw)
        case "text":
            return fn.clean_text(raw, field.width)
        case "date":
            return fn.clean_date(raw)
        case "percent":
            return fn.clean_percentage(raw)
        case "real":
            return fn.clean_float(raw)
        case "money":
            return fn.clean_price(raw)
        case "whole":
            return fn.clean_int(raw)
        case "items":
            return fn.count_items(raw)
        case "flag":
            return fn.parse_flag(raw)
        case _:
            return raw


def clean_listings(
    judged: DataFrame, variant: Variant, columns: list[str] | None = None
) -> DataFrame:
    """Cleaned and derived columns of the rows that passed the gates.

    Two projections: the second reads columns the first has computed. ``columns``
    leaves out work nobody asked for.
    """
    wanted = columns or LISTING_COLUMNS
    needed = set(wanted).union(*(_READS.get(c, []) for c in wanted))
    kept = judged.where(F.col(OUTCOME) == CLEAN)
    position = [c for c in judged.columns if c in ("_file", "_block", "_row")]
    cleaned = kept.select(
        *(_cleaned(judged, f, variant).alias(f.name) for f in CLEANED_FIELDS if f.name in needed),
        # An absent column counts as one guest here and an unnamed room, whatever
        # the defaults of the output columns are.
        fn.clean_int(raw_column(judged, "accommodates", "1")).alias(_GUESTS),
        raw_column(judged, "room_type", "").alias(_ROOM),
        *position,
    )
    derived = {
        "price_category": fn.price_category("price"),
        "review_category": fn.review_category("number_of_reviews"),
        "host_category": fn.host_category("host_is_superhost", "host_response_rate"),
        "availability_category": fn.availability_category("availability_365"),
        "room_type_simplified": fn.simplify_room_type(_ROOM, variant.apt_is_entire),
        "is_professional_host": fn.is_professional_host("host_listings_count"),
        "has_cleaning_fee": fn.has_cleaning_fee("cleaning_fee"),
        "price_per_guest": fn.price_per_guest("price", _GUESTS),
    }
    return cleaned.withColumns({n: c for n, c in derived.items() if n in wanted}).select(
        *wanted, *position
    )


def transform_listings(
    raw: DataFrame, variant: str = "scale", columns: list[str] | None = None
) -> DataFrame:
    """Raw all-text listings to the 68 cleaned columns, or the ``columns`` asked for.

    Stateless, so streams work too.
    """
    chosen = VARIANTS[variant]
    cleaned = clean_listings(judge_rows(raw, chosen), chosen, columns)
    return cleaned.select(*(columns or LISTING_COLUMNS))
