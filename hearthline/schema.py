"""The listings data model: one table drives cleaning, staging and typing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """One listings column.

    ``clean``   rule that turns raw text into the cleaned value
    ``target``  type in the typed table (``string`` columns are only trimmed)
    ``default`` raw text assumed when the input has no such column at all
    ``width``   longest text kept by the ``text`` rule
    """

    name: str
    clean: str
    target: str = "string"
    default: str = ""
    width: int | None = None


# Column names, their order, defaults, widths and target types.
CLEANED_FIELDS = [
    Field("id", "strip"),
    Field("listing_url", "keep"),
    Field("last_scraped", "keep"),
    Field("name", "text", width=200),
    Field("description", "text", width=1000),
    Field("property_type", "keep", default="Unknown"),
    Field("room_type", "keep", default="Unknown"),
    Field("host_id", "strip", "bigint"),
    Field("host_name", "text", width=100),
    Field("host_since", "date", "date"),
    Field("host_response_time", "keep", default="N/A"),
    Field("host_response_rate", "percent"),
    Field("host_acceptance_rate", "percent"),
    Field("host_is_superhost", "flag", default="f"),
    Field("host_listings_count", "whole", "bigint", default="0"),
    Field("host_identity_verified", "flag", default="f"),
    Field("street", "text", width=200),
    Field("neighbourhood", "strip"),
    Field("neighbourhood_cleansed", "strip"),
    Field("neighbourhood_group_cleansed", "strip"),
    Field("city", "strip", default="Seattle"),
    Field("state", "strip", default="WA"),
    Field("zipcode", "strip"),
    Field("latitude", "real", "decimal(12,8)", default="0"),
    Field("longitude", "real", "decimal(12,8)", default="0"),
    Field("is_location_exact", "flag", default="f"),
    Field("accommodates", "whole", "bigint", default="0"),
    Field("bathrooms", "real", "decimal(6,2)", default="0"),
    Field("bedrooms", "whole", "decimal(6,2)", default="0"),
    Field("beds", "whole", "decimal(6,2)", default="0"),
    Field("bed_type", "keep", default="Unknown"),
    Field("amenities", "items", default="{}"),
    Field("square_feet", "whole", "bigint", default="0"),
    Field("price", "money", "decimal(10,2)", default="0"),
    Field("weekly_price", "money", "decimal(10,2)", default="0"),
    Field("monthly_price", "money", "decimal(10,2)", default="0"),
    Field("security_deposit", "money", "decimal(10,2)", default="0"),
    Field("cleaning_fee", "money", "decimal(10,2)", default="0"),
    Field("guests_included", "whole", "bigint", default="1"),
    Field("extra_people", "money", "decimal(10,2)", default="0"),
    Field("minimum_nights", "whole", "bigint", default="1"),
    Field("maximum_nights", "whole", "bigint", default="365"),
    Field("instant_bookable", "flag", default="f"),
    Field("cancellation_policy", "keep", default="flexible"),
    Field("has_availability", "flag", default="t"),
    Field("availability_30", "whole", "bigint", default="0"),
    Field("availability_60", "whole", "bigint", default="0"),
    Field("availability_90", "whole", "bigint", default="0"),
    Field("availability_365", "whole", "bigint", default="0"),
    Field("number_of_reviews", "whole", "bigint", default="0"),
    Field("first_review", "date", "date"),
    Field("last_review", "date", "date"),
    Field("review_scores_rating", "real", "decimal(5,2)", default="0"),
    Field("review_scores_accuracy", "real", "bigint", default="0"),
    Field("review_scores_cleanliness", "real", "bigint", default="0"),
    Field("review_scores_checkin", "real", "bigint", default="0"),
    Field("review_scores_communication", "real", "bigint", default="0"),
    Field("review_scores_location", "real", "bigint", default="0"),
    Field("review_scores_value", "real", "bigint", default="0"),
    Field("reviews_per_month", "real", "decimal(6,2)", default="0"),
]
DERIVED_FIELDS = [
    Field("price_category", "derived"),
    Field("review_category", "derived"),
    Field("host_category", "derived"),
    Field("availability_category", "derived"),
    Field("room_type_simplified", "derived"),
    Field("is_professional_host", "derived"),
    Field("has_cleaning_fee", "derived"),
    Field("price_per_guest", "derived", "decimal(10,2)"),
]
# End of fixed values.

FIELDS = CLEANED_FIELDS + DERIVED_FIELDS
RAW_COLUMNS = [f.name for f in CLEANED_FIELDS]
LISTING_COLUMNS = [f.name for f in FIELDS]
STRIPPED_COLUMNS = [f.name for f in CLEANED_FIELDS if f.clean == "strip"]
SEQUENCE_COLUMN = "sequential_id"

CLEANED_TYPES = {
    "strip": T.StringType(),
    "keep": T.StringType(),
    "text": T.StringType(),
    "date": T.StringType(),
    "percent": T.DoubleType(),
    "real": T.DoubleType(),
    "money": T.DoubleType(),
    "whole": T.LongType(),
    "items": T.IntegerType(),
    "flag": T.IntegerType(),
}


def text_schema(names: list[str]) -> T.StructType:
    """An all-text schema, as used by raw files and staging tables."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def typed_schema() -> str:
    """DDL of the typed listings table."""
    return ", ".join(f"`{f.name}` {f.target}" for f in FIELDS)
