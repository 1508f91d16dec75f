"""Staging text to typed rows, and the report of rows that do not convert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typed import DECIMAL, INTEGER, currency_text, typed_column, typed_number
from ..schema import FIELDS, Field

# Fixed value: rows shown in the report.
BAD_ROWS_SHOWN = 50


def typed_listings(listings: DataFrame, lenient_int: bool = False) -> DataFrame:
    """Typed columns; values that do not fit their type become NULL.

    Takes staging text, or cleaned listings directly: the result is the same.
    """
    kinds = dict(listings.dtypes)

    def column(field: Field) -> Column:
        kind = kinds[field.name]
        if kind == "string":
            return typed_column(field.name, field.target, lenient_int)
        return typed_number(field.name, kind, field.target, lenient_int)

    return listings.select(*(column(f).alias(f.name) for f in FIELDS if f.name in kinds))


def is_bad_row() -> Column:
    """host_id no whole number, or price no amount; an unknown answer is no complaint."""
    bad_host = ~F.trim("host_id").rlike(INTEGER)
    bad_price = ~currency_text("price").rlike(DECIMAL)
    return bad_host | bad_price


def bad_rows(staging: DataFrame, limit: int | None = BAD_ROWS_SHOWN) -> DataFrame:
    """Rows whose host or price does not convert, first ``limit`` by id."""
    bad = staging.where(is_bad_row()).select("id", "host_id", "price")
    return bad if limit is None else bad.orderBy("id", "host_id", "price").limit(limit)
