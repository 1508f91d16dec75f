"""The column functions for queries written in SQL, as temporary SQL functions.

Each one is a SQL expression that Catalyst puts in place of the call, so a query in SQL runs
the same plan as its DataFrame twin: no call, no Python is left. They last as long as the
session. Arguments are cast to the types of the parameters; NULLs go where the column
functions put them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import categories, dates, numbers, temporal, text, typed

# Name in SQL: what makes the column, and its parameters with their types.
SQL_FUNCTIONS: dict[str, tuple[Callable[..., Column], str]] = {
    "clean_text": (text.clean_text, "value STRING"),
    "strip_blanks": (text.strip, "value STRING"),
    "parse_flag": (text.parse_flag, "value STRING"),
    "count_items": (text.count_items, "value STRING"),
    "rekey_url": (text.rekey_url, "url STRING, old STRING, new STRING"),
    "clean_price": (numbers.clean_price, "value STRING"),
    "clean_float": (numbers.clean_float, "value STRING"),
    "clean_int": (numbers.clean_int, "value STRING"),
    "clean_percentage": (numbers.clean_percentage, "value STRING"),
    "price_per_guest": (numbers.price_per_guest, "price DOUBLE, guests BIGINT"),
    "clean_date": (dates.clean_date, "value STRING"),
    "simplify_room_type": (categories.simplify_room_type, "value STRING"),
    "price_category": (categories.price_category, "price DOUBLE"),
    "review_category": (categories.review_category, "reviews BIGINT"),
    "availability_category": (categories.availability_category, "days BIGINT"),
    "host_category": (categories.host_category, "superhost INT, rate DOUBLE"),
    "is_professional_host": (categories.is_professional_host, "listings BIGINT"),
    "has_cleaning_fee": (categories.has_cleaning_fee, "fee DOUBLE"),
    "is_null_token": (typed.is_null_token, "value STRING"),
    "typed_integer": (typed.typed_integer, "value STRING"),
    "typed_decimal": (lambda c: typed.typed_decimal(c, "decimal(10,2)"), "value STRING"),
    "typed_currency": (typed.typed_currency, "value STRING"),
    "typed_signed_decimal": (typed.typed_signed_decimal, "value STRING"),
    "typed_date": (typed.typed_date, "value STRING"),
    "decode_date": (temporal.decode_date, "value STRING"),
    "decode_datetime": (temporal.decode_datetime, "value STRING"),
    "decode_interval": (temporal.decode_interval, "value STRING"),
    "decode_time": (temporal.decode_time, "value STRING"),
    "date_from_ticks": (temporal.date_from_ticks, "ticks DOUBLE"),
    "time_from_ticks": (temporal.time_from_ticks, "ticks DOUBLE"),
    "timestamp_from_ticks": (temporal.timestamp_from_ticks, "ticks DOUBLE"),
}


def sql_body(spark: SparkSession, name: str) -> str:
    """The SQL text of a function's expression over its parameters, as Catalyst writes it."""
    make, parameters = SQL_FUNCTIONS[name]
    column = make(*(F.col(p.split()[0]) for p in parameters.split(", ")))
    return spark._jsparkSession.expression(column._jc).sql()


def register_sql_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create all functions in this session; their names, each with ``prefix`` before it."""
    for name, (_, parameters) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURN {sql_body(spark, name)}")
    return [prefix + name for name in SQL_FUNCTIONS]
