"""Column functions. Every one maps Columns to a Column and stays in Catalyst."""

from .categories import (
    availability_category,
    bands,
    has_cleaning_fee,
    host_category,
    is_professional_host,
    price_category,
    review_category,
    simplify_room_type,
)
from .dates import clean_date
from .numbers import (
    clean_float,
    clean_int,
    clean_percentage,
    clean_price,
    float_text,
    parse_float,
    price_per_guest,
    round_cents,
    round_exact,
)
from .sql import SQL_FUNCTIONS, register_sql_functions
from .temporal import (
    date_from_ticks,
    decode_date,
    decode_datetime,
    decode_interval,
    decode_time,
    time_from_ticks,
    timestamp_from_ticks,
)
from .text import clean_text, count_items, parse_flag, rekey_url, strip
from .typed import (
    currency_text,
    is_null_token,
    typed_column,
    typed_currency,
    typed_date,
    typed_decimal,
    typed_integer,
    typed_number,
    typed_signed_decimal,
)

__all__ = [name for name in dir() if not name.startswith("_")]
