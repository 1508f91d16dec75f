"""A raw, all-text listings view over the ``orders`` table.

The driver tables hold no listings, so one row of messy listing text is derived from
every order. The expressions are plain SQL that Spark and DuckDB read alike: both
sides start from the same input, and everything after it is computed independently.
NULL stands for a field that a short record lacks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Whole-number helpers of the view, over one row of orders.
_BASE = {
    "k": "o_orderkey",
    "u": "o_custkey",
    "c": "cast(round(o_totalprice) as bigint)",
    "d": "cast(cast(o_orderdate as date) as string)",
    "p": "lower(o_orderpriority)",
}
_CENTS = (
    "case when k % 29 = 0 then c * 10 when k % 3 = 0 then c % 40000 "
    "when k % 7 = 0 then c % 20000 else c end"
)


def _text(number: str) -> str:
    return f"cast({number} as string)"


def _div(number: str, by: int) -> str:
    return f"cast(floor(({number}) / {by}) as bigint)"


def _amount(cents: str) -> str:
    """``$1,234.05`` from cents."""
    dollars, rest = _div(cents, 100), f"lpad({_text(f'({cents}) % 100')}, 2, '0')"
    thousands = f"{_text(_div(cents, 100000))} || ',' || lpad({_text(f'{dollars} % 1000')}, 3, '0')"
    body = f"case when {cents} >= 100000 then {thousands} else {_text(dollars)} end"
    return f"'$' || {body} || '.' || {rest}"


def _date(key: str) -> str:
    y, m, d = "substr(d, 1, 4)", "substr(d, 6, 2)", "substr(d, 9, 2)"
    return (
        f"case {key} when 0 then {y} || '/' || {m} || '/' || {d} when 1 then d "
        f"when 2 then {m} || '/' || {d} || '/' || {y} "
        f"when 3 then {_text(f'cast({m} as int)')} || '/' || {_text(f'cast({d} as int)')} || '/' || {y} "
        f"when 4 then {_text(f'cast({m} as int)')} || '/' || {d} || '/' || substr(d, 3, 2) "
        f"when 5 then 'bad date' when 6 then y30 when 7 then 'n/a' else '' end"
    ).replace("y30", f"{y} || '-02-30'")


def _score(key: str) -> str:
    return f"case when {key} % 6 = 0 then '' else {_text(f'2 + {key} % 9')} end"


RAW_EXPRESSIONS = {
    "id": f"case when k % 97 = 0 then ' ' when k % 89 = 0 then 'a' || {_text('k')} "
    f"when k % 11 = 0 then ' 00' || {_text('k')} || ' ' else {_text('k')} end",
    "listing_url": f"'https://www.example.com/rooms/' || {_text('k')}",
    "last_scraped": "d",
    "name": "case when k % 194 = 0 then '' when k % 83 = 0 then null "
    f"else '  Home\t' || o_orderpriority || '\r\n nr  ' || {_text('k')} || ' ' end",
    "description": f"repeat('Bright room,  \"view\" ' || {_text('u')} || ' ', cast(k % 60 as int))",
    "property_type": "case when k % 5 = 0 then 'House' else 'Apartment' end",
    "room_type": "case k % 5 when 0 then 'Entire home/apt' when 1 then 'Private room' "
    "when 2 then 'Shared room' when 3 then 'Studio apt' else 'Yurt' end",
    "host_id": "case when k % 71 = 0 then null when k % 17 = 0 then 'x' || " + _text("u")
    + f" else ' ' || {_text('u')} end",
    "host_name": f"'Host \t' || {_text('u')}",
    "host_since": _date("k % 9"),
    "host_response_time": "case when k % 4 = 0 then 'N/A' else 'within an hour' end",
    "host_response_rate": f"case when k % 13 = 0 then 'N/A' else {_text('k % 101')} || '%' end",
    "host_acceptance_rate": f"case when k % 14 = 0 then '' else {_text('k % 99')} || '.5 %' end",
    "host_is_superhost": "case when k % 5 = 0 then 't' when k % 35 = 1 then 'TRUE' else 'f' end",
    "host_listings_count": f"{_text('k % 9')} || case when k % 2 = 0 then '.0' else '' end",
    "host_identity_verified": "case when k % 3 = 0 then 'Yes' when k % 3 = 1 then ' t' else '0' end",
    "street": f"'  ' || p || ' street,\t Nr. ' || {_text('u')}",
    "neighbourhood": f"' NATION_' || {_text('u % 25')}",
    "neighbourhood_cleansed": f"'nation ' || {_text('u % 25')} || ' '",
    "neighbourhood_group_cleansed": "case when k % 79 = 0 then null else 'group ' || p end",
    "city": "case when k % 10 = 0 then '' else 'Seattle ' end",
    "state": "case when k % 2 = 0 then 'WA' else 'wa' end",
    "zipcode": f"case when k % 41 = 0 then null else {_text('98000 + u % 100')} end",
    "latitude": f"case when k % 33 = 0 then 'north' else '47.' || {_text('500000 + u')} end",
    "longitude": f"'-122.' || {_text('300000 + u')}",
    "is_location_exact": "case when k % 2 = 0 then '1' else 'no' end",
    "accommodates": f"case when k % 50 = 0 then '' else {_text('k % 9')} end",
    "bathrooms": f"{_text('k % 4')} || '.5'",
    "bedrooms": f"{_text('k % 5')} || '.0'",
    "beds": f"case when k % 21 = 0 then '-3.7' else {_text('k % 6')} end",
    "bed_type": "'Real Bed'",
    "amenities": "case k % 5 when 0 then '{}' when 1 then '{TV}' "
    "when 2 then '{TV,\"Cable TV\",Wifi}' when 3 then '{,}' else '{\"a, b\",Heating}' end",
    "square_feet": f"case when k % 3 = 0 then '' else {_text('k % 2000')} || '.9' end",
    "price": f"case when k % 23 = 0 then '' when k % 31 = 0 then 'free' "
    f"when k % 37 = 0 then '$' || {_text('k % 300')} || '.' || lpad({_text('(k % 100) * 10 + 5')}, 3, '0') "
    f"else {_amount('cents')} end",
    "weekly_price": f"case when k % 4 = 0 then '' else {_amount('(cents * 6)')} end",
    "monthly_price": f"case when k % 8 = 0 then '' else {_amount('(cents * 20)')} end",
    "security_deposit": f"case when k % 6 = 0 then '1.2.3' else {_amount('(c % 90000)')} end",
    "cleaning_fee": f"case when k % 3 = 0 then '' when k % 3 = 1 then '-5' else {_amount('(c % 9000)')} end",
    "guests_included": _text("1 + k % 4"),
    "extra_people": f"case when k % 2 = 0 then '$0.00' else {_amount('(c % 3000)')} end",
    "minimum_nights": _text("1 + k % 30"),
    "maximum_nights": "case when k % 25 = 0 then '1e3' when k % 26 = 0 then '1e30' "
    f"else {_text('30 + k % 1000')} end",
    "instant_bookable": "case when k % 7 = 0 then 't' else 'f' end",
    "cancellation_policy": "case k % 3 when 0 then 'strict' when 1 then 'moderate' else '' end",
    "has_availability": "case when k % 9 = 0 then 'f' else 'T' end",
    "availability_30": _text("k % 31"),
    "availability_60": _text("k % 61"),
    "availability_90": _text("k % 91"),
    "availability_365": _text("k % 366"),
    "number_of_reviews": f"case when k % 101 = 0 then '-1' else {_text('k % 60')} end",
    "first_review": _date("(k + 3) % 9"),
    "last_review": _date("u % 9"),
    "review_scores_rating": f"case when k % 6 = 0 then '' else {_text('60 + k % 41')} end",
    "review_scores_accuracy": _score("k"),
    "review_scores_cleanliness": _score("(k + 1)"),
    "review_scores_checkin": _score("(k + 2)"),
    "review_scores_communication": _score("(k + 3)"),
    "review_scores_location": _score("(k + 4)"),
    "review_scores_value": _score("(k + 5)"),
    "reviews_per_month": f"case when k % 27 = 0 then 'nan' else {_text('k % 7')} || '.' || {_text('10 + u % 90')} end",
}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} as {name}" for name, expression in columns.items())


def raw_sql(orders: str = "orders") -> str:
    """The view as one SELECT over ``orders``."""
    base = f"select {_select(_BASE)}, o_orderpriority from {orders}"
    with_cents = f"select *, {_CENTS} as cents from ({base}) b"
    return f"select {_select(RAW_EXPRESSIONS)} from ({with_cents}) r"


def raw_listings(spark: SparkSession, sf_dir: str, position: bool = False, parts: int | None = None) -> DataFrame:
    """The view as a DataFrame over one scan of orders, on request with the row order.

    The driver's tables are one row group, hence one task; five columns are dealt out
    before they become sixty, to ``parts`` partitions if given.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    base = orders.repartition(*([parts] if parts else []), "o_orderkey").selectExpr(*(f"{e} as {n}" for n, e in _BASE.items()), "o_orderpriority")
    return base.selectExpr("*", f"{_CENTS} as cents").selectExpr(
        *(f"{e} as {n}" for n, e in RAW_EXPRESSIONS.items()), *(["k as _row"] if position else [])
    )
