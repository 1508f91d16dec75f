"""Stage 3: aggregate reports over the typed listings."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_cents
from ..session import stored
from .metrics import RunMetrics

# Fixed value: neighbourhoods listed.
TOP_NEIGHBOURHOODS = 15

_PRICE, _RATING = "price", "review_scores_rating"


def _rating(zero_as_null: bool) -> Column:
    """Ratings; cleaned data holds 0 for "no rating", which counts unless asked."""
    return F.nullif(F.col(_RATING), F.lit(0)) if zero_as_null else F.col(_RATING)


def _key(name: str, collation: str | None) -> Column:
    return F.col(name) if collation is None else F.collate(F.col(name), collation).alias(name)


def _group_columns(zero_as_null: bool) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("num_listings"),
        F.avg(_PRICE).alias("avg_price"),
        F.avg(_rating(zero_as_null)).alias("avg_rating"),
    ]


def summary(listings: DataFrame, zero_as_null: bool = False) -> DataFrame:
    """Count, price range and averages; always one row."""
    return listings.agg(
        F.count(F.lit(1)).alias("total_listings"),
        F.avg(_PRICE).alias("avg_price"),
        F.min(_PRICE).alias("min_price"),
        F.max(_PRICE).alias("max_price"),
        F.avg(_rating(zero_as_null)).alias("avg_rating"),
    )


def top_neighbourhoods(
    listings: DataFrame,
    limit: int = TOP_NEIGHBOURHOODS,
    collation: str | None = None,
    zero_as_null: bool = False,
) -> DataFrame:
    """Largest neighbourhoods, ties in name order."""
    groups = listings.groupBy(_key("neighbourhood", collation)).agg(*_group_columns(zero_as_null))
    return groups.orderBy(F.desc("num_listings"), "neighbourhood").limit(int(limit))


def price_categories(listings: DataFrame, collation: str | None = None) -> DataFrame:
    groups = listings.groupBy(_key("price_category", collation)).agg(
        F.count(F.lit(1)).alias("num_listings")
    )
    return groups.orderBy(F.desc("num_listings"), "price_category")


def room_type_breakdown(
    listings: DataFrame, collation: str | None = None, zero_as_null: bool = False
) -> DataFrame:
    groups = listings.groupBy(_key("room_type_simplified", collation)).agg(
        *_group_columns(zero_as_null)
    )
    return groups.orderBy(F.desc("num_listings"), "room_type_simplified")


def quality_columns() -> list[Column]:
    """Averages to two places and flag counts over cleaned rows."""
    return [
        round_cents(F.avg(_PRICE).cast("double")).alias("avg_price"),
        round_cents(F.avg(_RATING).cast("double")).alias("avg_review_score"),
        F.count_if(F.col("host_is_superhost") == 1).alias("superhosts_count"),
        F.count_if(F.col("instant_bookable") == 1).alias("instant_bookable_count"),
    ]


def data_quality(cleaned: DataFrame) -> DataFrame:
    """The quality measures of a transform result."""
    return cleaned.agg(*quality_columns())


_SECTIONS = ["neighbourhood", "price_category", "room_type_simplified"]


def _report_groups(listings: DataFrame) -> DataFrame:
    """Every group of all four reports from a single scan of five columns."""
    groups = listings.groupingSets(
        [[], *([c] for c in _SECTIONS)],
        *_SECTIONS,
    ).agg(
        F.grouping_id(*_SECTIONS).alias("_set"),
        *_group_columns(False),
        F.min(_PRICE).alias("min_price"),
        F.max(_PRICE).alias("max_price"),
    )
    return stored(groups, "report")


def _section(groups: DataFrame, name: str | None) -> DataFrame:
    # Bit i of the grouping id is 0 for the columns a row is grouped by.
    bits = len(_SECTIONS)
    mask = (1 << bits) - 1
    if name is not None:
        mask &= ~(1 << (bits - 1 - _SECTIONS.index(name)))
    return groups.where(F.col("_set") == mask)


def _sections(listings: DataFrame, limit: int) -> dict[str, DataFrame]:
    groups = _report_groups(listings)
    # An empty table has no rows to put into grouping sets, but it has a summary.
    total = _section(groups, None).agg(
        F.coalesce(F.max("num_listings"), F.lit(0)).alias("total_listings"),
        *(F.max(c).alias(c) for c in ("avg_price", "min_price", "max_price", "avg_rating")),
    )

    def listed(name: str, *columns: str) -> DataFrame:
        rows = _section(groups, name).select(name, "num_listings", *columns)
        return rows.orderBy(F.desc("num_listings"), name)

    return {
        "summary": total,
        "top_neighbourhoods": listed("neighbourhood", "avg_price", "avg_rating").limit(int(limit)),
        "price_categories": listed("price_category"),
        "room_type_breakdown": listed("room_type_simplified", "avg_price", "avg_rating"),
    }


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and timestamps as ISO text."""

    def column(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind.startswith("decimal"):
            return c.cast("double").alias(name)
        if kind == "date":
            return c.cast("string").alias(name)
        if kind.startswith("timestamp"):
            return F.replace(c.cast("string"), F.lit(" "), F.lit("T")).alias(name)
        return c

    return df.select(*(column(n, k) for n, k in df.dtypes))


def report_rows(listings: DataFrame, limit: int = TOP_NEIGHBOURHOODS) -> DataFrame:
    """The combined report as rows: section, label, counts and averages."""
    frames = []
    for section, df in _sections(listings, limit).items():
        label = F.lit(None).cast("string") if section == "summary" else F.col(df.columns[0])
        count = "total_listings" if section == "summary" else "num_listings"

        def number(name: str, df: DataFrame = df) -> Column:
            value = F.col(name) if name in df.columns else F.lit(None)
            return value.cast("double").alias(name)

        frames.append(
            df.select(
                F.lit(section).alias("section"),
                label.alias("label"),
                F.col(count).alias("num_listings"),
                *(number(n) for n in ("avg_price", "avg_rating", "min_price", "max_price")),
            )
        )
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


def report_json(listings: DataFrame, limit: int = TOP_NEIGHBOURHOODS) -> DataFrame:
    """The combined report as JSON text, one row per entry."""
    frames = [
        json_safe(df).select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("entry"))
        for name, df in _sections(listings, limit).items()
    ]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


def _plain(value: object) -> object:
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return value


def run_report(
    listings: DataFrame, limit: int = TOP_NEIGHBOURHOODS, metrics_path: str | None = None
) -> dict[str, object]:
    """The combined report as one JSON-safe dictionary, with its timings.

    Only finished report entries reach the driver.
    """
    metrics = RunMetrics("report")
    with metrics.timed("aggregate"):
        sections = _sections(listings, limit)
    report: dict[str, object] = {"backend": "spark"}
    for name, df in sections.items():
        with metrics.timed(name):
            entries = [
                {k: _plain(v) for k, v in row.asDict().items()} for row in df.toLocalIterator()
            ]
        report[name] = entries[0] if name == "summary" else entries
    metrics.finish()
    if metrics_path is not None:
        metrics.append(listings.sparkSession, metrics_path)
    report["timings_ms"] = metrics.timings
    json.dumps(report)
    return report
