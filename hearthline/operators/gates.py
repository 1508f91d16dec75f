"""Row gates: which raw rows are kept, dropped or counted as errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clean_price
from ..functions.text import strip
from ..schema import CLEANED_FIELDS, STRIPPED_COLUMNS

PRICE = "_price"
OUTCOME = "_outcome"
CLEAN, REMOVED, ERROR = "clean", "removed", "error"

# Fixed value: highest price kept.
MAX_PRICE = 10000


@dataclass(frozen=True)
class Variant:
    """The places where the three transforms differ."""

    name: str
    blank_gate: bool  # look at blank id and name before the price
    apt_is_entire: bool  # "apt" counts as an entire home
    accommodates_default: str  # when the column is absent
    numbered: bool  # sort by id and number the rows


# Fixed values.
VARIANTS = {
    "base": Variant("base", True, True, "0", False),
    "scale": Variant("scale", False, False, "1", False),
    "arch": Variant("arch", True, True, "0", True),
}

_DEFAULTS = {f.name: f.default for f in CLEANED_FIELDS}


def raw_column(df: DataFrame, name: str, default: str | None = None) -> Column:
    """A raw column, or its default text when the input has no such column."""
    if name in df.columns:
        return F.col(name)
    return F.lit(_DEFAULTS[name] if default is None else default)


def judge_rows(df: DataFrame, variant: Variant) -> DataFrame:
    """Add the cleaned price and the outcome of the gates.

    A NULL in a column that has to be stripped is a field the record lacks: such a
    row is an error, unless an earlier gate has dropped it.
    """
    price = clean_price(raw_column(df, "price", "0"))
    id_, name = raw_column(df, "id"), raw_column(df, "name")
    lacks = F.lit(False)
    for c in STRIPPED_COLUMNS:
        if c in df.columns:
            lacks = lacks | F.col(c).isNull()
    blank_id = strip(id_) == ""
    # Prices are whole cents, so 0 < price <= MAX_PRICE. SQL's BETWEEN, unlike two column
    # comparisons, computes the price once where the gate is evaluated above its text.
    bad_price = F.expr(f"not coalesce({PRICE} between 0.01 and {MAX_PRICE}, false)")
    if variant.blank_gate:
        outcome = (
            F.when(id_.isNull() | (blank_id & name.isNull()), ERROR)
            .when(bad_price | blank_id, REMOVED)
            .when(lacks, ERROR)
        )
    else:
        outcome = F.when(bad_price, REMOVED).when(id_.isNull(), ERROR)
        outcome = outcome.when(blank_id, REMOVED).when(lacks, ERROR)
    return df.withColumn(PRICE, price).withColumn(OUTCOME, outcome.otherwise(CLEAN))


def accounting_columns() -> list[Column]:
    """Aggregates over judged rows: raw, clean, removed and error counts."""
    total = F.count(F.lit(1))
    clean = F.count_if(F.col(OUTCOME) == CLEAN)
    return [
        total.alias("raw_count"),
        clean.alias("clean_count"),
        (total - clean).alias("removed_count"),
        F.count_if(F.col(OUTCOME) == ERROR).alias("error_count"),
    ]


def row_accounting(df: DataFrame, variant: str = "scale") -> DataFrame:
    """One row of counts; ``removed_count`` includes the errors."""
    return judge_rows(df, VARIANTS[variant]).agg(*accounting_columns())
