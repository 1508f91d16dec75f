"""CSV files in and out.

Readers return all-text columns in which an empty field is ``''`` and only a field
that a short record lacks is NULL. Inside quotes a file's own line end reads as LF.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import float_text
from ..schema import LISTING_COLUMNS, SEQUENCE_COLUMN
from .csv_records import BLOCK, FIELDS, FILE, HEADER, ROW, csv_records, packed_columns

POSITION = [FILE, BLOCK, ROW]
# Fixed value: rows of a compressed file at most, as one task reads it whole.
FILE_ROWS = 100_000
Paths = str | list[str]


def header_names(spark: SparkSession, path: Paths) -> list[str]:
    """Column names from the first record; the only data that reaches the driver."""
    reader = spark.read.option("multiLine", True).option("escape", '"')
    first = reader.option("header", False).csv(path).head()
    if first is None:
        raise ValueError(f"{path} has no header row")
    return ["" if name is None else name for name in first]


def sanitized_names(names: list[str]) -> list[str]:
    """Names safe as SQL identifiers; clashes are an error, not a silent rename."""
    blanks = "".join(map(chr, range(33)))
    clean = [re.sub("[^A-Za-z0-9_]", "_", n.strip(blanks)) or "col" for n in names]
    clashes = sorted({n for n in clean if [m.lower() for m in clean].count(n.lower()) > 1})
    if clashes:
        raise ValueError(f"column names clash after sanitising: {', '.join(clashes)}")
    return clean


def _parsed(
    spark: SparkSession,
    path: Paths,
    names: list[str],
    multiline: bool,
    drop_bad_bytes: bool,
    position: bool,
) -> DataFrame:
    """Fields by place; a field that a short record lacks is NULL, further ones are left out."""
    place = POSITION if position else []
    packed, path = packed_columns(spark, path, names, drop_bad_bytes, position) if multiline else (None, path)
    if packed is not None:
        packed = packed.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)), *place)
        if not path:
            return packed

    header = F.transform(FIELDS, lambda f: F.lower(F.replace(f, F.lit("\ufeff"), F.lit(""))))
    expected = F.array(*(F.lit(n.lower()) for n in names))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col(FILE))).cast("boolean")
    is_row = F.when(F.col(HEADER), F.when(header == expected, False).otherwise(other)).otherwise(True)
    rows = csv_records(spark, path, multiline, drop_bad_bytes).where(is_row)
    rows = rows.select(*(F.get(FIELDS, F.lit(i)).alias(n) for i, n in enumerate(names)), *place)
    return rows if packed is None else packed.union(rows)


def read_raw_listings(
    spark: SparkSession,
    path: Paths = "listings.csv",
    *,
    multiline: bool = True,
    position: bool = False,
) -> DataFrame:
    """Raw listings by header name.

    ``multiline`` allows line breaks inside quotes; records are put together across
    splits. Without it every line is a record.
    ``position`` adds the file order (``POSITION``) that sequence numbers tie-break on.
    """
    return _parsed(spark, path, header_names(spark, path), multiline, True, position)


def read_text_table(spark: SparkSession, path: Paths, *, multiline: bool = True) -> DataFrame:
    """Any CSV file as text columns with sanitised header names."""
    names = header_names(spark, path)
    target = sanitized_names(names)
    return _parsed(spark, path, names, multiline, False, False).toDF(*target)


def listing_text(df: DataFrame) -> DataFrame:
    """All columns as the text the CSV files carry. NULL stays, and is written as empty."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(
        *((float_text(n) if n in doubles else F.col(n).cast("string")).alias(n) for n in df.columns)
    )


def write_text_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", by: str | None = None, compression: str = "none"
) -> None:
    """Text columns as a CSV folder: doubled quotes, empty fields bare, blanks kept.

    ``by`` names a column whose values get folders of their own; overwriting then replaces
    the folders that get rows, and no others. With ``compression`` (``gzip``) the files hold
    ``FILE_ROWS`` rows at most, packed fast rather than small; the readers take them as they are.
    """
    writer = df.write.mode(mode).option("compression", compression)
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", FILE_ROWS).option("zlib.compress.level", "BEST_SPEED")
    if by is not None:
        writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic")
    (
        writer
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_listings_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """Listings as CSV in the fixed column order, sequence number first if present."""
    order = [c for c in [SEQUENCE_COLUMN, *LISTING_COLUMNS] if c in df.columns]
    write_text_csv(listing_text(df.select(*order)), path, compression=compression)


# The patterns of output names.
def output_name(variant: str, now: datetime, source: str = "", architecture: str = "") -> str:
    """Timestamped name of a transform result."""
    stamp = now.strftime("%Y%m%d_%H%M%S")
    if variant == "scale":
        return f"clean_{source.replace('.csv', '')}_{stamp}.csv"
    if variant == "arch":
        return f"clean_listings_{architecture}_{stamp}.csv"
    return f"clean_listings_{stamp}.csv"
