"""Staging and target tables as Parquet folders.

Every try of a load writes a folder of its own below the target. What the target holds is
said by the log of commits beside it: one record makes a load's folder valid, and with it
whatever else belongs to the load (its staging rows, its rejects, the files it has read). A
load that fails leaves the table as it was, a repeated one replaces its own rows, and
readers see the old table or the new one. Folders no longer valid stay until
``vacuum_target``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import LISTING_COLUMNS, text_schema, typed_schema
from ..session import child_names, remove_path
from .commits import Entry, commit, items, next_number

LOAD_ID = "load_id"


def staging_rows(df: DataFrame) -> DataFrame:
    """The 68 staging columns as text, matched by name; extra columns are ignored."""
    present = set(df.columns)

    def column(name: str) -> Column:
        source = F.col(name).cast("string") if name in present else F.lit(None).cast("string")
        return source.alias(name)

    return df.select(*(column(n) for n in LISTING_COLUMNS))


def write_staging(df: DataFrame, path: str) -> None:
    """Replace the staging table."""
    staging_rows(df).write.mode("overwrite").parquet(path)


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(text_schema(LISTING_COLUMNS)).parquet(path)


def target_loads(spark: SparkSession, path: str) -> dict[str, str]:
    """Folder of every load the target holds, by load id; empty if there is no target."""
    count = next_number(spark, path)
    return {r.item: r.value for r in items(spark, path, "load", count).toLocalIterator()} if count else {}


def write_try(rows: DataFrame, path: str, load_id: str) -> str:
    """Write the rows of one try of a load below ``path``; its folder, not valid yet."""
    folder = f"data/{LOAD_ID}={load_id}/try={uuid.uuid4().hex}"
    try:
        rows.write.parquet(f"{path}/{folder}")
    except Exception:
        remove_path(rows.sparkSession, f"{path}/{folder}")
        raise
    return folder


def append_target(typed: DataFrame, path: str, load_id: str, also: list[Entry] | None = None) -> None:
    """Add one load, with what ``also`` commits; running the same load again replaces its own rows."""
    folder = write_try(typed, path, load_id)
    commit(typed.sparkSession, path, [("load", load_id, folder), *(also or [])])


def replace_target(typed: DataFrame, path: str, load_id: str) -> None:
    """Replace the whole target, in one step after the new rows are all written."""
    folder = write_try(typed, path, load_id)
    commit(typed.sparkSession, path, [("load", None, None), ("load", load_id, folder)])


def read_loads(spark: SparkSession, path: str, schema: str | StructType, with_load: bool = False) -> DataFrame:
    """The rows of all valid loads, in the columns of ``schema``."""
    folders = target_loads(spark, path).values()
    if not folders:
        raise FileNotFoundError(f"{path} holds no committed load")
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    table = reader.parquet(*(f"{path}/{f}" for f in folders))
    names = table.columns[: len(table.columns) - 2]  # the folders' load and try come last
    load = [F.col(LOAD_ID).cast("string").alias(LOAD_ID)] if with_load else []
    return table.select(*(f"`{n}`" for n in names), *load)


def read_target(spark: SparkSession, path: str, with_load: bool = False) -> DataFrame:
    """The 68 typed columns, and with ``with_load`` the load each row came by."""
    return read_loads(spark, path, typed_schema(), with_load)


def read_text_loads(spark: SparkSession, path: str) -> DataFrame:
    """All valid loads of an all-text table; a column that a load's file lacks is NULL there."""
    columns = [r.value for r in items(spark, path, "columns").orderBy("item").toLocalIterator()]
    names = list(dict.fromkeys(name for found in columns for name in json.loads(found)))
    return read_loads(spark, path, text_schema(names))


def read_part(spark: SparkSession, path: str, kind: str, schema: str | StructType) -> DataFrame:
    """What else the loads of the target at ``path`` have committed under ``kind``: "staging" or "rejects"."""
    folders = [r.value for r in items(spark, path, kind).toLocalIterator()] if next_number(spark, path) else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def vacuum_target(spark: SparkSession, path: str) -> None:
    """Remove folders that no commit holds valid; not while older readers or loads are at work."""
    valid = set(target_loads(spark, path).values())
    for load in child_names(spark, f"{path}/data"):
        for attempt in child_names(spark, f"{path}/data/{load}"):
            if f"data/{load}/{attempt}" not in valid:
                remove_path(spark, f"{path}/data/{load}/{attempt}")
