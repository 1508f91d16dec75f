"""A stored table that is changed by key, file by file.

The log of commits beside the table lists its data files with the range of keys each one
holds. An upsert rewrites the files that hold a changed key and no others: it writes their
merged rows, and the keys that are new, to fresh files, and one record puts these in place
of the old ones. Readers see the table before or after; a failed upsert leaves only files
that no record names. Writers that meet take turns: who finds that the table has changed
since it was read merges again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType, StructType

from ..operators.merge import latest_rows, upsert
from ..session import child_names, remove_path, scratch, stored
from .commits import Entry, commit, items, next_number

# Fixed names of the log.
_FILE, _SCHEMA, _KEY = "file", "schema", "key"
FILE_ROWS = 1_000_000
# Kinds of keys whose text form gives the same key back in every session; other ranges prune nothing.
_EXACT_TEXT = (IntegralType, DecimalType, StringType, DateType)


def _setting(spark: SparkSession, path: str, kind: str, count: int) -> str:
    found = items(spark, path, kind, count).first()
    if found is None:
        raise FileNotFoundError(f"{path} holds no keyed table")
    return found.value


def _read(spark: SparkSession, path: str, names: list[str], schema: StructType) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in names))


def _name_of(path: Column) -> Column:
    """Folder and file of a data file, as the log names it; file systems escape nothing in either."""
    return F.concat(F.lit("data/"), F.substring_index(path, "/", -2))


def _write(rows: DataFrame, path: str, key: str, file_rows: int) -> list[Entry]:
    """Write rows to fresh files in key order; the entries that make the files valid."""
    spark = rows.sparkSession
    folder = f"{path}/data/{uuid.uuid4().hex}"
    try:
        many = max(1, -(-rows.count() // file_rows))
        rows.repartitionByRange(many, key).sortWithinPartitions(key).write.parquet(folder)
        written = spark.read.schema(rows.schema).parquet(folder)
        bounds = written.groupBy(_name_of(F.col("_metadata.file_path")).alias("name")).agg(
            F.to_json(
                F.struct(
                    F.min(key).cast("string").alias("low"),
                    F.max(key).cast("string").alias("high"),
                    F.count(F.lit(1)).alias("rows"),
                )
            ).alias("value")
        )
        return [(_FILE, r.name, r.value) for r in bounds.toLocalIterator()]
    except Exception:
        remove_path(spark, folder)
        raise


def write_keyed(rows: DataFrame, path: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """Make ``rows`` the table at ``path``, in place of what it holds. Each key occurs once; NULLs may repeat."""
    with scratch(rows.sparkSession):
        kept = stored(rows, "keyed")
        entries = _write(kept, path, key, file_rows)
    about: list[Entry] = [(_SCHEMA, _SCHEMA, rows.schema.json()), (_KEY, _KEY, key)]
    commit(rows.sparkSession, path, [(_FILE, None, None), *about, *entries])


def keyed_files(spark: SparkSession, path: str) -> DataFrame:
    """name, low, high (as text) and rows of every file of the table."""
    held = items(spark, path, _FILE)
    value = F.from_json("value", "low string, high string, rows bigint")
    return held.select(F.col("item").alias("name"), value.alias("v")).select("name", "v.*")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    count = next_number(spark, path)
    schema = StructType.fromJson(json.loads(_setting(spark, path, _SCHEMA, count)))
    return _read(spark, path, [r.item for r in items(spark, path, _FILE, count).toLocalIterator()], schema)


def _touched(spark: SparkSession, path: str, count: int, schema: StructType, key: str, changes: DataFrame) -> list[str]:
    """Files that hold a changed key.

    The log says which files overlap the range of the changes; of those the key column alone is
    read and joined with the changed keys.
    """
    kind = schema[key].dataType
    held = items(spark, path, _FILE, count).select("item", F.from_json("value", "low string, high string").alias("v"))
    reach = changes.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if isinstance(kind, _EXACT_TEXT):
        low, high = (F.col(f"v.{side}").cast(kind) for side in ("low", "high"))
        held = held.where((low <= F.lit(reach.high)) & (high >= F.lit(reach.low)))
    names = [r.item for r in held.select("item").toLocalIterator()]
    if not names:
        return []
    keys = _read(spark, path, names, schema).where(F.col(key).between(F.lit(reach.low), F.lit(reach.high)))
    found = keys.select(key, _name_of(F.col("_metadata.file_path")).alias("_file")).join(changes.select(key), key, "left_semi")
    return [r._file for r in found.select("_file").distinct().toLocalIterator()]


def upsert_keyed(changes: DataFrame, path: str, version: Column | str, file_rows: int = FILE_ROWS) -> list[str]:
    """Put the newest change per key into the table; the names of the files it rewrote.

    Rules as of ``upsert``: any version beats NULL, of equal versions the largest row stays, and
    every change without a key is added. ``changes`` may hold further columns, such as the
    version, and are read once. No changes make no commit.
    """
    spark = changes.sparkSession
    with scratch(spark):
        count = next_number(spark, path)
        key = _setting(spark, path, _KEY, count)
        schema = StructType.fromJson(json.loads(_setting(spark, path, _SCHEMA, count)))
        alone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
        latest = latest_rows(changes.withColumn("_alone", alone), [key, "_alone"], version, [*schema.names, "_alone"])
        latest = stored(latest.drop("_alone").select(*(F.col(f.name).cast(f.dataType) for f in schema)), "changes")
        if latest.isEmpty():
            return []
        while True:
            names = _touched(spark, path, count, schema, key, latest)
            merged = stored(upsert(_read(spark, path, names, schema), latest, [key], F.lit(0)), "merged")
            entries = [(_FILE, name, None) for name in names] + _write(merged, path, key, file_rows)
            if commit(spark, path, entries, unless=lambda seen=count: next_number(spark, path) != seen) is not None:
                return names
            _drop(spark, path, entries)
            count = next_number(spark, path)


def _drop(spark: SparkSession, path: str, entries: list[Entry]) -> None:
    """Remove files that were written for a commit that did not happen."""
    for folder in {name.rsplit("/", 1)[0] for _, name, value in entries if value is not None}:
        remove_path(spark, f"{path}/{folder}")


def vacuum_keyed(spark: SparkSession, path: str) -> None:
    """Remove files that the table no longer holds; not while older readers or writers are at work."""
    valid = {r.name for r in keyed_files(spark, path).select("name").toLocalIterator()}
    for folder in child_names(spark, f"{path}/data"):
        names = [n for n in child_names(spark, f"{path}/data/{folder}") if n.endswith(".parquet")]
        for name in names:
            if f"data/{folder}/{name}" not in valid:
                remove_path(spark, f"{path}/data/{folder}/{name}")
        if not any(f"data/{folder}/{name}" in valid for name in names):
            remove_path(spark, f"{path}/data/{folder}")
