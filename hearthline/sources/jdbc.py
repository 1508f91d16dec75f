"""Relational tables over JDBC."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows sent per batch.
BATCH_ROWS = 1000


def jdbc_options(
    url: str,
    table: str,
    *,
    key: str | None = None,
    key_range: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_rows: int = 10_000,
    **extra: str,
) -> dict[str, str]:
    """Options of a parallel read.

    With ``key`` and its range each task reads one slice over its own connection;
    rows outside the range still arrive, in the first and last slice.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_rows), **extra}
    if key is not None and key_range is not None:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(key_range[0]),
            "upperBound": str(key_range[1]),
            "numPartitions": str(partitions),
        }
    return options


def key_slices(keys: DataFrame, key: str, slices: int, accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a table into about equal slices by a numeric key; at most ``slices``.

    Bounds are quantiles from a mergeable sketch of the key column (``keys`` holds it, or a
    sample of it), off by 1/``accuracy`` of the rows at most; only they reach the driver. Every
    row meets exactly one condition, NULL keys the first. A key that repeats in more rows than a
    slice has is not cut. Without keys there is one condition that all rows meet.
    """
    shares = [k / slices for k in range(1, slices)]
    found = keys.agg(F.percentile_approx(key, shares, accuracy).alias("at")).first()["at"] if shares else None
    bounds = sorted(set(found or []))
    if not bounds:
        return ["1 = 1"]
    between = [f"{key} > {low} AND {key} <= {high}" for low, high in pairwise(bounds)]
    return [f"{key} <= {bounds[0]} OR {key} IS NULL", *between, f"{key} > {bounds[-1]}"]


def read_relational(
    spark: SparkSession, url: str, table: str, *, conditions: list[str] | None = None, **options
) -> DataFrame:
    """A database table or ``(query) alias``; filters and columns are pushed down.

    With ``conditions``, as from ``key_slices``, each task reads the rows that meet one.
    """
    wanted = jdbc_options(url, table, **options)
    if conditions is None:
        return spark.read.format("jdbc").options(**wanted).load()
    properties = {k: v for k, v in wanted.items() if k not in ("url", "dbtable")}
    return spark.read.jdbc(url, table, predicates=conditions, properties=properties)


def write_relational(
    df: DataFrame,
    url: str,
    table: str,
    *,
    prune: bool = False,
    connections: int = 16,
    batch_rows: int = BATCH_ROWS,
    **extra: str,
) -> None:
    """Batched inserts, one connection per task.

    ``prune`` empties the table but keeps its definition. ``connections`` bounds
    the load on the database, not the number of rows, and not the work above: rows
    are dealt out anew, so what makes them keeps its own tasks.
    """
    (
        df.repartition(connections)
        .write.format("jdbc")
        .options(url=url, dbtable=table, batchsize=str(batch_rows), truncate="true", **extra)
        .mode("overwrite" if prune else "append")
        .save()
    )
