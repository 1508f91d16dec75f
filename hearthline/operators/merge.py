"""Keyed merges of a batch into a table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored


def only_new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key the target does not hold yet; rows that lack a key are new.

    Only keys are joined with the target. New keys are written, so their size is known before
    whole rows are moved: of few, the rows are picked out where they are.
    """
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    new = batch.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")
    new = stored(new.select(*(F.col(k).alias(n) for k, n in names.items())), "new-keys")
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return batch.join(new, same, "left_semi")


def latest_rows(
    changes: DataFrame, keys: list[str], version: Column | str, columns: list[str] | None = None
) -> DataFrame:
    """One row per key, the one with the highest version; any version beats NULL.

    Of equal versions the row whose columns are largest, in column order, stays, so that
    reruns agree. An aggregate, not a window: a hot key shrinks to one row per task
    before the shuffle.
    """
    kept = columns or changes.columns
    own = F.struct(*(c for c in kept if c not in keys))
    at = F.col(version) if isinstance(version, str) else version
    newest = F.max(F.struct(at.isNotNull().alias("known"), at.alias("version"), own.alias("row")))
    latest = changes.groupBy(*keys).agg(newest.alias("_newest"))
    return latest.select(*keys, "_newest.row.*").select(*kept)


def upsert(
    target: DataFrame, changes: DataFrame, keys: list[str], version: Column | str
) -> DataFrame:
    """The target with the newest change per key put in place of the old row, or added.

    The target holds each key once. A change that lacks a key equals no other row, so
    every one of them is added. Changes and target are read once each: a row number sets
    keyless changes apart in the aggregate, and no key of theirs meets the target's.
    """
    has_key = reduce(and_, (F.col(k).isNotNull() for k in keys))
    alone = F.when(~has_key, F.monotonically_increasing_id())
    latest = latest_rows(
        changes.withColumn("_alone", alone), [*keys, "_alone"], version, ["_alone", *target.columns]
    )
    renamed = {c: f"_new_{i}" for i, c in enumerate(target.columns)}
    latest = latest.select(*(F.col(c).alias(n) for c, n in renamed.items()), F.lit(True).alias("_changed"))
    same = reduce(and_, (F.col(k) == F.col(renamed[k]) for k in keys))
    met = target.join(latest, same, "full_outer")
    return met.select(
        *(F.when(F.col("_changed"), F.col(n)).otherwise(F.col(c)).alias(c) for c, n in renamed.items())
    )
