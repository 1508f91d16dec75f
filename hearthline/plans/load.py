"""Stage 2: text rows to a staging table, and from there to the typed target."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.events import load_manifest, rejected_events
from ..operators.merge import only_new_rows
from ..operators.typing import BAD_ROWS_SHOWN, bad_rows, typed_listings
from ..session import scratch
from ..sources.commits import Entry, commit
from ..sources.csv import listing_text, read_raw_listings, read_text_table
from ..sources.tables import (
    LOAD_ID,
    append_target,
    read_staging,
    read_target,
    replace_target,
    target_loads,
    write_staging,
    write_try,
)
from .metrics import RunMetrics


@dataclass(frozen=True)
class LoadResult:
    metrics: RunMetrics
    staging: DataFrame
    bad_rows: DataFrame


def load_listings(
    spark: SparkSession,
    source: str | DataFrame,
    staging_path: str,
    target_path: str,
    *,
    prune: bool = True,
    new_only: bool = False,
    lenient_int: bool = False,
    load_id: str | None = None,
    multiline: bool = True,
    metrics_path: str | None = None,
) -> LoadResult:
    """Stage ``source`` as text, insert the typed rows, report rows that do not convert.

    ``source`` is a CSV path or a DataFrame of cleaned listings. ``prune`` replaces
    the target, else the rows are appended; ``new_only`` leaves out ids it already
    holds. The target changes in one step at the end or not at all, and the run is
    recorded either way. Counts are read from what was committed.
    """
    load_id = load_id or f"load-{uuid4().hex}"
    metrics = RunMetrics("bulk_load")
    metrics.set(table=target_path, load_id=load_id)
    try:
        with metrics.timed("load"):
            if isinstance(source, str):
                rows = read_raw_listings(spark, source, multiline=multiline)
            else:
                rows = listing_text(source)
            write_staging(rows, staging_path)
        staging = read_staging(spark, staging_path)
        with metrics.timed("count"):
            metrics.set(staging_count=staging.count())
        with metrics.timed("insert"), scratch(spark):
            typed = typed_listings(staging, lenient_int)
            if new_only and not prune and target_loads(spark, target_path):
                held = read_target(spark, target_path, with_load=True)
                # Rows of an earlier try of this load are about to be replaced.
                held = held.where(F.col(LOAD_ID) != load_id)
                typed = only_new_rows(typed, held, ["id"])
            write = replace_target if prune else append_target
            write(typed, target_path, load_id)
        written = read_target(spark, target_path, with_load=True).where(F.col(LOAD_ID) == load_id)
        metrics.set(inserted=written.count())
        with metrics.timed("badrows"):
            report = bad_rows(staging).collect()  # at most BAD_ROWS_SHOWN rows
        metrics.set(bad_rows_shown=len(report))
    except Exception as error:
        metrics.fail(error)
        raise
    finally:
        metrics.finish()
        if metrics_path is not None:
            metrics.append(spark, metrics_path)
    shown = spark.createDataFrame(report, "id string, host_id string, price string")
    return LoadResult(metrics, staging, shown)


def load_text_table(
    spark: SparkSession,
    source: str,
    target_path: str,
    *,
    prune: bool = False,
    load_id: str | None = None,
    metrics_path: str | None = None,
) -> RunMetrics:
    """Any CSV file into an all-text table named after its header; ``read_text_loads`` reads it.

    A load is named after its source unless ``load_id`` says otherwise: loading it again
    replaces its rows. ``prune`` replaces the whole table. Rows are counted as they are
    written; the run is recorded whether it succeeds or not.
    """
    load_id = load_id or f"text-{md5(source.encode()).hexdigest()}"
    metrics = RunMetrics("text_load")
    metrics.set(source_file=source, table=target_path, load_id=load_id)
    try:
        with metrics.timed("parse_insert"):
            written = Observation("text_load")
            rows = read_text_table(spark, source).observe(written, F.count(F.lit(1)).alias("rows_loaded"))
            folder = write_try(rows, target_path, load_id)
            clear: list[Entry] = [("load", None, None), ("columns", None, None)] if prune else []
            own: list[Entry] = [("load", load_id, folder), ("columns", load_id, json.dumps(rows.columns))]
            commit(spark, target_path, clear + own)
            metrics.set(**written.get)
    except Exception as error:
        metrics.fail(error)
        raise
    finally:
        metrics.finish()
        if metrics_path is not None:
            metrics.append(spark, metrics_path)
    return metrics


def load_from_events(
    spark: SparkSession,
    events: DataFrame,
    locate: Callable[[str, str], str],
    *,
    staging_path: str,
    target_path: str,
    text_path: str,
    default_bucket: str | None = None,
    metrics_path: str | None = None,
    reject_path: str | None = None,
) -> list[RunMetrics]:
    """One load per load event, in order of arrival, as the event asks for it.

    ``locate`` turns bucket and key into a path. The driver only steps through the
    manifest; every load is a job of its own, named after its event, so that a repeated
    run replaces the rows of the first. Events that name no file go to ``reject_path``.
    """
    if reject_path is not None:
        rejected_events(events, default_bucket=default_bucket).write.mode("overwrite").parquet(reject_path)
    runs = []
    manifest = load_manifest(events, default_bucket=default_bucket)
    named = manifest.withColumn("load_id", F.md5(F.to_json(F.struct(*events.columns))))
    for event in named.toLocalIterator():
        path = locate(event.bucket, event.object_key)
        if event.destination == "text_table":
            runs.append(
                load_text_table(
                    spark, path, text_path, prune=event.prune_text_table,
                    load_id=f"event-{event.load_id}", metrics_path=metrics_path,
                )
            )
            continue
        result = load_listings(
            spark,
            path,
            staging_path,
            target_path,
            prune=event.prune_target,
            load_id=f"event-{event.load_id}",
            metrics_path=metrics_path,
        )
        runs.append(result.metrics)
    return runs


__all__ = ["BAD_ROWS_SHOWN", "LoadResult", "load_from_events", "load_listings", "load_text_table"]
