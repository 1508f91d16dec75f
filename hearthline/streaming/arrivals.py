"""File-arrival streams.

The stream carries the identities of new files: path, length and time of change. Each
micro-batch reads its files with the batch reader, so a large file is read by many tasks.

Loads are exactly once by file. The target's log of commits holds the identity of every file
it has taken in; one record makes typed rows, staging rows, rejects and identities valid
together. A batch that is run again, for whatever reason and after whatever step, leaves out
the files the log holds. Transforms write one output folder per file, named after it, so a
file that is taken again replaces its own output.

A batch that fails is taken in halves, and a half that fails in its halves: a bad file costs
a few runs, however many good ones came with it. The files that fail alone are kept aside with
their errors, and the stream goes on. Every run leaves a record with its
counts; if the record cannot be written the stream fails, and its files stay loaded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import clean_listings
from ..operators.gates import VARIANTS, accounting_columns, judge_rows
from ..operators.typing import bad_rows, typed_listings
from ..plans.metrics import RunMetrics
from ..plans.reports import quality_columns
from ..schema import LISTING_COLUMNS, text_schema
from ..sources.commits import commit, items
from ..sources.csv import listing_text, read_raw_listings, write_text_csv
from ..sources.csv_records import FILE
from ..sources.tables import LOAD_ID, staging_rows, write_try

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass(frozen=True)
class Arrived:
    """A file that has arrived; its identity changes when it is written again."""

    path: str
    identity: str


def _on_arrival(
    spark: SparkSession,
    folder: str,
    checkpoint: str,
    handle: Callable[[list[Arrived], str, RunMetrics], None],
    operation: str,
    failed_path: str | None,
    metrics_path: str | None,
    max_files: int,
    once: bool,
) -> StreamingQuery:
    """Call ``handle`` with the files and the name of every batch of new files.

    Without ``failed_path`` a file that fails ends the stream.
    """

    def run(files: list[Arrived], name: str) -> Exception | None:
        metrics = RunMetrics(operation)
        metrics.set(batch=name, files=len(files))
        failure = None
        try:
            handle(files, name, metrics)
        except Exception as error:
            failure = error
            metrics.fail(error)
        metrics.finish()
        if metrics_path is not None:
            metrics.append(spark, metrics_path)
        return failure

    files = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
    files = files.option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.csv{,.gz}")
    names = files.load(folder).select("path", "length", F.unix_micros("modificationTime").alias("changed"))

    def batch(arrived: DataFrame, number: int) -> None:
        rows = sorted(arrived.collect())  # max_files identities at most
        found = [Arrived(r.path, f"{r.path}|{r.length}|{r.changed}") for r in rows]
        if not found:
            return
        failure = run(found, f"batch-{number}")
        if failure is None:
            return
        if failed_path is None:
            raise failure
        failed = []
        waiting = [(0, len(found))]
        while waiting:
            a, b = waiting.pop()
            # The batch as a whole has failed already; a batch of one file is tried again.
            if b - a == 1:
                failure = run(found[a:b], f"batch-{number}-file-{a}")
                if failure is not None:
                    failed.append((found[a].path, str(failure)))
            elif b - a == len(found) or run(found[a:b], f"batch-{number}-files-{a}-{b}") is not None:
                waiting += [((a + b) // 2, b), (a, (a + b) // 2)]
        if failed:
            aside = spark.createDataFrame(failed, "path string, error string")
            aside.write.mode("overwrite").parquet(f"{failed_path}/{LOAD_ID}=batch-{number}")

    writer = names.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return writer.trigger(availableNow=True).start() if once else writer.start()


def _not_held(spark: SparkSession, target_path: str, files: list[Arrived]) -> list[Arrived]:
    """The files that the target's log does not hold yet."""
    own = spark.createDataFrame([(f.identity,) for f in files], "item string")
    new = {r.item for r in own.join(items(spark, target_path, "file"), "item", "left_anti").collect()}
    return [f for f in files if f.identity in new]


def load_arrivals(
    spark: SparkSession,
    folder: str,
    *,
    staging_path: str,
    target_path: str,
    reject_path: str,
    checkpoint: str,
    failed_path: str | None = None,
    metrics_path: str | None = None,
    lenient_int: bool = False,
    multiline: bool = True,
    max_files: int = 1000,
    once: bool = True,
) -> StreamingQuery:
    """Stage, type and append every new cleaned file, once; keep the bad rows aside.

    A batch is parsed once, into its staging folder; the typed rows and the rejects are read
    from there. ``read_part`` of the target gives the valid ones of either; folders of failed
    tries are not among them. Run records count staged, inserted and bad rows, and the files
    that were held already. A replaced target still holds the identities of earlier files.
    """

    def load(files: list[Arrived], name: str, metrics: RunMetrics) -> None:
        new = _not_held(spark, target_path, files)
        metrics.set(files_held=len(files) - len(new))
        if not new:
            return
        one_try = uuid4().hex
        staged, rejected = (f"{p}/{LOAD_ID}={name}/try={one_try}" for p in (staging_path, reject_path))
        paths = [f.path for f in new]
        staging = staging_rows(read_raw_listings(spark, paths, multiline=multiline))
        staging.write.parquet(staged)
        rows = spark.read.schema(text_schema(staging.columns)).parquet(staged)
        inserted, bad = Observation(f"inserted-{name}"), Observation(f"bad-{name}")
        count = F.count(F.lit(1))
        bad_rows(rows, limit=None).observe(bad, count.alias("bad_rows")).write.parquet(rejected)
        typed = typed_listings(rows, lenient_int).observe(inserted, count.alias("inserted"))
        load_id = f"{name}-{md5(new[0].identity.encode()).hexdigest()}"
        typed_folder = write_try(typed, target_path, load_id)
        metrics.set(staging_count=rows.count(), **inserted.get, **bad.get)
        entries = [("load", load_id, typed_folder), ("staging", load_id, staged), ("rejects", load_id, rejected)]
        entries += [("file", f.identity, load_id) for f in new]
        # Another stream may have taken some of the files since: the batch is tried again without.
        if commit(spark, target_path, entries, lambda: len(_not_held(spark, target_path, new)) < len(new)) is None:
            load(files, name, metrics)

    return _on_arrival(
        spark, folder, checkpoint, load, "arriving_load", failed_path, metrics_path, max_files, once
    )


def transform_arrivals(
    spark: SparkSession,
    folder: str,
    *,
    output_path: str,
    checkpoint: str,
    variant: str = "scale",
    failed_path: str | None = None,
    metrics_path: str | None = None,
    multiline: bool = True,
    max_files: int = 1000,
    once: bool = True,
    compression: str = "none",
) -> StreamingQuery:
    """Clean every new raw file into a CSV folder of its own, ``output=<name>``.

    Names are those of ``arrival_output``. The rows of a batch are dealt to their files'
    folders in one write, which replaces the folders it writes to and no others: a batch that
    is taken again changes nothing. A file of which no row survives leaves no folder. Run
    records hold the row accounting and the quality measures of what was written. The
    numbered variant is refused: numbers run over a whole table, not over batches.
    """
    chosen = VARIANTS[variant]
    if chosen.numbered:
        raise ValueError(f"variant {variant} numbers a whole table; use run_transform")

    def transform(files: list[Arrived], name: str, metrics: RunMetrics) -> None:
        paths = [f.path for f in files]
        raw = read_raw_listings(spark, paths, multiline=multiline, position=True)
        counts, quality = Observation(f"accounting-{name}"), Observation(f"quality-{name}")
        judged = judge_rows(raw, chosen).observe(counts, *accounting_columns())
        cleaned = clean_listings(judged, chosen).observe(quality, *quality_columns())
        text = listing_text(cleaned.select(*LISTING_COLUMNS, arrival_output(FILE).alias("output")))
        write_text_csv(text, output_path, "overwrite", by="output", compression=compression)
        metrics.set(variant=variant, **counts.get, **quality.get)

    return _on_arrival(
        spark, folder, checkpoint, transform, "arriving_transform", failed_path, metrics_path, max_files, once
    )


def arrival_output(path: Column | str) -> Column:
    """The name of a file's output: its own, and a part of its path's hash, as names may repeat in other folders."""
    c = F.col(path) if isinstance(path, str) else path
    c = F.regexp_replace(F.coalesce(F.try_url_decode(c), c), "^([A-Za-z0-9]+):/+", "$1:/")  # sources spell it in two ways
    base = F.regexp_replace(F.element_at(F.split(c, "/"), -1), "\\.csv(\\.gz)?$", "")
    return F.concat(F.lit("clean_"), base, F.lit("_"), F.substring(F.md5(c), 1, 8), F.lit(".csv"))
