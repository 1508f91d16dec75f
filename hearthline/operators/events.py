"""Load events (JSON text) to a manifest of files to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields an event may carry, at top level or inside ``detail``.
_BODY = (
    "s3Bucket STRING, s3Key STRING, bucket STRUCT<name: STRING>, object STRUCT<key: STRING>, "
    "target STRING, action STRING, pruneTargetTable STRING, pruneTable STRING"
)
_EVENT = f"{_BODY}, detail STRUCT<{_BODY}>"
EMBEDDED_TARGET = "sqlite"


def _is_true(c: Column, default: bool) -> Column:
    """Only the word "true" is true; an absent flag has its default."""
    return F.coalesce(F.lower(c) == "true", F.lit(default))


def _read_events(events: DataFrame, column: str, default_bucket: str | None) -> DataFrame:
    # A generator, so that the filters below stay above the parser and each event is
    # parsed once, not once per field.
    parsed = events.withColumn("_event", F.explode(F.array(F.from_json(column, _EVENT))))
    body = F.when(F.col("_event.detail").isNotNull(), F.col("_event.detail")).otherwise(
        F.struct(*(F.col(f"_event.{name}") for name in _body_names()))
    )
    e = parsed.withColumn("_body", body)
    key = F.coalesce(F.col("_body.s3Key"), F.col("_body.object.key"))
    to_embedded = F.coalesce(F.lower("_body.target") == EMBEDDED_TARGET, F.lit(False)) | F.coalesce(
        F.lower("_body.action") == EMBEDDED_TARGET, F.lit(False)
    )
    return e.select(
        *events.columns,
        F.coalesce(
            F.col("_body.s3Bucket"), F.col("_body.bucket.name"), F.lit(default_bucket)
        ).alias("bucket"),
        F.coalesce(F.try_url_decode(key), key).alias("object_key"),
        F.when(to_embedded, "text_table").otherwise("typed_table").alias("destination"),
        _is_true(F.col("_body.pruneTargetTable"), True).alias("prune_target"),
        _is_true(F.col("_body.pruneTable"), False).alias("prune_text_table"),
    )


def _body_names() -> list[str]:
    return [
        "s3Bucket",
        "s3Key",
        "bucket",
        "object",
        "target",
        "action",
        "pruneTargetTable",
        "pruneTable",
    ]


def load_manifest(
    events: DataFrame, column: str = "event", default_bucket: str | None = None
) -> DataFrame:
    """Bucket, decoded key, destination and prune flags of every usable event."""
    read = _read_events(events, column, default_bucket)
    return read.where(F.col("bucket").isNotNull() & F.col("object_key").isNotNull())


def rejected_events(
    events: DataFrame, column: str = "event", default_bucket: str | None = None
) -> DataFrame:
    """Events that name no bucket or no key."""
    read = _read_events(events, column, default_bucket)
    lacking = F.col("bucket").isNull() | F.col("object_key").isNull()
    return read.where(lacking).select(*events.columns)
