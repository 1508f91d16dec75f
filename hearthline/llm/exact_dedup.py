"""Exact duplicates: grouped by a 128-bit content hash, told apart by their bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HASH, _BYTES, _SHA = "__hash", "__bytes", "__sha"


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per distinct text, that of the smallest id, with all columns of ``docs``.

    The hash deals the rows out; the aggregate compares the texts themselves, so rows
    whose hashes collide stay apart. Copies meet in the map-side aggregate first: of a
    group of any size each task sends one row on, and nothing is joined or collected.

    NULL counts as the empty text. A NULL id is kept only if the group has no other.
    Rows that repeat id and text are one document. Of rows that differ in other columns
    only, the smallest in column order stays. An empty table gives an empty one.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = F.struct(
        F.col(id_col).isNull().alias("no_id"),
        F.col(id_col).alias("id"),
        F.col(text_col).isNull().alias("no_text"),
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)),
    )
    kept = docs.groupBy(hashed(text).alias(_HASH), text.alias(_BYTES)).agg(F.min(first).alias("row"))
    back = {
        id_col: F.col("row.id"),
        text_col: F.when(~F.col("row.no_text"), F.col(_BYTES)),
        **{c: F.col(f"row.c{i}") for i, c in enumerate(others)},
    }
    return kept.select(*(back[c].alias(c) for c in docs.columns))


def duplicate_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Every document with its group: id, keep_id, group_size, kept, text_sha256.

    ``keep`` names the id that stays, the smallest or the largest of the group.

    The aggregate groups by hash and text, that is, compares bytes inside a hash group,
    and carries each text once per task at most. Documents then find their group by
    hash and digest; only ids and digests move, and a hot group is split by Spark's
    skew join, because the documents' side is merely streamed.

    NULL counts as empty. Rows that repeat id and text count as copies and get the same
    verdict. A group without any id has a NULL ``keep_id`` and its rows are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    best = F.max if keep == "max" else F.min
    groups = (
        docs.groupBy(hashed(text).alias(_HASH), text.alias(_BYTES))
        .agg(best(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(_HASH, F.unhex(F.sha2(_BYTES, 256)).alias(_SHA), "keep_id", "group_size")
    )
    own = docs.select(
        F.col(id_col), hashed(text).alias(_HASH), F.unhex(F.sha2(text, 256)).alias(_SHA)
    )
    return own.join(groups, [_HASH, _SHA], "left").select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(_SHA)).alias("text_sha256"),
    )
