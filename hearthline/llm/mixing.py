"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MAX_EPOCHS = 2
# A source's weight over training time, as (time, relative weight) corners joined by
# lines. The n-th source takes the n-th schedule, again from the start after the last.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.75, 1.0), (1.0, 2.0)),
)
# Digits of the order key that split a source; a source of 10^10 rows gives parts of 10^6.
SPLIT_DIGITS = 3
_TAKEN = {
    "size", "source_size", "target", "before", "copies", "epoch", "position", "positions", "__order", "__part", "__in_part",
    "__source", "__its_part", "__offset", "__of", "__turn", "__epochs",
}


def n_words(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source_col: str = "source") -> DataFrame:
    """Target of each source, from one row per source with its ``source_size``.

    Sources in code point order, NULL last, weigh ``WEIGHTS`` in turn. A target is
    ``min(cap, level * weight)``: the level that uses up the whole demand is what is
    left when capped sources' excess is reshared by weight until none is above.
    Sorted by cap / weight the capped sources come first, so running sums find it: it is
    the level at the first source that stays within its cap; after it levels only fall.
    """
    every = Window.orderBy(F.col(source_col).isNull(), source_col)
    turn = F.row_number().over(every) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    caps = sizes.select(
        source_col,
        "source_size",
        turn.alias("turn"),
        weight.alias("weight"),
        (F.col("source_size") * MAX_EPOCHS).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    demand = F.sum("source_size").over(whole) * SHARE_PERCENT / F.lit(100.0)
    level = (demand - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = caps.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    common = F.max(fits).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    return levels.select(source_col, "source_size", "turn", target.alias("target"))


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``docs`` with size, source_size, target, copies, and the tokens before them in their source.

    A source's documents follow each other in the order of their ids' MD5, a shuffle that
    reruns repeat. Whole epochs are taken as often as the target holds them; of the last
    one, the documents whose middle lies before the target's end, so that a source comes
    within one document of its target.

    Running sums are taken in two levels: parts of a source by the first digits of the
    order key, and within a part. A hot source is thereby spread over 16^3 parts; only
    part totals and sources are put in one order.

    NULL texts and texts without words have size 0 and are never taken. A NULL source is
    a source. Rows that repeat an id are taken one by one, in the order of size. Columns
    of ``docs`` named like a result or helper column give way to it.
    """
    own = [c for c in docs.columns if c in (id_col, text_col, source_col) or c.lower() not in _TAKEN]
    keyed = (
        docs.select(*own).withColumn("size", n_words(F.col(text_col)))
        .withColumn("__order", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
        .withColumn("__part", F.substring("__order", 1, SPLIT_DIGITS))
    )
    parts = keyed.groupBy(source_col, "__part").agg(F.sum("size").alias("__in_part"))
    targets = source_targets(
        parts.groupBy(source_col).agg(F.sum("__in_part").alias("source_size")), source_col
    )
    earlier = Window.partitionBy(source_col).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col(source_col).alias("__source"),
        F.col("__part").alias("__its_part"),
        F.coalesce(F.sum("__in_part").over(earlier), F.lit(0)).alias("__offset"),
    )
    known = targets.select(
        F.col(source_col).alias("__of"), "source_size", "target", F.col("turn").alias("__turn")
    )
    offsets = offsets.join(known, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    placed = keyed.join(
        offsets,
        F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__part") == F.col("__its_part")),
    )
    inside = (
        Window.partitionBy("__source", "__its_part")
        .orderBy("__order", F.col(id_col), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("__epochs") * F.col("source_size")
    more = (F.col("__epochs") < MAX_EPOCHS) & (F.col("before") * 2 + F.col("size") <= rest * 2)
    return (
        placed.withColumn("before", before)
        .withColumn("__epochs", epochs.cast("long"))
        .withColumn("copies", F.col("__epochs") + more.cast("long"))
        .drop("__order", "__part", "__source", "__its_part", "__offset", "__epochs")
    )


def _time_of(share: Column, corners: tuple[tuple[float, float], ...]) -> Column:
    """When a schedule has used up ``share`` of its whole weight: the inverse of its integral."""
    areas = [(b - a) * (u + v) / 2 for (a, u), (b, v) in zip(corners, corners[1:])]
    wanted = share * sum(areas)
    time, done = F.lit(corners[-1][0]), sum(areas)
    for (a, u), (b, v), area in list(zip(corners, corners[1:], areas))[::-1]:
        done -= area
        slope, left = (v - u) / (b - a), wanted - done
        # The line's integral u*x + slope*x*x/2 = left, in the form that bears a slope of 0.
        x = left * 2 / (u + F.sqrt(F.greatest(left * (2 * slope) + u * u, F.lit(0.0))))
        time = F.when(wanted <= done + area, a + x).otherwise(time)
    return time


def position_of(epoch: Column) -> Column:
    """Training time (0 to 1) of a copy: when its source's integrated weight demands its middle."""
    middle = epoch * F.col("source_size") + F.col("before") + F.col("size") / 2.0
    share = F.when(F.col("target") > 0, F.least(middle / F.col("target"), F.lit(1.0))).otherwise(0.0)
    choice = F.lit(None).cast("double")
    for k, corners in enumerate(SCHEDULES):
        choice = F.when(F.col("__turn") % len(SCHEDULES) == k, _time_of(share, corners)).otherwise(choice)
    return choice


def schedule(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``mix_plan`` with ``positions``: the training time of each copy, first epoch first; empty if not taken."""
    plan = mix_plan(docs, id_col, text_col, source_col)
    times = F.array(*(position_of(F.lit(epoch)) for epoch in range(MAX_EPOCHS)))
    return plan.withColumn("positions", F.slice(times, F.lit(1), F.col("copies").cast("int"))).drop("__turn")


def in_order(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of a ``schedule``, range-sorted by its first position; those not taken come last."""
    first = F.get("positions", F.lit(0)).asc_nulls_last()
    return planned.repartitionByRange(first, F.col(id_col)).sortWithinPartitions(first, F.col(id_col))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix in training order: a row per copy, with ``epoch`` and ``position``.

    Sorted by range, so the files of the written result follow each other in time. See
    ``mix_plan`` for nulls and repeated rows; documents that are not taken are left out.
    """
    planned = schedule(docs, id_col, text_col, source_col).where("copies > 0")
    timed = planned.select("*", F.posexplode("positions").alias("epoch", "position")).drop("positions")
    return timed.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)
