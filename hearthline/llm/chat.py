"""Chat formatting: snapshots of growing conversations collapse before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import stored

# Turns of a conversation that one row and one window hold; longer ones go on in the next.
SEGMENT_TURNS = 256
# monotonically_increasing_id keeps the row's place in its partition in 33 bits.
_PLACE_BITS = 33
_NO_TURN = -(2**63)  # block of rows without a turn number
TURN = "<|im_start|>%s\n%s<|im_end|>\n"


def _placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with ``seg``, ``at`` (place in the conversation) and its ``length``.

    Rows are range-partitioned in their order and written once, each with its partition
    and place there; places in a conversation, and in a block of ``SEGMENT_TURNS`` turn
    numbers, follow from the counts per conversation, block and partition. A block is
    cut every ``SEGMENT_TURNS`` rows, so a segment is bounded whatever the turn numbers
    are, and no task gets a whole conversation.
    """
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select(*order).distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("slot", F.monotonically_increasing_id()), "turns").select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS), F.lit(_NO_TURN)).alias("block"),
        F.shiftright("slot", _PLACE_BITS).alias("part"),
        F.col("slot").bitwiseAND((1 << _PLACE_BITS) - 1).alias("place"),
        "role",
        "text",
    )
    runs = rows.groupBy("conv_id", "block", "part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    blocks = runs.groupBy("conv_id", "block").agg(F.sum("n").alias("n"))
    segments = F.ceil(F.col("n") / SEGMENT_TURNS)
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("c"),
        F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"),
        F.coalesce(F.sum(segments).over(earlier), F.lit(0)).alias("seg_start"),
        F.sum("n").over(conversation).alias("length"),
    )
    in_block = Window.partitionBy("conv_id", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("skip", F.coalesce(F.sum("n").over(in_block), F.lit(0)) - F.col("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))
    runs = runs.join(blocks, same).select(
        "c", "b", F.col("part").alias("p"), "skip", "start", "seg_start", "length"
    )
    inside = F.col("skip") + F.col("place")
    return rows.join(runs, same & (F.col("part") == F.col("p"))).select(
        "conv_id",
        (F.col("seg_start") + F.floor(inside / SEGMENT_TURNS)).alias("seg"),
        "role",
        "text",
        "length",
        (F.col("start") + inside + 1).alias("at"),
    )


def _prefixes(placed: DataFrame) -> DataFrame:
    """Every prefix: conversation, its length, the prefix's length and 128-bit hash."""
    hashed = placed.select(
        "conv_id",
        "seg",
        "at",
        "length",
        *(
            F.xxhash64(
                F.lit(seed), "at", F.col("role").isNull(), F.col("text").isNull(), "role", "text"
            ).alias(name)
            for seed, name in ((1, "a"), (2, "b"))
        ),
    )
    so_far = Window.partitionBy("conv_id", "seg").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = hashed.select(
        "conv_id", "seg", "at", "length",
        F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"),
    )
    whole = hashed.groupBy("conv_id", "seg").agg(F.bit_xor("a").alias("sa"), F.bit_xor("b").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(
        F.col("conv_id").alias("c"),
        F.col("seg").alias("s"),
        F.coalesce(F.bit_xor("sa").over(earlier), F.lit(0)).alias("ca"),
        F.coalesce(F.bit_xor("sb").over(earlier), F.lit(0)).alias("cb"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("seg").eqNullSafe(F.col("s"))
    return run.join(carried, same).select(
        "conv_id", "length", "at",
        F.col("a").bitwiseXOR(F.col("ca")).alias("a"), F.col("b").bitwiseXOR(F.col("cb")).alias("b"),
    )


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """From ``_placed``: conv_id and n_turns of conversations that are no prefix of a longer one.

    Of conversations with equal turns the smallest conv_id stays. Full hashes meet the
    distinct proper prefixes in an anti-join; both sides are aggregated first, so a turn
    or a conversation that a third of the log shares is one row there.
    """
    prefixes = _prefixes(placed)
    full = (
        prefixes.where(F.col("at") == F.col("length"))
        .groupBy("a", "b", "length")
        .agg(F.min("conv_id").alias("conv_id"))
    )
    proper = prefixes.where(F.col("at") < F.col("length")).select("a", "b", "at").distinct()
    inner = proper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), "at")
    match = (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")) & (F.col("length") == F.col("at"))
    return full.join(inner, match, "left_anti").select("conv_id", F.col("length").alias("n_turns"))


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in the template; NULL role or text reads as empty."""
    return F.format_string(TURN, F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, segment (from 0), n_turns, first_turn, text.

    Turns (conv_id, turn, role, text) are in the order of turn, then role and text, NULLs
    first. Rows repeated in all four are one turn; other columns are ignored. Turns are
    compared by place, role and text, NULL unlike the empty text. A NULL conv_id is a
    conversation of its own; where copies exist it gives way to any id. Conversations
    above ``SEGMENT_TURNS`` turns are rendered in segments whose texts follow each other: one
    for each ``SEGMENT_TURNS`` turn numbers, and more where these numbers, or NULL, hold
    more rows than that. No row has more than ``SEGMENT_TURNS`` turns.
    """
    placed = _placed(turns)
    kept = maximal_conversations(placed).withColumnRenamed("conv_id", "keep")
    # Joined by segment: a hot conversation's turns do not meet in one task.
    cuts = placed.select(F.col("conv_id").alias("c"), F.col("seg").alias("s")).distinct()
    cuts = cuts.join(kept, F.col("c").eqNullSafe(F.col("keep")), "left_semi")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))
    chosen = placed.join(cuts, same, "left_semi")
    parts = F.sort_array(F.collect_list(F.struct("at", "role", "text")))
    segments = chosen.groupBy("conv_id", "seg").agg(F.max("length").alias("n_turns"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: rendered_turn(p["role"], p["text"])), "")
    return segments.select(
        "conv_id",
        F.col("seg").cast("int").alias("segment"),
        "n_turns",
        F.element_at("parts", 1)["at"].cast("long").alias("first_turn"),
        text.alias("text"),
    )
