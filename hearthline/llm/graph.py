"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.session import stored


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of ``edges`` (u, v).

    Each round hangs every node below its smallest neighbour, follows the pointers once
    more, and contracts the edges to what they now join, until none is left. Rounds are
    logarithmic in the length of paths for the trees and stars that occur here. Every
    round's tables are written to the shared folder: a lost executor costs one stage.
    """
    work = edges.select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    ).where("u < v").distinct()
    work = stored(work, "edges")
    label = None
    while not work.isEmpty():
        both = work.select(F.col("v").alias("node"), F.col("u").alias("to")).union(
            work.select(F.col("u").alias("node"), F.col("v").alias("to"))
        )
        up = both.groupBy("node").agg(F.min("to").alias("to"))
        up = stored(up.select("node", F.least("node", "to").alias("to")), "pointers")
        above = up.select(F.col("node").alias("to"), F.col("to").alias("top"))
        jumped = stored(up.join(above, "to").select("node", F.col("top").alias("to")), "jumped")
        if label is None:
            label = jumped.select("node", F.col("to").alias("component"))
        else:
            further = jumped.select(F.col("node").alias("component"), "to")
            label = label.join(further, "component", "left").select(
                "node", F.coalesce("to", "component").alias("component")
            )
        label = stored(label, "labels")
        one = stored(
            work.join(jumped.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").select("a", "v"),
            "half",
        )
        moved = one.join(jumped.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        work = moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        work = stored(work.where("u < v").distinct(), "edges")
    if label is None:
        return work.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label
