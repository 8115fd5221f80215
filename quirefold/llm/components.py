"""Connected components of an edge table, by alternating large and small stars.

Every round replaces edges by edges to smaller neighbours until each node points at the
smallest node of its component. Rounds are written tables, so lost executors cost one
round, and nothing is collected but a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import cut_lineage, release

MAX_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where(F.col("b") < F.col("a"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    moved = near.join(least, "a")
    if large:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root``, the smallest node of its component, for every node of ``edges`` (``a``, ``b``).

    Loops, repeated edges and nulls have no effect; an empty table gives an empty table.
    """
    clean = lambda df: df.where(F.col("a") != F.col("b")).distinct()
    current, sign = cut_lineage(clean(edges.select("a", "b"))), None
    for _ in range(MAX_ROUNDS):
        found = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sign == found or not found["n"]:
            break
        sign = found
        before, current = current, cut_lineage(clean(_star(clean(_star(current, True)), False)))
        release(before)
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
