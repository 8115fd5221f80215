"""Ordered computations that hold up when one group has a large share of all rows.

A plain window over a document or a query puts all its rows into one task. The
functions here cut each group into blocks of positions, compute within blocks and
carry one small row per block across them, so a task never sees more than a block.
Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.session import cut_lineage

BLOCK = 4096
TOP_K_FAN = 32


def _block_of(position: str, size: int) -> Column:
    return F.floor(F.col(position) / F.lit(size)).cast("long")


def _before(group: Sequence[str], order: str):
    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _by_block(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Dealt by group and block, also where the rows are already dealt by the group alone.

    Spark takes the coarser dealing as good enough for a window by group and block; then
    one task would hold a whole group.
    """
    return df.repartition(*group, "_block")


def running_offset(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    amount: Column,
    out: str,
    ties: Sequence[str] = (),
    size: int = BLOCK,
) -> DataFrame:
    """Add ``out``: sum of ``amount`` over the earlier rows of the group.

    ``position`` is a whole number about as dense as the rows; it may be negative. Groups
    with all rows in block 0 need no carry: where no other group exists the carry
    side is empty, and adaptive execution drops it. The carry has one row per block of a
    group in one task, 1 / ``size`` of the group's positions.
    """
    group = list(group)
    blocked = df.withColumn("_block", _block_of(position, size)).withColumn("_amount", amount)
    long_groups = blocked.where(F.col("_block") != 0).select(*group).distinct()
    totals = (
        blocked.join(long_groups, group, "left_semi")
        .groupBy(*group, "_block")
        .agg(F.sum("_amount").alias("_total"))
    )
    carried = totals.select(
        *group, "_block", F.sum("_total").over(_before(group, "_block")).alias("_carried")
    )
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(position, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    total = F.coalesce(F.col("_carried"), F.lit(0)) + F.coalesce(F.sum("_amount").over(inside), F.lit(0))
    return (
        _by_block(blocked, group).join(carried, [*group, "_block"], "left")
        .withColumn(out, total)
        .drop("_block", "_amount", "_carried")
    )


def row_index(
    df: DataFrame, group: Sequence[str], position: str, out: str, ties: Sequence[str] = (), size: int = BLOCK
) -> DataFrame:
    """Add ``out``: 0-based place of the row in its group by ``position``."""
    return running_offset(df, group, position, F.lit(1).cast("long"), out, ties, size)


def last_before(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    value: Column,
    out: str,
    ties: Sequence[str] = (),
    size: int = BLOCK,
) -> DataFrame:
    """Add ``out``: last non-null ``value`` of the earlier rows of the group."""
    group = list(group)
    order = [position, *ties]
    blocked = df.withColumn("_block", _block_of(position, size)).withColumn("_value", value)
    newest = (
        blocked.where(F.col("_value").isNotNull())
        .groupBy(*group, "_block")
        .agg(F.max_by("_value", F.struct(*order)).alias("_newest"))
    )
    # Every block needs a carry, also one that has no value itself.
    blocks = blocked.select(*group, "_block").distinct().join(newest, [*group, "_block"], "left")
    carried = blocks.select(
        *group, "_block", F.last("_newest", ignorenulls=True).over(_before(group, "_block")).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    inside = (
        Window.partitionBy(*group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _by_block(blocked, group).join(carried, [*group, "_block"], "left")
        .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carried")))
        .drop("_block", "_value", "_carried")
    )


def global_index(df: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """Add ``out``: 0-based place of the row in the whole table by ``order``, a total order.

    The rows are range-partitioned and written out, numbered within their range, and
    shifted by the sizes of the ranges before, one small row each.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    # As many rows as there are shuffle partitions.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.withColumn("_place", F.row_number().over(inside) - 1)
        .join(F.broadcast(shifts), "_range")
        .withColumn(out, F.col("_shift") + F.col("_place"))
        .drop("_range", "_place", "_shift")
    )


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k_max: int,
    spread_by: Sequence[str],
    k: Column | None = None,
    rank: str = "rank",
    fan: int = TOP_K_FAN,
) -> DataFrame:
    """First ``k`` rows (at most the constant ``k_max``) per key, with a 1-based ``rank``.

    A first round cuts ``fan`` hash slices of every key to ``k_max`` rows, so a key
    that matches much of the table is spread over many tasks; the second round
    merges at most ``fan * k_max`` rows per key. The constant bound lets Spark cut
    each input partition before the shuffle.
    """
    k_max = max(0, k_max)
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(fan)))
    # One value for key and slice: rows that are already dealt by the key alone would
    # else count as dealt by key and slice and stay in one task.
    sliced = sliced.withColumn("_deal", F.struct(*keys, "_slice"))
    # Its hash comes first, since a sort by a number is quicker than one by a struct.
    sliced = sliced.withColumn("_sign", F.xxhash64(*keys, "_slice"))
    for partition in (["_sign", "_deal"], [*keys]):
        window = Window.partitionBy(*partition).orderBy(*order)
        sliced = sliced.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k_max)
    ranked = sliced.drop("_slice", "_deal", "_sign")
    return ranked if k is None else ranked.where(F.col(rank) <= F.greatest(F.lit(0), k))
