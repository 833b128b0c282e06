"""Running numbers over groups of any size.

A conversation may hold a third of all rows, so no window spans one. Rows are
cut into blocks of bounded size along their order; numbers run inside a block,
and each block starts where the blocks before it end. Only block totals, a few
bytes per block, meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recallspark.runtime import Stage


def block_starts(totals: DataFrame, group: list[str], block: str, count: str, start: str) -> DataFrame:
    """First number of every block from the row counts of the blocks."""
    before = (
        Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *group, block, F.coalesce(F.sum(count).over(before), F.lit(0).cast("long")).alias(start)
    )


def number_items(
    df: DataFrame, group: str, order: str, items: str, start: str, rows_per_block: int
) -> DataFrame:
    """Add `start`: how many elements the `items` arrays of earlier rows of the group hold.

    `order` is a non-negative integer, unique in its group and about dense. The
    rows are shuffled once, by group and block.
    """
    block = F.expr(f"`{order}` div {int(rows_per_block)}")
    blocked = df.withColumn("_block", block).withColumn("_n", F.size(items))
    within = (
        Window.partitionBy(group, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumn(start, F.coalesce(F.sum("_n").over(within), F.lit(0).cast("long")))

    # Reads the two key columns only.
    long_groups = (
        df.groupBy(group)
        .agg(F.max(block).alias("_last"))
        .filter("_last > 0")
        .select(group)
    )
    if long_groups.isEmpty():
        return local.drop("_block", "_n")
    counted = blocked.join(long_groups, group, "left_semi")
    totals = counted.groupBy(group, "_block").agg(F.sum("_n").alias("_n"))
    starts = block_starts(totals, [group], "_block", "_n", "_before").filter("_before > 0")
    return (
        local.join(starts, [group, "_block"], "left")
        .withColumn(start, F.col(start) + F.coalesce("_before", F.lit(0).cast("long")))
        .drop("_block", "_n", "_before")
    )


def number_in_file_order(
    df: DataFrame, stage: Stage, name: str, number: str, group: str = "file_path"
) -> DataFrame:
    """Add `number`, the place of a row among the rows of its file, without a shuffle.

    `df` must come from a file scan by narrow steps only: the rows of a split
    then follow each other in one task. They are written once, which freezes the
    ids; the splits' first ids and counts give every split its first number.
    """
    frozen = stage.write(df.withColumn("_seq", F.monotonically_increasing_id()), name)
    totals = frozen.groupBy(group, "block_start").agg(
        F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = (
        Window.partitionBy(group).orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = stage.write(
        totals.select(
            group,
            "block_start",
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        ),
        f"{name}_splits",
    )
    return (
        frozen.join(shifts, [group, "block_start"])
        .withColumn(number, F.col("_seq") + F.col("_shift"))
        .drop("_seq", "_shift")
    )


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. The limit is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(window)).filter("_row = 1").drop("_row")
