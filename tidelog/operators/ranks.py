"""Orders and ranks without a window that brings a whole group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def ranged(df: DataFrame, by: list[Column]) -> DataFrame:
    """Range-partition and sort df; `_pid` is the partition and `_idx` the row's place in it.

    Ordered by (_pid, _idx) the rows stand in the order `by`. Store the result before using it:
    range bounds come from a sample and can differ between two runs of the same plan.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return placed.withColumns({"_pid": F.shiftright(at, 33).cast("int"), "_idx": at.bitwiseAND(F.lit((1 << 33) - 1))})


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with `_rank`, from 1 without gaps in each group by `order`; null groups are groups.

    A group may span partitions: only one row for each partition of a group meets in a window. Rows
    that tie in all of `order` take any of their ranks.
    """
    placed = stored(ranged(df, [F.col(c) for c in (*group, *order)]), "ranks")
    parts = placed.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid")) - F.col("_n") - F.col("_first")
    parts = parts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_pid").alias("_p"), before.alias("_before"))
    same = F.col("_pid") == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return placed.join(parts, same).select(*df.columns, (F.col("_before") + F.col("_idx") + 1).cast("long").alias("_rank"))
