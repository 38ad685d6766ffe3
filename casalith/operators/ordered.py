"""Running sums and numbers over sorted rows, in parallel: rows are dealt into ranges, each range is folded, few sums of ranges are carried on.

A window over a group keeps the group in one task. Here a group of any size spans as many ranges as its rows need, and the only
windows over whole groups see one row a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import cut


def dealt(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """rows with __range: its number among ranges by group and order. Written, so that a lost task can't deal them anew."""
    return cut(rows.repartitionByRange(*[F.col(g).asc() for g in group], *order).withColumn("__range", F.spark_partition_id()))


def running(rows: DataFrame, group: list[str], order: list, value: Column, name: str, fold: Callable = F.sum, before: bool = False) -> DataFrame:
    """dealt rows with `name`: the fold (F.sum or F.max) of value over the rows of their group up to their own, or before it.

    Null values don't count; where nothing came before, the sum is 0 and the maximum null. Null is a group of its own. Rows of equal
    order have some order among them, the same at each call on the same dealt rows only if `order` tells them apart.
    """
    carried = fold("__v").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    held = rows.withColumn("__v", value)
    ranges = held.groupBy(*group, "__range").agg(fold("__v").alias("__v")).withColumn("__carried", carried)
    ranges = ranges.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__range").alias("__r"), "__carried")
    here = F.col("__range") == F.col("__r")
    for i, g in enumerate(group):
        here &= F.col(g).eqNullSafe(F.col(f"__g{i}"))
    within = fold("__v").over(Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    j = held.withColumn("__w", within).join(ranges, here, "left")
    total = F.greatest("__carried", "__w") if fold is F.max else F.coalesce("__carried", F.lit(0)) + F.coalesce("__w", F.lit(0))
    return j.withColumn(name, total).drop("__v", "__w", "__r", "__carried", *[f"__g{i}" for i in range(len(group))])


def numbered(rows: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """rows with `name`: their number in their group by order, from 1."""
    return running(dealt(rows, group, order), group, order, F.lit(1).cast("long"), name).drop("__range")
