"""Ordered lists kept as rows: first occurrences and caps, without a list of a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_distinct(rows: DataFrame, group: list[str], value: str, order: Column, n: int) -> DataFrame:
    """(group, value, position): the first n different values of each group, by where each first stands; null and '' are none.

    Repeats collapse before the shuffle, and the rank filter is applied before it too.
    """
    once = rows.where(F.col(value).cast("string") != "").groupBy(*group, value).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("_first", value))
    return once.withColumn("position", rank).where(F.col("position") <= n).drop("_first")
