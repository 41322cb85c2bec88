"""Ranking, top-k, winners and budgets over keyed rows; every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; with a fixed k Spark prunes before the shuffle, else k is a column's value."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(name) <= k)


def winners(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best row of each key."""
    return top_k(rows, keys, order, 1).drop("rank")


def within_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, limit: int | Column) -> DataFrame:
    """Adds used (running sum of ``size``) and keeps rows while it is within ``limit``."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(running)).where(F.col("used") <= limit)


def joined(value: str, order: str, separator: str) -> Column:
    """Aggregate: ``value`` strings in ascending ``order``, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))), lambda x: x["v"]), separator)
