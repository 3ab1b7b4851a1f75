"""Ranks, de-duplication, peer groups and replacement levels as window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_avg(value: Column, group: list, descending: bool = False) -> Column:
    """Rank in which ties share their mean place; null values are null."""
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ties = Window.partitionBy(*group, value)
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count("*").over(ties) - 1) / 2)


def rank_pct(value: Column, group: list) -> Column:
    """rank_avg over the number of known values in the group."""
    return rank_avg(value, group) / F.count(value).over(Window.partitionBy(*group))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in `order`, which should end in a unique column."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def top_k(df: DataFrame, group: list[str], k: int | Column, *order: Column) -> DataFrame:
    """The first k rows of each group, with their place."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", n).where(F.col("place") <= k)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows share their key with another."""
    counts = df.groupBy(*keys).count().where("count > 1")
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_keys"))


def room(df: DataFrame, group: list, value: str) -> DataFrame:
    """Peers of a row in its group (an unknown group is a group): number, their total, those above 0, margin."""
    w = Window.partitionBy(*group)
    x = F.coalesce(F.col(value), F.lit(0.0))
    n = F.count("*").over(w) - 1
    others = F.sum(x).over(w) - x
    above = F.sum((x > 0).cast("int")).over(w) - (x > 0).cast("int")
    mean = F.coalesce(F.try_divide(others, F.when(n > 0, n)), F.lit(0.0))
    return df.withColumns({"competitors": n, "others_total": others, "nonzero_competitors": above, "margin": x - mean})


def replacement(df: DataFrame, group: list[str], value: str, k: Column) -> DataFrame:
    """Add the k-th best value of the group (the last if it has fewer) and the value over it."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy(F.desc(value), "entity"))
    at = F.least(k, F.count("*").over(w))
    level = F.max(F.when(F.col("_n") == F.col("_at"), F.col(value))).over(w)
    out = df.withColumn("_n", n).withColumn("_at", at).withColumn("replacement", level).drop("_n", "_at")
    return out.withColumn("over_replacement", F.col(value) - F.col("replacement"))


def centered(value: Column, group: list) -> Column:
    """Value less its group's mean plus 0.5, within 0 and 1."""
    return F.least(F.greatest(value - F.avg(value).over(Window.partitionBy(*group)) + 0.5, F.lit(0.0)), F.lit(1.0))
