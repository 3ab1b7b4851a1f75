"""Places, ranks and order statistics by ranges: no group and no table has to fit in one task.

Distinct values of each group, with their number of rows, are dealt by ranges of (group, value). Each range counts its
rows, the ranges of a group are put one after another (a row a range), and places inside a range come from a
running sum over it alone. Ties are one row, so a value that many rows share makes no range larger.

The ranges are written once in the shared folder, so that their numbers stay what they were if a task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.sources import files


def _grouped(group: list) -> Column:
    """The group as one column that is never null itself, so that unknown groups are groups too."""
    return F.struct(*[F.col(g) if isinstance(g, str) else g for g in group]) if group else F.struct(F.lit(0).alias("all"))


def ranges(df: DataFrame, order: list[Column], n: Column) -> DataFrame:
    """df with the number of rows of its group `_g` before each row in `order` (`below`) and in all (`total`).

    n is the number of rows that a row stands for; `order` names each row of a group but for equal ones.
    """
    dealt = df.withColumn("_n", n.cast("long")).repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id())
    dealt = files.once(dealt, "ranges")
    sums = dealt.groupBy("_g", "_part").agg(F.sum("_n").alias("_rows"))
    along = Window.partitionBy("_g").orderBy("_part")  # a row a range
    before = sums.select(
        "_g", "_part", F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_g")).alias("total"),
    )
    inside = Window.partitionBy("_g", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(before, ["_g", "_part"])
    return run.withColumn("below", F.col("_before") + F.col("_inside")).drop("_part", "_before", "_inside")


def values(df: DataFrame, value: str | Column, group: list = (), n: Column | None = None, **sums: Column) -> DataFrame:
    """(_g, _v, n, below, total, sums): each known value of a group, its rows, those below it and all of the group.

    `n` weighs rows (1 each as a rule); `sums` are further sums over the rows of a value.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(_grouped(list(group)).alias("_g"), v.alias("_v"), (F.lit(1) if n is None else n).alias("n"), *[c.alias(k) for k, c in sums.items()])
    cells = rows.where("_v is not null").groupBy("_g", "_v").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums])
    return ranges(cells, [F.col("_v")], F.col("n")).drop("_n")


def mean_place(descending: bool = False) -> Column:
    """Of values(): the rank in which ties share their mean place."""
    before = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    return before + (F.col("n") + 1) / 2


def with_ranks(df: DataFrame, columns: dict[str, tuple[str | Column, Column]], group: list) -> DataFrame:
    """df with a column of each name: an expression over the values() of (value, expression), null where the value is."""
    out = df.withColumn("_of", _grouped(list(group)))
    for name, (value, place) in columns.items():
        ranked = values(df, value, group).select(F.col("_g").alias("_of"), "_v", place.alias(name))
        out = out.withColumn("_v", F.col(value) if isinstance(value, str) else value).join(ranked, ["_of", "_v"], "left").drop("_v")
    return out.drop("_of")


def rank_avg(df: DataFrame, name: str, value: str | Column, group: list, descending: bool = False) -> DataFrame:
    return with_ranks(df, {name: (value, mean_place(descending))}, group)


def rank_pct(df: DataFrame, name: str, value: str | Column, group: list) -> DataFrame:
    """rank_avg over the number of known values in the group."""
    return with_ranks(df, {name: (value, mean_place() / F.col("total"))}, group)


def rank_min(df: DataFrame, name: str, value: str | Column, group: list, descending: bool = False) -> DataFrame:
    before = F.col("total") - F.col("below") - F.col("n") if descending else F.col("below")
    return with_ranks(df, {name: (value, before + 1)}, group)


def row_numbers(df: DataFrame, name: str, group: list, *order: Column) -> DataFrame:
    """Places 1, 2, ... of a group's rows in `order`, which should end in a unique column."""
    named = df.withColumn("_g", _grouped(list(group)))
    return ranges(named, list(order), F.lit(1)).withColumn(name, F.col("below") + 1).drop("_g", "_n", "below", "total")


def quantiles(df: DataFrame, value: str | Column, group: list[str], shares: list[float], n: Column | None = None) -> DataFrame:
    """(group, q, total): exact quantiles, between two order statistics in proportion; no value is buffered."""
    known = values(df, value, group, n)
    stats = []
    for i, share in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(share))
        # a value is the order statistic of place k if it is the largest with at most k rows below it
        stats += [
            F.max(F.when(F.col("below") <= F.floor(place), F.col("_v"))).alias(f"_a{i}"),
            F.max(F.when(F.col("below") <= F.ceil(place), F.col("_v"))).alias(f"_b{i}"),
        ]
    got = known.groupBy("_g").agg(F.max("total").alias("total"), *stats)
    between = []
    for i, share in enumerate(shares):
        place = (F.col("total") - 1) * F.lit(float(share))
        low, high = F.col(f"_a{i}").cast("double"), F.col(f"_b{i}").cast("double")
        between.append(low + (high - low) * (place - F.floor(place)))
    return got.select(*[F.col(f"_g.{g}").alias(g) for g in group], F.array(*between).alias("q"), "total")
