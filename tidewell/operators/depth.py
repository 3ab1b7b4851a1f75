"""Depth charts of two layouts as one rank and tier an entity and season.

A chart with a time gives the last snapshot of its season up to a day of it; a chart by weeks gives its first week. Rows
without an entity or season, or with another position, are left out. A rank that is no number is unknown and comes last; an entity
of unknown ranks alone stays, with null. Equal ranks are one row, whatever the number of charts that give them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn

# Lowest tier, receivers abreast in a tier, formations of a weekly chart.
LOWEST, ABREAST = 3, 3
FORMATIONS = ["Offense", "Special Teams"]


def _best(df: DataFrame, tier: Column) -> DataFrame:
    """df(season, entity, depth_rank): the row of the lowest tier, then rank, of each season and entity."""
    last = lambda c: F.coalesce(c, F.lit(float("inf")))
    best = F.min(F.struct(last(tier).alias("t"), last(F.col("depth_rank")).alias("r")))
    known = lambda c: F.nullif(F.col(c), F.lit(float("inf")))
    got = df.where("season is not null and entity is not null").groupBy("season", "entity").agg(best.alias("b"))
    return got.select("season", "entity", known("b.r").alias("depth_rank"), known("b.t").alias("depth_tier"))


def _known(tier: Column) -> Column:
    """The tier, at most LOWEST; least() passes over nulls, so an unknown rank is kept from becoming the lowest tier."""
    return F.when(F.col("depth_rank").isNotNull(), F.least(tier, F.lit(float(LOWEST))))


def dated(charts: DataFrame, month: int, day: int) -> DataFrame:
    """charts(season, at, entity, position, rank), `at` a time or its text: tiers of the last snapshot up to the end of that day.

    A season's snapshot is one time for all its entities: who is not in it has no tier, whatever an earlier one said.
    Seasons without a snapshot in time are left out. Receivers go three to a tier.
    """
    rows = charts.withColumn("_at", F.col("at").try_cast("timestamp"))
    rows = rows.where(F.col("_at") < F.date_add(F.make_date("season", F.lit(month), F.lit(day)), 1).cast("timestamp"))
    newest = rows.groupBy("season").agg(F.max("_at").alias("_at"))  # a row a season
    rows = rows.join(F.broadcast(newest), ["season", "_at"]).where(F.col("position").isin(list(fn.POSITIONS)))
    rows = rows.withColumn("depth_rank", fn.numeric(F.col("rank")))
    return _best(rows, _known(F.when(F.col("position") == "WR", F.ceil(F.col("depth_rank") / ABREAST).cast("double")).otherwise(F.col("depth_rank"))))


def weekly(charts: DataFrame) -> DataFrame:
    """charts(season, week, formation, position, entity, rank): tiers of each season's week 1."""
    rows = charts.where((F.col("week") == 1) & F.col("formation").isin(FORMATIONS) & F.col("position").isin(list(fn.POSITIONS)))
    return _best(rows.withColumn("depth_rank", fn.numeric(F.col("rank"))), _known(F.col("depth_rank")))


def with_tiers(players: DataFrame, tiers: DataFrame) -> DataFrame:
    """players(season, entity, position) with rank and tier; one of the panel's positions without a tier is in the lowest."""
    joined = players.join(tiers, ["season", "entity"], "left")
    lowest = F.when(F.col("position").isin(list(fn.POSITIONS)), F.lit(float(LOWEST)))
    return joined.withColumn("depth_charted", F.col("depth_tier").isNotNull()).withColumn("depth_tier", F.coalesce("depth_tier", lowest))
