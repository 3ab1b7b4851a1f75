"""The ranked board: rank shares, replacement value, blended scores, risk bands, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import ordered, panel, ranking
from tidewell.sources import files


def build(forecast: DataFrame, weight: float = 0.2) -> DataFrame:
    """Board of one season from rows (entity, position, team, points, risk)."""
    group = ["position"]
    df = forecast.withColumn("health", 1 - F.col("risk"))
    df = df.withColumn("pct", ranking.rank_pct(F.col("points"), group))
    df = df.withColumn("position_rank", F.rank().over(Window.partitionBy("position").orderBy(F.desc("points"))))
    df = df.withColumn("draft_score", F.round(fn.combined_score(F.col("pct"), F.col("health"), weight), 2))
    df = ranking.replacement(df, group, "points", fn.mapped(F.col("position"), fn.TOP_K, F.lit(12)))
    over = F.round("over_replacement", 2)
    top = df.agg(F.max(over).alias("top"))  # one row
    df = df.withColumn("vorp", over).crossJoin(F.broadcast(top))
    df = df.withColumn("overall_value", F.round(F.coalesce(F.try_divide(F.greatest(F.col("vorp"), F.lit(0.0)), F.col("top")), F.lit(0.0)), 4))
    df = df.withColumn("relative_health", ranking.centered(F.col("health"), group))
    score = F.round(fn.combined_score(F.col("overall_value"), F.col("relative_health"), weight), 2)
    cols = ["entity", "position", "team", "points", "pct", "position_rank", "draft_score", "vorp", "overall_value", "overall_score", "risk_band"]
    return df.withColumn("overall_score", score).withColumn("risk_band", fn.risk_band(F.col("risk"))).select(*cols)


def scored(rows: DataFrame, weight: float = 0.2) -> DataFrame:
    """rows(entity, position, points, risk, ...) with all figures of the board.

    Rank shares, ranks and the level of the last starter of a position come from counts by ranges of values,
    so no position has to fit in one task.
    """
    rows = files.once(rows.withColumn("_of", F.struct("position")), "board-rows")
    values = files.once(ordered.values(rows, "points", ["position"]), "board-values")
    above = F.col("total") - F.col("below") - F.col("n")
    places = values.select(F.col("_g").alias("_of"), F.col("_v").alias("points"), (ordered.mean_place() / F.col("total")).alias("pct"), (above + 1).alias("position_rank"))
    starters = F.least(fn.mapped(F.col("_g.position"), fn.TOP_K, F.lit(12)), F.col("total"))
    level = F.max(F.when(F.col("total") - F.col("below") >= starters, F.col("_v")))
    means = rows.groupBy("_of").agg(F.avg(1 - F.col("risk")).alias("mean_health"))
    peers = values.groupBy(F.col("_g").alias("_of")).agg(level.alias("replacement")).join(means, "_of")  # a row a position
    df = rows.join(places, ["_of", "points"]).join(peers, "_of").withColumn("health", 1 - F.col("risk"))
    df = df.withColumn("vorp", F.round(F.col("points") - F.col("replacement"), 2))
    top = values.join(peers, F.col("_g") == F.col("_of")).agg(F.max(F.round(F.col("_v") - F.col("replacement"), 2)).alias("top"))  # one row
    df = df.crossJoin(F.broadcast(top))
    df = df.withColumn("overall_value", F.round(F.coalesce(F.try_divide(F.greatest("vorp", F.lit(0.0)), "top"), F.lit(0.0)), 4))
    df = df.withColumn("relative_health", F.least(F.greatest(F.col("health") - F.col("mean_health") + 0.5, F.lit(0.0)), F.lit(1.0)))
    df = df.withColumn("draft_score", F.round(fn.combined_score(F.col("pct"), F.col("health"), weight), 2))
    df = df.withColumn("overall_score", F.round(fn.combined_score(F.col("overall_value"), F.col("relative_health"), weight), 2))
    return df.withColumn("risk_band", fn.risk_band(F.col("risk"))).drop("_of", "mean_health", "top")


def assemble(candidates: DataFrame, forecasts: DataFrame, probabilities: DataFrame, screen: DataFrame, as_of: str, weight: float = 0.2) -> DataFrame:
    """The board of the season to come from all its inputs.

    candidates(entity, position, team, available, ...), forecasts(entity, points, ...), probabilities(entity, risk),
    screen(entity, status_as_of, ...) with a row for each listing. Reading it fails if an entity repeats in one of the
    first three, if a candidate, available or not, has no forecast or no probability, or if a listing of a candidate has
    another date than `as_of`. Unavailable candidates are left out before anything is ranked. Probabilities are
    held within 0 and 1. An entity that the screen has more than once keeps its row that is first by all its columns.
    """
    df = candidates.select("entity").distinct()
    for side in (candidates, forecasts, probabilities):
        df = panel.left_checked(df, side, ["entity"])
    covered = F.col("points").isNotNull() & F.col("risk").isNotNull()
    missing = F.raise_error("a candidate has no forecast or no probability").cast("boolean")
    df = df.where(F.when(covered, F.coalesce("available", F.lit(False))).otherwise(missing)).drop("available")
    df = scored(df.withColumn("risk", F.least(F.greatest("risk", F.lit(0.0)), F.lit(1.0))), weight)
    df = df.withColumn("points_confidence", F.when(F.col("position") == "K", "low (kicker)").otherwise("standard"))
    first = screen.groupBy("entity").agg(F.min(F.struct(*[c for c in screen.columns if c != "entity"])).alias("_s")).select("entity", "_s.*", F.lit(True).alias("_listed"))
    dated = F.when(F.col("status_as_of").isNull() | (F.col("status_as_of").cast("string") == as_of), F.coalesce("_listed", F.lit(False)))
    other = F.raise_error(f"a listing has another date than {as_of}").cast("boolean")
    return df.join(first, "entity", "left").withColumn("listed", F.coalesce(dated, other)).drop("_listed")


def pages(board: DataFrame) -> DataFrame:
    """Every row on the page ALL and its position's page, those of higher risk on INJURED too, numbered there."""
    injured = F.when(F.col("risk_band") == "higher", F.lit("INJURED"))
    paged = board.withColumn("page", F.explode(F.array_compact(F.array(F.lit("ALL"), F.col("position"), injured))))
    n = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("overall_score"), F.desc("points"), "entity"))
    return paged.withColumn("place", n)
