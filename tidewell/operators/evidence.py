"""Feature evidence: associations, selection, false discovery, votes and consensus over feature rankings.

Features come in long form: rows (entity key columns, feature, x, y).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import ordered
from tidewell.operators.evaluation import safe_corr
from tidewell.sources import files


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """One row a feature: keep columns, feature, x."""
    return df.unpivot(keep, features, "feature", "x")


def filled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (feature, x, keys) with unknown x, NaN and infinite ones too, as the feature's median, and 0 where it has none."""
    known = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    clean = rows.select("feature", known.alias("x"), *keys)
    medians = ordered.quantiles(clean, "x", ["feature"], [0.5]).select("feature", F.col("q")[0].alias("median"))
    return clean.join(medians, "feature", "left").select("feature", F.coalesce("x", "median", F.lit(0.0)).alias("x"), *keys)


def fold_scores(rows: DataFrame, group: list[str]) -> DataFrame:
    """|correlation| of within-group rank shares of x and y for each feature, constants 0."""
    share = ordered.mean_place() / F.col("total")
    r = ordered.with_ranks(rows, {"rx": ("x", share), "ry": ("y", share)}, ["feature", *group])
    return r.groupBy("feature").agg(F.abs(safe_corr(F.col("rx"), F.col("ry"))).alias("score"))


def top_features(scores: DataFrame, top: int) -> DataFrame:
    """The features with the `top` highest scores above 0, with their place; equal scores by name."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "feature"))  # a row a feature
    return scores.where("score > 0").withColumn("place", place).where(F.col("place") <= top)


def association(rows: DataFrame) -> DataFrame:
    """Per feature against a 0/1 y: means by class, rank correlation, point-biserial, AUC, its better side.

    Unknown x count as the feature's median. p is the two-sided Mann-Whitney p with ties and continuity corrected, 1
    for a constant feature. Ranks come from the distinct values of a feature with their rows of either class, dealt by ranges.
    """
    full = files.once(filled(rows, ["y"]), "filled")
    cells = ordered.values(full, "x", ["feature"], pos=F.col("y"))
    place = ordered.mean_place() - (F.col("total") + 1) / 2  # from the mean place, so that sums of squares stay exact enough
    w, t = F.col("n").cast("double"), F.col("n").cast("double")
    n1, n = F.sum("pos").cast("double"), F.sum(w)
    n0 = n - n1
    u = F.sum(ordered.mean_place() * F.col("pos")) - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * (n + 1 - F.try_divide(F.sum(t * (t * t - 1)), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5, spread)
    # ranks of y take two values, n / 2 apart: their correlation with ranks of x needs sums by class alone
    rho = F.try_divide(F.sum(place * F.col("pos")) / n, F.sqrt(F.sum(place * place * w) / n) * F.sqrt(n1 / n * n0 / n))
    ranks = cells.groupBy(F.col("_g.feature").alias("feature")).agg(
        F.coalesce(rho, F.lit(0.0)).alias("spearman"),
        F.try_divide(u, n1 * n0).alias("auc"),
        F.least(F.coalesce(2 * fn.normal_tail(F.greatest(z, F.lit(0.0))), F.lit(1.0)), F.lit(1.0)).alias("p"),
    )
    means = full.groupBy("feature").agg(
        F.avg(F.when(F.col("y") == 1, F.col("x"))).alias("mean_1"),
        F.avg(F.when(F.col("y") == 0, F.col("x"))).alias("mean_0"),
        safe_corr(F.col("x"), F.col("y")).alias("point_biserial"),
    )
    got = means.join(ranks, "feature").select("feature", "mean_1", "mean_0", "spearman", "point_biserial", "auc", "p")
    return got.withColumns({"auc_best": F.greatest(F.col("auc"), 1 - F.col("auc")), "direction": F.when(F.col("auc") >= 0.5, 1).otherwise(-1)})


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """Add q: smallest p * d / rank from here up, at most 1. df has a row a feature."""
    up = Window.partitionBy(F.lit(1)).orderBy(p, "feature")
    d = F.count("*").over(Window.partitionBy(F.lit(1)))
    raw = df.withColumn("_raw", F.col(p) * d / F.row_number().over(up))
    return raw.withColumn("q", F.least(F.min("_raw").over(up.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))).drop("_raw")


def vote(ranks: DataFrame, weights: dict[str, float] | None = None, top: int = 20) -> DataFrame:
    """Weighted reciprocal-rank and Borda votes from rows (method, feature, rank), and how many methods rank it within `top`."""
    d = F.count("*").over(Window.partitionBy("method"))
    w = F.coalesce(fn.mapped(F.col("method"), weights or {}), F.lit(1.0))
    return ranks.withColumn("d", d).withColumn("w", w).groupBy("feature").agg(
        F.sum(F.col("w") / F.col("rank")).alias("reciprocal"),
        F.sum(F.col("w") * (F.col("d") - F.col("rank"))).cast("double").alias("borda"),
        F.count_if(F.col("rank") <= top).alias("in_top"),
    )


def overlap(ranks: DataFrame, top: int = 20) -> DataFrame:
    """(one, other, shared): features that two methods both rank within `top`; a row a feature and method comes in."""
    best = ranks.where(F.col("rank") <= top)
    a, b = best.select(F.col("method").alias("one"), "feature"), best.select(F.col("method").alias("other"), "feature")
    return a.join(b, "feature").where("one < other").groupBy("one", "other").agg(F.count("*").alias("shared"))


def consensus(df: DataFrame, ranks: list[str]) -> DataFrame:
    """Mean of the rank columns that are there, and its order; df has a row a feature."""
    known = F.filter(F.array(*[F.col(r).cast("double") for r in ranks]), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    out = df.withColumn("mean_rank", mean)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("mean_rank"), "feature")))


def constants(rows: DataFrame) -> DataFrame:
    """Features with one value, an unknown value counting as one."""
    kinds = F.count_distinct("x") + F.max(F.col("x").isNull().cast("int"))
    return rows.groupBy("feature").agg(kinds.alias("kinds")).where("kinds <= 1")
