"""Evaluation of forecasts: grouped rank, error, ranking and probability metrics, selection, resampling.

Forecasts are rows (group columns, entity, predicted, actual); probabilities are rows (p, label).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import ordered, ranking
from tidewell.sources import files

GROUP = ["season", "position"]


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate, 0 where a side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def spearman(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Rank correlation and rows of each group."""
    r = ordered.with_ranks(df, {"ra": ("actual", ordered.mean_place()), "rp": ("predicted", ordered.mean_place())}, group)
    return r.groupBy(*group).agg(safe_corr(F.col("ra"), F.col("rp")).alias("spearman"), F.count("*").alias("n"))


def _pair_signs(a: np.ndarray, p: np.ndarray, w: np.ndarray) -> float:
    """Sum of w * w' * sign(p' - p) over pairs with a < a', by halves of the rows in order of a."""
    order = np.argsort(a, kind="stable")
    a, p, w = a[order], p[order], w[order]
    total, todo = 0.0, [(0, len(a))]
    while todo:
        low, high = todo.pop()
        if high - low < 2 or a[low] == a[high - 1]:
            continue
        cut = int(np.searchsorted(a[low:high], a[(low + high) // 2])) + low  # between two values of a
        if cut == low:
            cut = int(np.searchsorted(a[low:high], a[low], side="right")) + low
        by = np.argsort(p[low:cut], kind="stable") + low
        left, sums = p[by], np.concatenate([[0.0], np.cumsum(w[by])])
        under = sums[np.searchsorted(left, p[cut:high], side="left")]
        over = sums[-1] - sums[np.searchsorted(left, p[cut:high], side="right")]
        total += float((w[cut:high] * (under - over)).sum())
        todo += [(low, cut), (cut, high)]
    return total


#: Rows of a block of kendall() at least; blocks grow with the root of a group's rows.
BLOCK = 20_000


def kendall(df: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Kendall's tau-b of each group, 0 where a side is constant; df is read several times.

    Each side of a group is cut into blocks by the places of its values, of BLOCK rows or, in groups of more than its
    square, of the root of their number, so that blocks and pairs of blocks both stay bounded. Pairs in different
    blocks on both sides are counted by two-dimensional prefix sums over the grid of block pairs, as two running sums. Pairs
    inside a block of either side are counted in the task of that block by sorting and halving: a pair is at no time a row.
    """
    size = F.greatest(F.lit(BLOCK), F.ceil(F.sqrt("total")).cast("long"))

    def side(column: str, at: str) -> DataFrame:
        known = ordered.values(df, column, group)
        return known.select("_g", F.col("_v").alias(column), "n", "total", size.alias("size"), F.floor(F.col("below") / size).cast("int").alias(at))

    one, two = files.once(side("actual", "i"), "kendall"), files.once(side("predicted", "j"), "kendall")
    cells = df.select(F.struct(*group).alias("_g"), "actual", "predicted").groupBy("_g", "actual", "predicted").agg(F.count("*").cast("double").alias("w"))
    cut = cells.join(one.select("_g", "actual", "i", "total", "size"), ["_g", "actual"]).join(two.select("_g", "predicted", "j"), ["_g", "predicted"])
    cut = files.once(cut, "kendall")

    # blocks of one value have no pair that counts, and a group of one block has its pairs in that block of the first side
    wide = lambda known, at: known.groupBy("_g", F.col(at).alias("at")).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    rows = lambda name, at: cut.select("_g", F.lit(name).alias("side"), F.col(at).alias("at"), "actual", "predicted", "w", "i", "total", "size")
    inside = rows("i", "i").join(wide(one, "i"), ["_g", "at"], "left_semi").unionByName(rows("j", "j").where("total > size").join(wide(two, "j"), ["_g", "at"], "left_semi"))

    def count(key, part):
        a, p, w, i = (part[c].to_numpy() for c in ("actual", "predicted", "w", "i"))
        s = _pair_signs(a, p, w)
        if part["side"].iloc[0] == "j":  # pairs that share a block of the first side too are counted there
            order = np.argsort(i, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(i[order])) + 1):
                s -= _pair_signs(a[same], p[same], w[same])
        return pd.DataFrame([[key[0], s]], columns=["k", "s"])

    near = inside.withColumn("k", F.to_json("_g")).groupBy("k", "side", "at").applyInPandas(count, "k string, s double")

    grid = cut.where("total > size").groupBy("_g", "i", "j").agg(F.sum("w").alias("w"))
    sizes = grid.groupBy("_g").agg(F.max("i").alias("mi"), F.max("j").alias("mj"))
    every = sizes.select("_g", F.explode(F.sequence(F.lit(0), "mi")).alias("i"), "mj").select("_g", "i", F.explode(F.sequence(F.lit(0), "mj")).alias("j"))
    full = every.join(grid, ["_g", "i", "j"], "left").select("_g", "i", "j", F.coalesce("w", F.lit(0.0)).alias("w"))
    above = F.coalesce(F.sum("w").over(Window.partitionBy("_g", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    along = Window.partitionBy("_g", "i").orderBy("j")
    before = F.coalesce(F.sum("above").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.coalesce(F.sum("above").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    far = full.withColumn("above", above).select(F.to_json("_g").alias("k"), (F.col("w") * (before - after)).alias("s"))

    score = near.unionByName(far).groupBy("k").agg(F.sum("s").alias("s"))
    pairs = lambda n: n * (n - 1) / 2

    def ties(known: DataFrame, name: str) -> DataFrame:
        n = F.col("n").cast("double")
        return known.groupBy("_g").agg(F.sum(pairs(n)).alias(name), pairs(F.max("total").cast("double")).alias("pairs"))

    both = ties(one, "t_actual").join(ties(two, "t_predicted").drop("pairs"), "_g").withColumn("k", F.to_json("_g")).join(score, "k", "left")
    low = F.sqrt((F.col("pairs") - F.col("t_actual")) * (F.col("pairs") - F.col("t_predicted")))
    return both.select(*[F.col(f"_g.{g}").alias(g) for g in group], F.coalesce(F.try_divide(F.col("s"), low), F.lit(0.0)).alias("kendall"))


def regression(df: DataFrame, group: list[str], ranked: list[str] = GROUP) -> DataFrame:
    """MAE, RMSE, R squared, calibration slope and intercept (0 and the mean for constant forecasts), mean error of ranks inside `ranked`."""
    places = {"_a": ("actual", ordered.mean_place(True)), "_p": ("predicted", ordered.mean_place(True))}
    e = F.col("actual") - F.col("predicted")
    slope = F.coalesce(F.try_divide(F.covar_pop("actual", "predicted"), F.var_pop("predicted")), F.lit(0.0))
    return ordered.with_ranks(df, places, ranked).groupBy(*group).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("actual"))).alias("r2"),
        F.avg(F.abs(F.col("_a") - F.col("_p"))).alias("rank_mae"),
        slope.alias("slope"),
        (F.avg("actual") - slope * F.avg("predicted")).alias("intercept"),
        F.count("*").alias("n"),
    )


def ndcg(df: DataFrame, k: int, group: list[str] = GROUP) -> DataFrame:
    """NDCG at k of each group with a positive actual; ties in the forecast share their mean gain."""
    w = Window.partitionBy(*group)
    gain = F.greatest(F.col("actual"), F.lit(0.0))
    place = F.row_number().over(w.orderBy(F.desc("predicted"), "entity"))
    ideal = F.row_number().over(w.orderBy(F.desc("actual"), "entity"))
    discount = lambda p: F.when(p <= k, 1 / F.log2(p + 1.0)).otherwise(0.0)
    rows = df.withColumns({"gain": gain, "d": discount(place), "di": discount(ideal)})
    ties = rows.groupBy(*group, "predicted").agg((F.avg("gain") * F.sum("d")).alias("dcg"), F.sum(F.col("gain") * F.col("di")).alias("idcg"))
    sums = ties.groupBy(*group).agg(F.sum("dcg").alias("dcg"), F.sum("idcg").alias("idcg")).where("idcg > 0")
    return sums.select(*group, (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def topk_recall(df: DataFrame, k: Column, group: list[str] = GROUP) -> DataFrame:
    """Share of the k best by actual that are among the k best by forecast; k may follow the group."""
    w = Window.partitionBy(*group)
    best = lambda c: F.row_number().over(w.orderBy(F.desc(c), "entity")) <= k
    both = df.withColumn("hit", (best("actual") & best("predicted")).cast("int")).withColumn("k", F.least(k, F.count("*").over(w)))
    return both.groupBy(*group).agg((F.sum("hit") / F.max("k")).alias("recall"))


def bust_rate(df: DataFrame, k: Column, group: list[str] = GROUP) -> DataFrame:
    """Share of the k best by forecast whose actual rank is beyond 2k."""
    w = Window.partitionBy(*group)
    rows = df.withColumns({"p": F.row_number().over(w.orderBy(F.desc("predicted"), "entity")), "r": F.rank().over(w.orderBy(F.desc("actual")))})
    return rows.where(F.col("p") <= k).groupBy(*group).agg(F.avg((F.col("r") > 2 * k).cast("int")).alias("bust_rate"))


def auc(df: DataFrame, group: list[str]) -> DataFrame:
    """Exact ROC AUC by ranks of the distinct scores; null for groups of one label."""
    per = ordered.values(df, "p", group, pos=F.col("label"))
    n1, n = F.sum("pos"), F.sum("n")
    area = F.try_divide(F.sum(ordered.mean_place() * F.col("pos")) - n1 * (n1 + 1) / 2, n1 * (n - n1))
    return per.groupBy("_g").agg(area.alias("auc"), n.alias("n")).select(*[F.col(f"_g.{g}").alias(g) for g in group], "auc", "n")


def thresholds(df: DataFrame, slices: int = 4096) -> DataFrame:
    """Counts at each distinct score, highest first, running.

    Scores are dealt by slices of the unit interval: sums run inside a slice in one task, and only the
    slices' totals, a row a slice, are summed in order in one place.
    """
    per = df.groupBy("p").agg(F.sum("label").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))
    per = per.withColumn("slice", F.floor(F.col("p") * slices))
    inside = Window.partitionBy("slice").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    totals = per.groupBy("slice").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    before = totals.select("slice", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(f"{c}_above") for c in ("pos", "n")])
    run = per.withColumns({"tp": F.sum("pos").over(inside), "seen": F.sum("n").over(inside)}).join(before, "slice")
    return run.select("p", "pos", "n", (F.col("tp") + F.col("pos_above")).alias("tp"), (F.col("seen") + F.col("n_above")).alias("seen"))


def average_precision(df: DataFrame) -> DataFrame:
    t = thresholds(df)
    return t.agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def roc_curve(df: DataFrame) -> DataFrame:
    t = thresholds(df)
    all_ = t.agg(F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("p0"))
    return t.crossJoin(F.broadcast(all_)).select("p", (F.col("tp") / F.col("p1")).alias("tpr"), ((F.col("seen") - F.col("tp")) / F.col("p0")).alias("fpr"))


def prob_loss(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    q = fn.clip(F.col("p"), eps, 1 - eps)
    loss = -F.avg(F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q)))
    return df.agg(loss.alias("log_loss"), F.avg((F.col("p") - F.col("label")) ** 2).alias("brier"), F.avg("label").alias("prevalence"))


def calibration_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """Observed and mean predicted share in quantile bins, right-closed."""
    edges = ordered.quantiles(df, "p", [], [i / bins for i in range(1, bins)]).select(F.col("q").alias("e"))
    # edges are one row of bins - 1 numbers
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda x: x < F.col("p"))))
    return binned.groupBy("bin").agg(F.avg("p").alias("predicted"), F.avg("label").alias("observed"), F.count("*").alias("n"))


def within_tolerance(df: DataFrame, metric: str, tolerance: float, *order: Column) -> DataFrame:
    """The row that comes first in `order` among those within tolerance of the best metric; df is a candidate table."""
    best = df.withColumn("_best", F.max(metric).over(Window.partitionBy(F.lit(1))))
    return best.where(F.col(metric) >= F.col("_best") - tolerance).drop("_best").orderBy(*order).limit(1)


def weight_grid(df: DataFrame, weights: list[float], k: int = 12, group: list[str] = GROUP) -> DataFrame:
    """Macro rank correlation, NDCG, recall and bust rate of the blend (1 - w) * predicted rank share + w * health, for each weight."""
    ranked = files.once(ordered.rank_pct(df, "pct", "predicted", group), "ranked")
    wide = ranked.withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    blend = wide.withColumn("predicted", F.round((1 - F.col("weight")) * F.col("pct") + F.col("weight") * F.col("health"), 9))
    by = ["weight", *group]
    per = spearman(blend, by).join(ndcg(blend, k, by), by, "left").join(topk_recall(blend, F.lit(k), by), by).join(bust_rate(blend, F.lit(k), by), by)
    return per.groupBy("weight").agg(*[F.avg(c).alias(c) for c in ("spearman", "ndcg", "recall", "bust_rate")])


def adoption(chosen: DataFrame, gain: DataFrame, least: float = 0.0) -> DataFrame:
    """The chosen candidate with the interval of its gain on the baseline; adopted if the low end exceeds `least`."""
    ends = gain.select("low", "mid", "high")
    return chosen.crossJoin(F.broadcast(ends)).withColumn("adopted", F.col("low") > least)  # one row


def candidate_table(rows: DataFrame, baseline: str, tolerance: float = 0.005) -> DataFrame:
    """A row a candidate of rows (candidate, components, group, predicted, actual): metrics, and which one is chosen.

    Candidates within tolerance of the best rank correlation are eligible; of these the one with fewer
    components, then the lower error, then the first name is selected. A candidate is adopted if it is
    within tolerance of the baseline or better.
    """
    ranks = spearman(rows, ["candidate", *GROUP]).groupBy("candidate").agg(F.round(F.avg("spearman"), 6).alias("spearman"))
    errors = F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 4)
    got = rows.groupBy("candidate").agg(F.max("components").alias("components"), F.count("*").alias("n"), errors.alias("mae")).join(ranks, "candidate")
    every = Window.partitionBy(F.lit(1))  # a row a candidate
    eligible = F.col("spearman") >= F.max("spearman").over(every) - tolerance
    reference = F.max(F.when(F.col("candidate") == baseline, F.col("spearman"))).over(every)
    order = Window.partitionBy("eligible").orderBy("components", "mae", "candidate")
    got = got.withColumns({"eligible": eligible, "baseline": F.col("candidate") == baseline, "gain": F.round(F.col("spearman") - reference, 6)})
    return got.withColumns({"selected": F.col("eligible") & (F.row_number().over(order) == 1), "adopted": F.col("gain") >= -tolerance})


def residual_intervals(df: DataFrame, group: str = "position", least: int = 20) -> DataFrame:
    """p10, p50, p90 of residuals by group and tercile of the forecast, (low, high], with the rows they are from.

    A bin of fewer than `least` rows, one without any included, takes the whole group's: a group always has three bins.
    """
    cuts = ordered.quantiles(df, "predicted", [group], [1 / 3, 2 / 3]).select(group, F.col("q").alias("c"))
    binned = df.join(F.broadcast(cuts), group).withColumn("own", F.size(F.filter("c", lambda x: x < F.col("predicted"))))  # a row a group
    rows = binned.withColumn("e", F.col("actual") - F.col("predicted")).withColumn("bin", F.explode(F.array("own", F.lit(-1))))
    q = files.once(ordered.quantiles(rows, "e", [group, "bin"], [0.1, 0.5, 0.9]), "residuals")
    whole = q.where("bin = -1").select(group, F.col("q").alias("wq"), F.col("total").alias("wn"))
    every = whole.join(cuts, group).withColumn("bin", F.explode(F.array(*map(F.lit, range(3)))))
    per = every.join(q.where("bin >= 0"), [group, "bin"], "left")
    enough = F.coalesce(F.col("total") >= least, F.lit(False))
    use = F.when(enough, F.col("q")).otherwise(F.col("wq"))
    inf = float("inf")
    low = F.when(F.col("bin") == 0, -inf).otherwise(F.get("c", F.col("bin") - 1))
    high = F.when(F.col("bin") == 2, inf).otherwise(F.get("c", F.col("bin")))
    rows = F.when(enough, F.col("total")).otherwise(F.col("wn"))
    return per.select(group, "bin", low.alias("low"), high.alias("high"), use[0].alias("p10"), use[1].alias("p50"), use[2].alias("p90"), rows.alias("n"))


def apply_intervals(df: DataFrame, bands: DataFrame, group: str = "position") -> DataFrame:
    """Attach low (at least 0) and high ends, null for rows in no band; bands are three rows a group."""
    b = F.broadcast(bands.select(F.col(group).alias("_group"), F.col("low").alias("_l"), F.col("high").alias("_h"), "p10", "p90"))
    inside = (F.col("_group") == F.col(group)) & (F.col("predicted") > F.col("_l")) & (F.col("predicted") <= F.col("_h"))
    got = df.join(b, inside, "left")
    low = F.when(F.col("p10").isNotNull(), F.greatest(F.col("predicted") + F.col("p10"), F.lit(0.0)))
    return got.select(*df.columns, low.alias("low"), (F.col("predicted") + F.col("p90")).alias("high"))


def tie_bottom(df: DataFrame, share: float, group: list[str] = GROUP) -> DataFrame:
    """Set the lowest round(share * n) forecasts of a group to its minimum."""
    w = Window.partitionBy(*group)
    n = F.row_number().over(w.orderBy("predicted", "entity"))
    cut = F.bround(share * F.count("*").over(w), 0)
    return df.withColumn("tied", F.when(n <= cut, F.min("predicted").over(w)).otherwise(F.col("predicted")))


def permuted(df: DataFrame, seeds: list[int], value: str = "actual", group: list[str] = GROUP) -> DataFrame:
    """df once a seed, with `permuted`: the value dealt anew within each group, by the order of a digest.

    The same for any partitioning. Places are taken by ranges, so a group may be of any size; df is read twice.
    """
    copies = df.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    by = ["seed", *group]
    own = ordered.row_numbers(copies, "_i", by, F.col("entity"))
    digest = F.md5(F.concat_ws(":", "seed", "entity").cast("binary"))
    dealt = ordered.row_numbers(copies.select(*by, "entity", F.col(value).alias("permuted")), "_i", by, digest, F.col("entity"))
    return own.join(dealt.drop("entity"), [*by, "_i"]).drop("_i")


def blend_ranks(weights: dict[str, float], group: list[str]) -> Column:
    """Weighted sum of rank shares within a group; the weights must sum to 1."""
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must sum to 1")
    return sum((ranking.rank_pct(F.col(c), group) * w for c, w in weights.items()), F.lit(0.0))
