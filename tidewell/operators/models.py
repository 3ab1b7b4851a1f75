"""Model fitting with Spark MLlib: seasons walk forward, fits see earlier seasons only.

A frame has season, entity, position, the feature columns and y. Learners come from `learner`; every
pipeline imputes medians and standardises with what the training rows hold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import evaluation, logistic, ordered
from tidewell.sources import files

#: Learners and their settings, as data.
GRID = {
    "forest": {"trees": 20, "depth": 8, "leaf": 5, "columns": "0.7"},
    "boosting": {"rounds": 10, "depth": 4, "step": 0.1},
    "ridge": {"alpha": 10.0},
    "logit": {"c": 1.0, "l1": 0.0},
    "sparse_logit": {"c": 0.05, "l1": 0.9},
    "forest_class": {"trees": 20, "depth": 8, "leaf": 5, "columns": "0.7"},
    "boosting_class": {"rounds": 10, "depth": 4, "step": 0.1},
}


def learner(name: str, rows: int, seed: int = 7):
    """The estimator of a grid entry; classifiers weigh rows by `weight`. `rows` turns C and alpha into Spark's penalty."""
    s = GRID[name]
    at = {"featuresCol": "scaled", "labelCol": "y"}
    if name == "forest":
        return RandomForestRegressor(numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["leaf"], featureSubsetStrategy=s["columns"], bootstrap=False, seed=seed, **at)
    if name == "boosting":
        return GBTRegressor(maxIter=s["rounds"], maxDepth=s["depth"], stepSize=s["step"], seed=seed, **at)
    if name == "ridge":
        return LinearRegression(regParam=s["alpha"] / max(rows, 1), elasticNetParam=0.0, **at)
    if name in ("logit", "sparse_logit"):
        return LogisticRegression(regParam=1 / (s["c"] * max(rows, 1)), elasticNetParam=s["l1"], weightCol="weight", **at)
    if name == "forest_class":
        return RandomForestClassifier(numTrees=s["trees"], maxDepth=s["depth"], minInstancesPerNode=s["leaf"], featureSubsetStrategy=s["columns"], weightCol="weight", seed=seed, **at)
    return GBTClassifier(maxIter=s["rounds"], maxDepth=s["depth"], stepSize=s["step"], weightCol="weight", seed=seed, **at)


def prepared(features: list[str]) -> list:
    """Median imputation, one vector, unit variance: all fitted on training rows."""
    filled = [f"{f}__filled" for f in features]
    return [
        Imputer(strategy="median", inputCols=features, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="vector"),
        StandardScaler(inputCol="vector", outputCol="scaled", withMean=True),
    ]


def imputed_scaled(df: DataFrame, train: Column, features: list[str]) -> DataFrame:
    """df with unknown features as the exact median of the training rows, then centred and in units of their spread (0 for constants)."""
    long = df.where(train).unpivot([F.lit(0).alias("_k")], features, "feature", "x")
    medians = {r.feature: r.q[0] for r in ordered.quantiles(long, "x", ["feature"], [0.5]).collect()}  # a row a feature
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(float(medians.get(f, 0.0)))) for f in features})
    stats = filled.where(train).agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features])
    both = filled.crossJoin(F.broadcast(stats))  # one row
    return both.withColumns({f: F.coalesce(F.try_divide(F.col(f) - F.col(f"m_{f}"), F.col(f"s_{f}")), F.lit(0.0)) for f in features}).drop(*stats.columns)


def balanced(df: DataFrame) -> DataFrame:
    """Add weight: rows / (2 * rows of the class)."""
    counts = df.groupBy("y").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    both = counts.crossJoin(F.broadcast(total)).select("y", (F.col("_all") / (2 * F.col("_n"))).alias("weight"))  # a row a class
    return df.join(F.broadcast(both), "y")


def fit(train: DataFrame, name: str, features: list[str], seed: int = 7):
    """A fitted pipeline; training rows without a label are left out."""
    rows = train.where("y is not null")
    if name.endswith("logit") or name.endswith("class"):
        rows = balanced(rows)
    n = rows.count() if name in ("ridge", "logit", "sparse_logit") else 0
    return Pipeline(stages=[*prepared(features), learner(name, n, seed)]).fit(rows)


def predict(model, df: DataFrame) -> DataFrame:
    """df with `predicted`: the value, or the probability of class 1.

    A fitted classifier holds the session of its summary, which cannot go to tasks once an Observation was used: copies of models have no
    summary, and a logistic model, whose copy has one, goes as its coefficients.
    """
    last = model.stages[-1]
    if isinstance(last, LogisticRegressionModel):
        got = PipelineModel(model.stages[:-1]).transform(df)
        x = vector_to_array(last.getFeaturesCol())
        at = sum((x[i] * F.lit(float(c)) for i, c in enumerate(last.coefficients)), F.lit(float(last.intercept)))
        return got.select(*df.columns, logistic.probability(at).alias("predicted"))
    got = model.copy().transform(df)
    value = vector_to_array("probability")[1] if "probability" in got.columns else F.col("prediction")
    return got.select(*df.columns, value.alias("predicted"))


def walk_forward(df: DataFrame, seasons: list[int], run) -> DataFrame:
    """Each season predicted by run(earlier rows, its rows); every row of those seasons comes out once.

    Folds are few and declared, so the driver loops over them; fits and predictions are Spark jobs.
    """
    return reduce(DataFrame.unionByName, [run(df.where(F.col("season") < s), df.where(F.col("season") == s)) for s in seasons])


def forward(df: DataFrame, seasons: list[int], name: str, features: list[str]) -> DataFrame:
    return walk_forward(df, seasons, lambda before, now: predict(fit(before, name, features), now))


def by_position(df: DataFrame, seasons: list[int], name: str, features: list[str], positions: list[str]) -> DataFrame:
    """As `forward`, with a fit of its own for each of the declared positions."""
    return reduce(DataFrame.unionByName, [forward(df.where(F.col("position") == p), seasons, name, features) for p in positions])


def transformed(df: DataFrame, kind: str) -> DataFrame:
    """y as raw value, signed log, or share of rank within season and position (`hurdle`: of positive rows)."""
    group = ["season", "position"]
    if kind == "signed_log":
        return df.withColumn("y", fn.signed_log(F.col("y")))
    if kind in ("rank", "hurdle"):
        value = F.col("y") if kind == "rank" else F.when(F.col("y") > 0, F.col("y"))
        return ordered.rank_pct(df.withColumn("_value", value), "y_", "_value", group).withColumn("y", F.col("y_")).drop("_value", "y_")
    return df


def platt(before: DataFrame, now: DataFrame, name: str, features: list[str]) -> DataFrame:
    """A base fitted up to the season before the last known one, calibrated on that one by logistic regression."""
    final = before.agg(F.max("season")).first()[0]
    base = fit(before.where(F.col("season") < final), name, features)
    held = predict(base, before.where(F.col("season") == final)).withColumn("z", fn.logit(F.col("predicted")))
    slope, intercept = line(held)
    return predict(base, now).withColumn("predicted", logistic.probability(F.lit(slope) * fn.logit(F.col("predicted")) + F.lit(intercept)))


def line(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of y on z, without penalty."""
    got = LogisticRegression(featuresCol="v", labelCol="y", regParam=0.0, standardization=True).fit(VectorAssembler(inputCols=["z"], outputCol="v").transform(rows))
    return float(got.coefficients[0]), float(got.intercept)


def calibration(df: DataFrame) -> tuple[float, float]:
    """Intercept and slope of a logistic regression of label on the log-odds of p, without penalty."""
    slope, intercept = line(df.select(F.col("label").cast("double").alias("y"), fn.logit(F.col("p")).alias("z")))
    return intercept, slope


def shuffled(df: DataFrame, feature: str, keys: list[str], seed: int) -> DataFrame:
    """df with one column dealt anew, inside season and position, by the order of a hash."""
    group = ["season", "position"]
    rank = lambda *order: F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    own = df.withColumn("_i", rank(*keys))
    dealt = df.select(*group, F.col(feature).alias("_x"), rank(F.xxhash64(F.lit(seed), *keys), *keys).alias("_i"))
    return own.join(dealt, [*group, "_i"]).withColumn(feature, F.col("_x")).drop("_i", "_x")


def permutation_importance(model, df: DataFrame, features: list[str], metric, seed: int = 7) -> DataFrame:
    """(feature, drop): metric(predictions) less the same with the feature shuffled; metric gives a frame of one `metric`."""
    whole = metric(predict(model, df)).select(F.col("metric").alias("whole"))
    one = lambda f: metric(predict(model, shuffled(df, f, ["entity"], seed))).select(F.lit(f).alias("feature"), "metric")
    rows = reduce(DataFrame.unionByName, [one(f) for f in features])
    return rows.crossJoin(F.broadcast(whole)).select("feature", (F.col("whole") - F.col("metric")).alias("drop"))  # one row


def ablation(train: DataFrame, test: DataFrame, name: str, families: dict[str, list[str]], metric) -> DataFrame:
    """(family, drop): the metric with all features less the metric without the family's."""
    features = [f for fs in families.values() for f in fs]
    score = lambda use: metric(predict(fit(train, name, use), test))
    whole = score(features).select(F.col("metric").alias("whole"))
    rows = [score([f for f in features if f not in fs]).select(F.lit(k).alias("family"), "metric") for k, fs in families.items()]
    return reduce(DataFrame.unionByName, rows).crossJoin(F.broadcast(whole)).select("family", (F.col("whole") - F.col("metric")).alias("drop"))  # one row


def linear_importance(held: DataFrame, features: list[str], fits: np.ndarray, medians: np.ndarray, repeats: int, seed: int = 7) -> DataFrame:
    """(season, feature, importance): macro rank correlation less the same with a feature dealt anew over its season.

    held(season, position, entity, features, y, fold, predicted) are forecasts of the linear models `fits`, a row a fold.
    All columns and repeats are dealt in one pass, by ranges of a hash, and a forecast moves by its coefficient alone.
    """
    held = held.withColumnRenamed("y", "actual")
    keys = ["season", "feature", "repeat"]
    weight = F.array(*[F.array(*[F.lit(float(v)) for v in row[1:]]) for row in fits])
    middle = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in medians])
    copies = held.select("season", "position", "entity", "actual", "predicted", "fold", F.posexplode("features").alias("feature", "x"))
    copies = copies.withColumn("x", F.coalesce("x", middle[F.col("fold")][F.col("feature")])).withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    copies = files.once(copies, "copies")
    own = ordered.row_numbers(copies, "_i", keys, F.col("entity"))
    dealt = ordered.row_numbers(copies, "_i", keys, F.xxhash64(F.lit(seed), "season", "feature", "repeat", "entity"), F.col("entity"))
    moved = own.join(dealt.select(*keys, "_i", F.col("x").alias("_x")), [*keys, "_i"])
    shift = weight[F.col("fold")][F.col("feature")] * (F.col("_x") - F.col("x"))
    group = ["season", "position"]
    whole = evaluation.spearman(held, group).groupBy("season").agg(F.avg("spearman").alias("whole"))
    per = evaluation.spearman(files.once(moved.withColumn("predicted", F.col("predicted") + shift), "moved"), [*keys, "position"])
    each = per.groupBy("season", "feature").agg((F.sum("spearman") / F.count("*")).alias("left"))  # as many positions in each repeat
    names = F.array(*[F.lit(f) for f in features])
    got = each.join(F.broadcast(whole), "season")  # a row a season
    return got.select("season", names[F.col("feature")].alias("feature"), (F.col("whole") - F.col("left")).alias("importance"))


def boosted_importance(rows: DataFrame) -> np.ndarray:
    """Importance of each feature in the boosted classifier; rows(features, y)."""
    s = GRID["boosting_class"]
    vectors = rows.select(array_to_vector("features").alias("scaled"), "y")
    fitted = GBTClassifier(featuresCol="scaled", labelCol="y", maxIter=s["rounds"], maxDepth=s["depth"], stepSize=s["step"], seed=7).fit(vectors)
    return fitted.featureImportances.toArray()


def mutual_information(rows: DataFrame, bins: int = 8) -> DataFrame:
    """Information of y's class on a feature's quantile bin, from counts; rows (feature, x, y)."""
    edges = rows.groupBy("feature").agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 10_000).alias("e"))
    binned = rows.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("e", lambda e: e < F.col("x"))))  # a row a feature
    cell = binned.groupBy("feature", "bin", "y").agg(F.count("*").cast("double").alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    part = cell.select("feature", (F.col("n") / by() * F.log(F.col("n") * by() / (by("bin") * by("y")))).alias("i"))
    return part.groupBy("feature").agg(F.sum("i").alias("information"))
