import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewell.operators import gram, logistic, models


def _rows(n=300, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 2.0] + [0.0, 10.0, -3.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.3 * (x[:, 1] - 10))))).astype(float)
    return x, y


def _objective(b, z, y, w, c, share):
    at = b[0] + z @ b[1:]
    return w @ (np.logaddexp(0, at) - y * at) + (share * np.abs(b[1:]).sum() + (1 - share) / 2 * b[1:] @ b[1:]) / c


def test_a_logistic_model_predicts_after_an_observation(spark):
    rows = spark.createDataFrame([(1, float(i), float(i % 3 > 0)) for i in range(60)], "season int, a double, y double")
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 60
    fitted = models.fit(rows, "logit", ["a"])
    got = [r.predicted for r in models.predict(fitted, rows).orderBy("a").collect()]
    last, mean, sd = fitted.stages[-1], 29.5, np.std(np.arange(60.0), ddof=1)
    want = 1 / (1 + np.exp(-(last.coefficients[0] * (np.arange(60.0) - mean) / sd + last.intercept)))
    assert np.allclose(got, want, atol=1e-12)


def test_fits_are_the_least_of_their_objective(spark):
    x, y = _rows()
    since = np.arange(len(y)) % 2
    df = spark.createDataFrame([(v.tolist(), float(t), int(s)) for v, t, s in zip(x, y, since)], "features array<double>, y double, since int").repartition(3)
    penalties = [(1.0, 0.0), (0.05, 0.9)]
    fits, medians = logistic.fit(df, 2, penalties)
    rng = np.random.default_rng(5)
    for fold in range(2):
        mine = since <= fold
        mean, sd = x[mine].mean(0), x[mine].std(0)
        z, of = (x[mine] - mean) / sd, y[mine]
        w = np.where(of == 1, len(of) / (2 * of.sum()), len(of) / (2 * (len(of) - of.sum())))
        for v, (c, share) in enumerate(penalties):
            b = np.concatenate([[fits[fold, v, 0] + fits[fold, v, 1:] @ (mean - medians[fold])], fits[fold, v, 1:] * sd])
            least = _objective(b, z, of, w, c, share)
            for size in (1e-1, 1e-2, 1e-3, 1e-4):
                for _ in range(50):
                    assert _objective(b + size * rng.normal(size=4), z, of, w, c, share) >= least - 1e-9


def test_unknown_values_and_folds_of_one_class(spark):
    rows = [([1.0, None], 1.0, 0), ([2.0, 4.0], 1.0, 0), ([3.0, 5.0], 0.0, 1), ([0.0, None], 0.0, 1)]
    df = spark.createDataFrame(rows, "features array<double>, y double, since int").withColumn("fold", F.col("since"))
    fits, medians = logistic.fit(df, 2, [(1.0, 0.0)])
    got = gram.predict(df, {"logit": fits[:, 0]}, medians).withColumn("p", logistic.probability(F.col("predicted")))
    p = [r.p for r in got.orderBy("y", F.col("features")[0]).collect()]
    assert p[2:] == [1.0, 1.0] and all(0 < v < 1 for v in p[:2])


def test_calibrated_forests_predict_after_an_observation(spark):
    rows = spark.createDataFrame([(2000 + i % 3, i, float(i), float(i // 3 % 4 > 1)) for i in range(90)], "season int, entity int, a double, y double")
    seen = Observation()
    rows.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 90
    got = models.platt(rows.where("season < 2002"), rows.where("season = 2002"), "forest_class", ["a"]).collect()
    assert len(got) == 30 and all(0 <= r.predicted <= 1 for r in got)
