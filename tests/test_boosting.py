"""Histogram boosting against a plain version on the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import boosting


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).round(1)
    x[rng.random((300, 3)) < 0.05] = np.nan
    y = np.nan_to_num(x[:, 0]) * 2 + np.abs(np.nan_to_num(x[:, 1])) + rng.normal(size=300) * 0.2
    since = rng.integers(0, 2, 300)
    rows = [([None if np.isnan(v) else float(v) for v in r], float(t), 1.0, int(s)) for r, t, s in zip(x, y, since)]
    return x, y, since, spark.createDataFrame(rows, "features array<double>, y double, weight double, since int").repartition(3)


def plain(codes, y, rounds, depth, rate, penalty, leaf, loss, base):
    """Margins by growing each node from its rows alone."""
    margin = np.full(len(y), base)
    for _ in range(rounds):
        g, h = boosting.slopes(loss, margin, y, np.ones(len(y)))
        add = np.zeros(len(y))

        def grow(rows, level):
            hist = np.zeros((1, codes.shape[1], boosting.BINS, 3))
            for r in rows:
                for c in range(codes.shape[1]):
                    hist[0, c, codes[r, c]] += g[r], h[r], 1
            c, b, gain = (v[0] for v in boosting.best_splits(hist, penalty, leaf)) if level < depth and len(rows) >= 2 * leaf else (0, 0, -1)
            if gain <= 1e-12:
                if level:
                    add[rows] = -rate * g[rows].sum() / (h[rows].sum() + penalty)
                return
            low = codes[rows, c] <= b
            grow(rows[low], level + 1)
            grow(rows[~low], level + 1)

        grow(np.arange(len(y)), 0)
        margin = margin + add
    return margin


@pytest.mark.parametrize("loss, keep", [("squared", 20), ("squared", 2), ("log", 2)])
def test_equal_to_a_plain_version(data, monkeypatch, loss, keep):
    monkeypatch.setattr(boosting, "KEEP", keep)
    x, y, since, df = data
    df = df if loss == "squared" else df.withColumn("y", (F.col("y") > 1).cast("double"))
    y = y if loss == "squared" else (y > 1).astype(float)
    model = boosting.fit(df, 2, 5, 3, 0.3, 1.0, 8, loss)
    for fold in (0, 1):
        seen = since <= fold
        codes = boosting.coded(x[seen], model.edges[fold], model.medians[fold])
        base = y[seen].mean() if loss == "squared" else np.log(y[seen].mean() / (1 - y[seen].mean()))
        assert model.margins(x[seen], fold) == pytest.approx(plain(codes, y[seen], 5, 3, 0.3, 1.0, 8, loss, base), abs=1e-9)


def test_rounds_lower_the_error(data):
    x, y, since, df = data
    error = []
    for rounds in (1, 25):
        model = boosting.fit(df, 1, rounds, 4, 0.2, 3.0, 5)
        got = boosting.predict(df.withColumn("fold", F.lit(0)).where("since = 1"), model).collect()
        error.append(np.mean([abs(r.predicted - r.y) for r in got]))
    assert error[1] < 0.5 * error[0]


def test_no_rows_and_one_value(data):
    df = data[3]
    model = boosting.fit(df.selectExpr("array(1d) as features", "2d as y", "1d as weight", "since"), 2, 2, 3, 0.1, 1.0, 5)
    assert model.margins(np.ones((1, 1)), 1) == pytest.approx([2.0])
    assert boosting.fit(df.limit(0), 1, 1, 2, 0.1, 1.0, 5).base.tolist() == [0.0]
