"""Positive-unlabelled learning: the risk and its prior by plain formulas, odd rows, held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import quality_model as Q
from tidewell.llm.common import fold, table


def test_the_fit_minimises_the_plain_risk(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i % 3 == 0), (rng.normal(0.7 * (i % 3 == 0 or i % 5 == 0), 1, Q.N_FEATURES)).astype("<f8").tobytes()) for i in range(3000)]
    df = spark.createDataFrame([(y, bytearray(x)) for y, x in rows], "y int, x binary")
    x, y = np.array([np.frombuffer(b, "<f8") for _, b in rows]), np.array([y for y, _ in rows])
    start = Q.QualityModel(x.mean(0), x.std(0), np.zeros(Q.N_FEATURES + 1), 0.2)
    model = Q.fit_nonnegative(df, start, ((y == 1).sum(), (y == 0).sum()))

    def risk(w):
        z, u = start.scaled(x[y == 1]) @ w, start.scaled(x[y == 0]) @ w
        negative = np.logaddexp(0, u).mean() - 0.2 * np.logaddexp(0, z).mean()
        return 0.2 * np.logaddexp(0, -z).mean() + max(0, negative) + Q.RIDGE / 2 * (w[:-1] ** 2).sum(), negative

    best, negative = risk(model.weights)
    assert negative >= 0 and best < risk(start.weights)[0]
    if negative > 1e-6:  # away from the bound no small step does better
        assert all(risk(model.weights + d)[0] > best - 1e-4 for d in rng.normal(0, 0.05, (50, Q.N_FEATURES + 1)))


def _local_sums(x, y):
    """Sums of one table in memory, in the place of Spark's."""
    return lambda rows, part: part(x, y)


@pytest.mark.parametrize("seed, prior, apart", [(1, 0.5, 2.0), (2, 0.7, 1.5), (3, 0.9, 1.0), (4, 0.6, 3.0)])
def test_at_the_bound_the_fit_reaches_the_least_risk(monkeypatch, seed, prior, apart):
    """Priors above the mixture's 0.4 press the negative part to 0; plain subgradient steps find no lower risk."""
    rng = np.random.default_rng(seed)
    n = 3000
    good = np.concatenate([np.ones(n // 3), rng.random(2 * n // 3) < 0.4])
    y = np.concatenate([np.ones(n // 3, int), np.zeros(2 * n // 3, int)])
    x = rng.normal(0, 1, (n, Q.N_FEATURES))
    x[:, :3] += apart * good[:, None]
    monkeypatch.setattr(Q, "_sums", _local_sums(x, y))
    start = Q.QualityModel(x.mean(0), x.std(0), np.zeros(Q.N_FEATURES + 1), prior)
    model = Q.fit_nonnegative(None, start, ((y == 1).sum(), (y == 0).sum()))
    pos, unl = start.scaled(x[y == 1]), start.scaled(x[y == 0])

    def risk(w):
        z, u = pos @ w, unl @ w
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, z).mean()
        grad = -prior * (Q.sigmoid(-z) @ pos) / len(pos)
        if negative > 0:
            grad = grad + (Q.sigmoid(u) @ unl) / len(unl) - prior * (Q.sigmoid(z) @ pos) / len(pos)
        held = np.append(np.full(Q.N_FEATURES, Q.RIDGE), 1e-9)
        return prior * np.logaddexp(0, -z).mean() + max(0, negative) + (held * w * w).sum() / 2, negative, grad + held * w

    reached, negative, _ = risk(model.weights)
    assert abs(negative) < 0.02  # the bound is met
    for w in (model.weights, start.weights):
        best = risk(w)[0]
        for i in range(4000):
            w = w - 0.5 / (1 + i) ** 0.5 * risk(w)[2]
            best = min(best, risk(w)[0])
        assert reached < best + 1e-3


@pytest.mark.parametrize("prior", [0.2, 0.6, 0.9])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(5)
    bins = lambda scores: np.bincount(np.minimum((scores * Q.BINS).astype(int), Q.BINS - 1), minlength=Q.BINS)
    good, n = rng.beta(6, 2, 20_000), 100_000
    mixed = np.where(rng.random(n) < prior, rng.beta(6, 2, n), rng.beta(1.5, 8, n))
    assert abs(Q.estimate_prior(bins(good), bins(mixed)) - prior) < 0.06


def test_odd_rows_and_tables(spark):
    texts = [None, "", " ", "x", "word " * 250_000, "same text", "same text", "### $$$ !!!", "| | |"]
    docs = spark.createDataFrame([(min(i, 7), t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("x", F.lit("x")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(5, 1), (5, 0), (6, None)], "doc_id long, quality int")
    featured = Q.featurize(docs)
    got = Q.score(featured, Q.fit(featured, labels, F.lit(True))).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id < 3}) == 1  # nothing but white space
    none = Q.fit(featured, labels.limit(0), F.lit(True))
    assert {r.score for r in Q.score(featured, none).collect()} == {0.5}
    assert Q.score(Q.featurize(docs.limit(0)), none).count() == 0


def test_held_out_labels(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    featured = Q.featurize(table(spark, "/root/testdata/sf0.01", "documents"))
    model = Q.fit(featured, labels, fold(F.col("doc_id"), 3) != 1)
    held = Q.score(featured, model).join(labels.where(fold(F.col("doc_id"), 3) == 1), "doc_id").select("score", "quality").collect()
    assert len(held) > 50 and sum((r.score >= 0.5) == (r.quality == 1) for r in held) >= 0.95 * len(held)
