"""Draws of entities against plain resampling."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewell.operators import bootstrap


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 240
    pdf = pd.DataFrame({"entity": rng.integers(0, 90, n), "season": rng.integers(0, 2, n), "position": rng.choice(["a", "b"], n), "actual": rng.integers(0, 30, n).astype(float)})
    pdf["predicted"] = pdf["actual"] + rng.integers(-12, 12, n)
    pdf["p"], pdf["label"] = rng.integers(0, 20, n) / 20, rng.integers(0, 2, n)
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 5000])
def test_every_draw_takes_n(n):
    got = np.concatenate([bootstrap.counts(n, k, 30, 7) for k in range(-(-n // bootstrap.SLICE))], axis=1)
    assert got.shape == (30, n) and (got.sum(1) == n).all()
    if n == 5000:  # counts are those of a multinomial: mean and variance 1
        assert abs(got.var() - 1) < 0.05 and abs(np.corrcoef(got)[np.triu_indices(30, 1)]).max() < 0.08


def repeated(pdf, w):
    return pdf.loc[np.repeat(pdf.index, w)]


def spearman(part):
    a, p = part["actual"].rank(), part["predicted"].rank()
    return 0.0 if a.nunique() < 2 or p.nunique() < 2 else np.corrcoef(a, p)[0, 1]


@pytest.mark.parametrize("ranges", ["4", "1"])
def test_statistics_equal_those_of_repeated_rows(spark, data, monkeypatch, ranges):
    pdf, df = data
    monkeypatch.setattr(bootstrap, "SLICE", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(ranges == "1").lower())
    try:
        rows = bootstrap.weighted(df, 12)
        rank, auc = bootstrap.draw_spearman(rows, 12).collect(), bootstrap.draw_auc(rows, 12).collect()
        mae = bootstrap.draw_mae(rows, 12).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = rows.toPandas()
    w = np.stack([np.frombuffer(x, np.uint8) for x in got["w"]])
    one = got.assign(k=range(len(got))).groupby("entity")["k"].first()
    assert (w[one.to_numpy()].sum(0) == pdf["entity"].nunique()).all()
    for k in range(12):
        again = repeated(got, w[:, k])
        assert rank[k].value == pytest.approx(np.mean([spearman(g) for _, g in again.groupby(["season", "position"])]))
        r, ones = again["p"].rank(), again["label"].sum()
        assert auc[k].value == pytest.approx((r[again["label"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(again) - ones)))
        assert mae[k].value == pytest.approx((again["actual"] - again["predicted"]).abs().mean())


def test_paired_gain_of_itself_is_none(data):
    rows = bootstrap.weighted(data[1], 8)
    one = bootstrap.draw_spearman(rows, 8)
    got = bootstrap.interval(bootstrap.paired(one, one)).first()
    assert (got.low, got.high, got.draws) == (0.0, 0.0, 8)


def test_rows_that_share_a_value_are_not_held(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"entity": np.arange(n), "season": 1, "position": rng.choice(["a", "b"], n), "actual": rng.choice([1.0, 2.0, 9.0], n), "predicted": rng.choice([0.0, 50.0], n), "label": rng.integers(0, 2, n)})
    monkeypatch.setattr(bootstrap, "ROWS", 64)
    monkeypatch.setattr(bootstrap, "LONG", 200)
    runs = bootstrap._runs([r for r in pa.Table.from_pandas(pdf.sort_values("actual")).to_batches(max_chunksize=500)], ["actual"], 64, 200)
    seen = [(t.num_rows, kind) for t, kind in runs]
    assert max(rows for rows, _ in seen) <= 200 + 64 and sum(rows for rows, _ in seen) == n and sum(kind == "end" for _, kind in seen) == 3
    rows = bootstrap.weighted(spark.createDataFrame(pdf), 6)
    rank, auc = bootstrap.draw_spearman(rows, 6).collect(), bootstrap.draw_auc(rows, 6, score="predicted").collect()
    got = rows.toPandas()
    w = np.stack([np.frombuffer(x, np.uint8) for x in got["w"]])
    for k in range(6):
        again = repeated(got, w[:, k])
        assert rank[k].value == pytest.approx(np.mean([spearman(g) for _, g in again.groupby(["season", "position"])]))
        r, ones = again["predicted"].rank(), again["label"].sum()
        assert auc[k].value == pytest.approx((r[again["label"] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(again) - ones)))
