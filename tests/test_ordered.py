"""Ranks, places and order statistics by ranges against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import evaluation, evidence, ordered


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"id": range(n), "g": rng.choice(["a", "b", None], n, p=[0.8, 0.1, 0.1]), "v": rng.integers(0, 40, n).astype(float), "y": rng.integers(0, 2, n)})
    pdf.loc[rng.choice(n, 50, False), "v"] = np.nan
    rows = [(r.id, r.g, None if np.isnan(r.v) else r.v, r.y) for r in pdf.itertuples()]
    return pdf, spark.createDataFrame(rows, "id long, g string, v double, y long").repartition(6)


def test_ranks_equal_plain_ones_with_unknown_groups_and_values(table):
    pdf, df = table
    by = pdf.groupby("g", dropna=False)["v"]
    want = {
        "avg": by.rank(method="average"), "down": by.rank(method="average", ascending=False), "least": by.rank(method="min"),
        "share": by.rank(method="average", pct=True),
    }
    got = ordered.rank_avg(df, "avg", "v", ["g"])
    got = ordered.rank_avg(got, "down", "v", ["g"], descending=True)
    got = ordered.rank_pct(ordered.rank_min(got, "least", "v", ["g"]), "share", "v", ["g"]).toPandas().set_index("id").sort_index()
    for name, column in want.items():
        np.testing.assert_allclose(got[name].astype(float), column.to_numpy(), err_msg=name)
    assert len(got) == len(pdf)


def test_row_numbers_and_a_group_in_several_ranges(spark, table):
    pdf, df = table
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        named = df.where("g = 'a'").withColumn("_g", F.struct("g"))
        parts = named.repartitionByRange("_g", "v", "id").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts > 1  # no task holds the whole of group a
        got = ordered.row_numbers(df, "place", ["g"], F.desc_nulls_last("v"), F.col("id")).toPandas().set_index("id").sort_index()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = pdf.sort_values(["v", "id"], ascending=[False, True], na_position="last")
    want = (order.groupby("g", dropna=False).cumcount() + 1).sort_index()
    assert got["place"].tolist() == want.tolist()


def test_quantiles_are_exact(table):
    pdf, df = table
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.9, 1.0]
    got = {r.g: (r.q, r.total) for r in ordered.quantiles(df, "v", ["g"], shares).collect()}
    for name, part in pdf.groupby("g", dropna=False):
        q, total = got[None if pd.isna(name) else name]
        known = part["v"].dropna()
        np.testing.assert_allclose(q, np.quantile(known, shares))
        assert total == len(known)
    assert ordered.quantiles(df.limit(0), "v", ["g"], [0.5]).collect() == []


def test_association_takes_unknown_values_as_the_median(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 300)
    columns = {"signal": y * 2 + rng.integers(0, 4, 300), "noise": rng.normal(size=300), "same": np.ones(300)}
    rows = []
    for name, x in columns.items():
        x = x.astype(float)
        x[::7] = np.nan
        columns[name] = np.where(np.isnan(x), np.nanmedian(x), x)
        rows += [(name, None if i % 14 == 0 else float("nan") if i % 7 == 0 else float(v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    got = {r.feature: r for r in evidence.association(spark.createDataFrame(rows, "feature string, x double, y long")).collect()}
    for name, x in columns.items():
        r, rank = got[name], pd.Series(x).rank()
        n1, n0 = y.sum(), (1 - y).sum()
        auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
        assert r.auc == pytest.approx(auc) and r.mean_1 == pytest.approx(x[y == 1].mean())
        rho = 0.0 if name == "same" else np.corrcoef(rank, pd.Series(y).rank())[0, 1]
        assert r.spearman == pytest.approx(rho, abs=1e-12)
    assert got["same"].p == 1.0 and got["signal"].p < 1e-6 < got["noise"].p


def test_bands_keep_every_row_and_bin(spark):
    """Tied cuts leave a bin empty; unknown forecasts and positions stay, without ends."""
    rows = [(i, "A", 1.0 if i < 40 else float(i), float(i % 9)) for i in range(50)] + [(90, "A", None, 1.0), (91, "B", 3.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, position string, predicted double, actual double")
    bands = evaluation.residual_intervals(df.where("position = 'A' and predicted is not null"))
    got = {r.bin: r for r in bands.collect()}
    residuals = [a - p for _, g, p, a in rows if g == "A" and p is not None]
    assert sorted(got) == [0, 1, 2] and got[1].n == 50 and got[1].p10 == pytest.approx(np.quantile(residuals, 0.1))
    assert got[0].n == 40 and got[2].n == 50  # bin 2 has 10 rows of its own, bin 1 none
    ends = {r.id: (r.low, r.high) for r in evaluation.apply_intervals(df, bands).collect()}
    assert len(ends) == 52 and ends[90] == ends[91] == (None, None) and ends[49][1] == pytest.approx(49 + got[2].p90)
