"""Queries that look at the seasons several times sum games once: what they read is the written table, not lines again."""

import pytest

from tidewell.operators import evaluation, panel
from tidewell.plans import fixtures as fx
from tidewell.plans import more_queries, panel_queries

SF = "/root/testdata/sf0.001"


def reads_lines(df) -> bool:
    return any("lineitem" in f for f in df.inputFiles())


def test_forecasts_read_written_seasons(spark):  # F22
    got = fx.forecasts(spark, SF)
    assert not reads_lines(got)
    s = {(r.season, r.entity): r.target for r in fx.season_points(spark, SF).collect()}
    rows = {(r.season, r.entity): (r.predicted, r.actual) for r in got.collect()}
    assert rows == {(y, e): (pytest.approx(s[y - 1, e], abs=1e-5), pytest.approx(v, abs=1e-5)) for (y, e), v in s.items() if (y - 1, e) in s}


def test_bands_come_from_one_table(spark, monkeypatch):  # F22
    seen = []
    plain = evaluation.residual_intervals
    monkeypatch.setattr(evaluation, "residual_intervals", lambda f: seen.append(f) or plain(f))
    panel_queries.ev_apply_intervals(spark, SF)
    assert "Join" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_parts_read_written_seasons(spark):  # F24
    got = more_queries._parts(spark, SF)
    assert not reads_lines(got)
    s = {(r.season, r.entity) for r in fx.season_points(spark, SF).collect()}
    assert got.count() == sum((y - 1, e) in s and (y - 2, e) in s for y, e in s)


def test_shuffled_targets_come_from_written_seasons(spark, monkeypatch):  # F16
    seen = []
    plain = panel.lagged
    monkeypatch.setattr(panel, "lagged", lambda a, b, *more: seen.append((a, b)) or plain(a, b, *more))
    panel_queries.ev_permute_null(spark, SF)
    assert seen and not any(reads_lines(df) for pair in seen for df in pair)


def test_adoption_sums_games_once(spark, monkeypatch):  # F4
    rows = [(y, e, "QB", 10.0 * e + 3.0 * ((y + e) % 4)) for y in range(2000, 2006) for e in range(12)]
    calls = []
    monkeypatch.setattr(fx, "season_points", lambda *a: calls.append(a) or spark.createDataFrame(rows, "season int, entity int, position string, target double"))
    got = more_queries.ev_adopt_interval(spark, SF).collect()
    assert len(calls) == 1
    assert len(got) == 1 and got[0].low <= got[0].mid <= got[0].high
