"""Compiled families against the single operators, and lineage from the plan."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import features, panel

VALUES = ["a", "b"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [(s, e, w, "XY"[(e + s) % 2], "QK"[e % 2], float((e * w + s) % 7), float((e + w) % 3)) for s in range(2000, 2005) for e in range(12) for w in range(1, 12, 1 + e % 3) if (e + s) % 5]
    weekly = spark.createDataFrame(rows, "season int, entity int, week int, team string, position string, a double, b double")
    seasons = weekly.groupBy("season", "entity").agg(*[F.sum(v).alias(v) for v in VALUES], F.max("team").alias("team"), F.max("position").alias("position"))
    out = []
    for name, df in (("weekly", weekly), ("seasons", seasons)):
        path = str(tmp_path_factory.mktemp(name) / "t")
        df.write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_families_equal_single_operators(tables):
    weekly, seasons = tables
    got = features.matrix(seasons, weekly, VALUES, {"a_per_b": ("a", "b")}, ["Q", "K"])
    rows = {(r.season, r.entity): r for r in got.collect()}
    assert len(rows) == seasons.count() and len(got.columns) == 2 + 6 + 3 + 3 + 6 + 3 + 3 + 7 + 1 + 2
    trend = {(r.season + 1, r.entity): r for r in panel.trajectory(weekly, "a").collect()}
    own = {(r.season, r.entity): r for r in seasons.collect()}
    for (s, e), r in rows.items():
        t = trend.get((s, e))
        assert (r.lag1_late6_a, r.lag1_slope_a, r.lag1_delta_a) == pytest.approx((t.late6_a, t.weekly_slope_a, t.late6_mean_delta_a) if t else (0, 0, 0))
        last = own.get((s - 1, e))
        assert (r.lag1_a, r.lag1_available) == ((last.a, 1) if last else (0, 0))
        mates = [k for k in own if k[0] == s and k != (s, e) and own[k].team == own[s, e].team and own[k].position == own[s, e].position]
        totals = [own[s - 1, k[1]].a if (s - 1, k[1]) in own else 0 for k in mates]
        assert (r.room_competitors, r.room_others_a, r.room_nonzero_a) == (len(mates), sum(totals), sum(x > 0 for x in totals))
        of = last.team if last else None
        assert r.prior_team_b == sum(v.b for k, v in own.items() if k[0] == s - 1 and v.team == of)
        assert r.team_changed == int(bool(last) and last.team != own[s, e].team)


def test_lineage_tells_how_old_each_source_is(tables):
    weekly, seasons = tables
    m = features.matrix(seasons, weekly, VALUES, {"a_per_b": ("a", "b")}, ["Q", "K"])
    found = features.plan_lineage(m)
    assert ("a", 2) in found["lag2_a"] and {k for n, k in found["lag2_a"] if n in VALUES} == {2}
    assert {("a", 3), ("b", 3)} <= found["lag3_a_per_b"]
    for c in ("lag1_slope_b", "team_b", "prior_team_b", "room_margin_b"):
        assert {k for n, k in found[c] if n == "b"} == {1}, c
    assert found["position_Q"] == {("position", 0)}


def test_a_column_of_the_target_season_is_caught_whatever_its_name(tables):
    weekly, seasons = tables
    m = features.matrix(seasons, weekly, VALUES, {}, ["Q", "K"])
    known = {"season", "entity", "team", "position"}
    assert features.plan_leaks(m, known).count() == 0
    same = seasons.select("season", "entity", (F.col("b") * 2).alias("lag1_clean_name"))
    late = seasons.select((F.col("season") - 1).alias("season"), "entity", F.col("a").alias("lag2_other"))
    bad = m.join(same, ["season", "entity"], "left").join(late, ["season", "entity"], "left")
    got = {(r.column, r.source, r.seasons_back) for r in features.plan_leaks(bad, known).collect()}
    assert got == {("lag1_clean_name", "b", 0), ("lag2_other", "a", -1)}
