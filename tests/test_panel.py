"""Hand-computed cases and invariants of the panel operators."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as fn
from tidewell.operators import evaluation, panel, ranking


def test_scores_of_a_receiver_and_a_kicker(spark):
    row = {"position": "WR", "passing_yards": 100, "passing_tds": 1, "rushing_yards": 50, "receptions": 4, "receiving_yards": 60, "fumbles_lost_total": 1}
    got = panel.score_games(spark.createDataFrame([row]), strict=False).first()
    assert (got.points_base, got.points_half, got.points_full, got.target) == (17.0, 19.0, 21.0, 21.0)
    kicker = {"position": "K", "receptions": 0, "pat_made": 3, "fg_made_30_39": 2, "fg_made_40_49": 1, "fg_made_50_59": 1, "fg_missed": 0}
    assert panel.score_games(spark.createDataFrame([kicker]), strict=False).first().target == 18.0
    with pytest.raises(ValueError):
        panel.score_games(spark.createDataFrame([row]), strict=True)


def test_lags_go_by_season_and_absent_is_zero(spark):
    s = spark.createDataFrame([(2000, 1, 5.0), (2002, 1, 7.0)], "season int, entity int, x double")
    got = {r.season: r for r in panel.lagged(s.select("season", "entity"), s, ["x"], range(1, 3)).collect()}
    assert (got[2002].lag1_x, got[2002].lag1_available, got[2002].lag2_x, got[2002].lag2_available) == (0.0, 0, 5.0, 1)


def test_later_seasons_do_not_change_lags(spark):
    rows = [(2000, 1, 5.0), (2001, 1, 7.0)]
    run = lambda extra: panel.lagged(spark.createDataFrame([(2001, 1)], "season int, entity int"), spark.createDataFrame(rows + extra, "season int, entity int, x double"), ["x"], range(1, 3)).collect()
    assert run([]) == run([(2005, 1, 99.0)])


def test_slope_counts_absent_weeks_as_zero(spark):
    g = spark.createDataFrame([(1, 1, 3, 6.0), (1, 2, 4, 0.0)], "season int, entity int, week int, v double")
    got = {r.entity: r for r in panel.trajectory(g, "v", late=2).collect()}
    assert got[1].late2_v == 6.0 and abs(got[1].weekly_slope_v - 0.6) < 1e-12 and got[1].late2_mean_delta_v == 3.0


def test_ties_share_their_mean_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 5.0), (4, None)], "k int, v double")
    got = {r.k: r.r for r in df.select("k", ranking.rank_avg(F.col("v"), []).alias("r")).collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0, 4: None}


def test_repeated_key_fails_the_join(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeated key"):
        panel.left_checked(left, right, ["k"]).collect()


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, "QB", 1, 1.0, 2.0), (1, "QB", 2, 1.0, 3.0)], "season int, position string, entity int, predicted double, actual double")
    assert evaluation.spearman(df).first().spearman == 0 and evaluation.kendall(df).first().kendall == 0


def test_permutation_keeps_each_group(spark):
    df = spark.range(40).select(F.lit(1).alias("season"), (F.col("id") % 2).cast("string").alias("position"), F.col("id").alias("entity"), F.col("id").cast("double").alias("actual"))
    a = evaluation.permuted(df, [3, 4]).orderBy("seed", "entity").collect()
    assert [r.permuted for r in a if r.seed == 3] != [r.permuted for r in a if r.seed == 4]
    a = [r for r in a if r.seed == 3]
    assert sorted(r.permuted for r in a if r.position == "0") == sorted(r.actual for r in a if r.position == "0")
    assert a == evaluation.permuted(df.repartition(1), [3]).orderBy("entity").collect()


def test_names_heights_and_reasons(spark):
    df = spark.createDataFrame([("Smith, José Jr.", "6-2", " Not  injury  related - Rest "), (None, "x", "Knee")], "n string, h string, r string")
    got = df.select(fn.normal_name(fn.flipped_name(F.col("n"))), fn.height_inches(F.col("h")), fn.physical(F.col("r"))).collect()
    assert tuple(got[0]) == ("josesmith", 74, False) and got[1][1] is None and got[1][2]


def test_names_beyond_latin_1_and_statuses(spark):
    df = spark.createDataFrame([("Dončić, Luka",), ("Šarić",), ("ﬁn Łuk",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(fn.normal_name(fn.flipped_name(F.col("n")))).collect()] == ["lukadoncic", "saric", "finuk", "", None]
    assert sorted(fn.STATUS_PRIORITY, key=fn.STATUS_PRIORITY.get) == ["ACT", "RES", "DEV", "E14", "SUS", "NWT", "CUT", "RET"]


def test_reference_points_and_profile(spark):
    row = {
        "position": "WR", "passing_yards": 100, "passing_tds": 1, "passing_interceptions": 1, "rushing_yards": 50, "rushing_tds": 1, "receptions": 5,
        "receiving_yards": 80, "receiving_tds": 1, "rushing_2pt_conversions": 1, "fumbles_lost_total": 0, "special_teams_tds": 2,
    }
    got = panel.score_games(spark.createDataFrame([row]), strict=False).first()
    base = 4 + 4 - 2 + 5 + 6 + 8 + 6 + 2 + 12
    assert (got.points_base, got.points_half, got.points_full) == (base, base + 2.5, base + 5)
    half = panel.score_games(spark.createDataFrame([row]), {"receptions": 2.0, "pat_made": 9.0}, strict=False).first()
    assert (half.points_half, half.points_full, half.kicking) == (base + 5, base + 10, 0)
    with pytest.raises(ValueError):
        panel.score_games(spark.createDataFrame([row]))


def test_reasons_that_are_not_physical(spark):
    reasons = ["Knee", "Illness", "COVID-19 list", "Not injury related - personal", "non injury", "Rested veteran", "coach's  decision", "Illness/Knee", " ", None]
    df = spark.createDataFrame([(r,) for r in reasons], "r string")
    assert [r[0] for r in df.select(fn.physical(F.col("r"))).collect()] == [True, False, False, False, False, False, False, True, False, False]


def test_mann_whitney_p(spark):
    from tidewell.operators import evidence

    x = [1.0, 2.0, 2.0, 3.0, 5.0, 4.0, 6.0, 6.0, 7.0, 9.0]
    rows = [(1, v, int(i >= 5)) for i, v in enumerate(x)] + [(2, 1.0, i % 2) for i in range(10)]
    got = {r.feature: r for r in evidence.association(spark.createDataFrame(rows, "feature int, x double, y int")).collect()}
    # u = 24 of 25, ties 2 * (8 - 2), z = (24 - 12.5 - 0.5) / sqrt(25 / 12 * (11 - 12 / 90))
    z = 11 / (25 / 12 * (11 - 12 / 90)) ** 0.5
    import math

    assert got[1].p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6) and got[2].p == 1.0


def test_payload_members_of_either_form(spark):
    from tidewell.sources import files

    df = spark.createDataFrame([(1, '{"t": "0", "m": {"id": 5}}'), (2, '{"t": "86400", "m": [{"id": 6}, {"id": 7}]}'), (3, '{"t": "1"}')], "k int, p string")
    got = files.exploded_member(df, "p", "m", "id bigint").select("k", "member.id", files.iso_utc(F.get_json_object("p", "$.t")).alias("at")).collect()
    assert [tuple(r) for r in got if r.id is not None] == [(1, 5, "1970-01-01T00:00:00+00:00"), (2, 6, "1970-01-02T00:00:00+00:00"), (2, 7, "1970-01-02T00:00:00+00:00")]


def test_lineage_violations(spark):
    rows = [("lag1_x", ["outcome.x"], [1]), ("x", ["outcome.x"], [0]), ("target_x", ["report.y"], [1])]
    got = {r.check: r.violations for r in panel.check_lineage(spark.createDataFrame(rows, "column string, sources array<string>, source_offsets array<int>")).collect()}
    assert got == {"outcome_offset": 1, "report_offset": 1, "forbidden_name": 1}


def test_queries_can_be_read():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("block", [1, 20, 10_000])
def test_kendall_equals_all_pairs(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(evaluation, "BLOCK", block)

    rng = random.Random(4)
    rows = [(2000, g, i, float(rng.randint(0, 9)), float(rng.randint(0, 60))) for g in ("a", "b") for i in range(150)]
    df = spark.createDataFrame(rows, "season int, position string, entity int, predicted double, actual double")
    sign = lambda x: (x > 0) - (x < 0)
    got = {r.position: r.kendall for r in evaluation.kendall(df).collect()}
    for g in ("a", "b"):
        own = [(p, a) for _, k, _, p, a in rows if k == g]
        pairs = [(own[i], own[j]) for i in range(150) for j in range(i)]
        s = sum(sign(x[0] - y[0]) * sign(x[1] - y[1]) for x, y in pairs)
        free = [sum(x[k] != y[k] for x, y in pairs) for k in (0, 1)]
        assert got[g] == pytest.approx(s / (free[0] * free[1]) ** 0.5)


def test_cohort_and_its_contract(spark):
    games = [(1999, 1, 3, "A", "QB", 1, "ACT"), (1999, 1, 9, "B", "QB", 2, "ACT"), (2000, 2, 1, "C", "K", 3, "RES"), (2000, 3, 1, "C", "K", 4, None)]
    rosters = spark.createDataFrame(games, "season int, entity int, week int, team string, position string, game int, status string")
    entrants = spark.createDataFrame([(2000, 9, "D", "QB")], "season int, entity int, team string, position string")
    outcomes = spark.createDataFrame([(2000, 1, 5.0)], "season int, entity int, outcome double")
    got = panel.build_cohort(rosters, entrants, outcomes, 2001, ["RES"])
    assert sorted((r.season, r.entity, r.team, r.origin, r.outcome) for r in got.collect()) == [(2000, 1, "B", "prior_roster", 5.0), (2000, 9, "D", "entrant", 0.0)]
    now = {r.entity: r for r in panel.build_cohort(rosters, entrants, outcomes, 2000, ["RES"]).collect()}
    assert (now[2].available, now[3].available, now[2].outcome) == (False, True, None) and set(now) == {2, 3}
    assert {r.violations for r in panel.check_cohort(got, 2001).collect()} == {0}
    late = got.withColumn("source_season", F.col("season"))
    assert {r.check: r.violations for r in panel.check_cohort(late, 2001).collect()}["prior_roster_is_older"] == 1


def test_report_history_counts_physical_fields_of_regular_weeks(spark):
    rows = [
        (2000, 1, 1, "REG", "Knee", "Ankle"), (2000, 1, 1, "reg", "Illness", "Hip"), (2000, 1, 2, "REG", None, " "),
        (2000, 1, 3, "POST", "Knee", None), (2000, 2, 1, "REG", "Coach's  decision", "COVID-19"), (2001, 1, 5, None, "Knee", "Knee"),
        (2001, 1, 6, "REG", "Head", None),
    ]
    reports = spark.createDataFrame(rows, "season int, entity long, week int, season_type string, first string, second string")
    got = panel.report_history(reports, ["first", "second"])
    assert sorted(map(tuple, got.collect())) == [(2000, 1, 1, 1, 3), (2001, 1, 1, 1, 1)]
    assert panel.report_history(reports.limit(0), ["first", "second"]).count() == 0
