"""Depth charts of both layouts: cutoffs, tiers, best rows, unknown ranks."""

from tidewell.operators import depth

DATED = "season int, at string, entity string, position string, rank string"
WEEKLY = "season int, week int, formation string, position string, entity string, rank string"


def rows(df):
    return sorted((r.season, r.entity, r.depth_rank, r.depth_tier) for r in df.collect())


def test_snapshots_go_by_the_last_time_in_time(spark):
    charts = [
        (2025, "2025-08-01 10:00:00", "old", "QB", "1"), (2025, "2025-08-09 23:59:59", "qb", "QB", "5"), (2025, "2025-08-09 23:59:59", "wr", "WR", "4"),
        (2025, "2025-08-09 23:59:59", "wr", "TE", "3"), (2025, "2025-08-09 23:59:59", "far", "WR", "12"), (2025, "2025-08-09 23:59:59", "none", "K", "x"),
        (2025, "2025-08-09 23:59:59", "none", "LS", "1"), (2025, "2025-08-09 23:59:59", None, "QB", "1"), (2025, "2025-08-10 00:00:00", "qb", "QB", "1"),
        (2025, "never", "bad", "QB", "1"), (2025, "2025-08-09 23:59:59", "two", "RB", None), (2025, "2025-08-09 23:59:59", "two", "PK", "2"),
        (2026, "2026-09-01 00:00:00", "late", "QB", "1"),
    ]
    got = rows(depth.dated(spark.createDataFrame(charts * 2, DATED), 8, 9))
    assert [x for x in got if x[1] != "none"] == [(2025, "far", 12.0, 3.0), (2025, "qb", 5.0, 3.0), (2025, "two", 2.0, 2.0), (2025, "wr", 4.0, 2.0)]
    assert [x for x in got if x[1] == "none"] == [(2025, "none", None, None)]


def test_weekly_charts_go_by_week_one_and_formation(spark):
    charts = [
        (2001, 1, "Offense", "WR", "a", "3"), (2001, 1, "Special Teams", "K", "a", "2"), (2001, 2, "Offense", "WR", "a", "1"), (2001, 1, "Defense", "WR", "a", "1"),
        (2001, 1, "Offense", "LS", "b", "1"), (2001, 1, "Offense", "WR", "c", "9"), (2002, 1, "Offense", "WR", "c", ""), (2001, None, "Offense", "WR", "d", "1"), (None, 1, "Offense", "WR", "d", "1"),
    ]
    assert rows(depth.weekly(spark.createDataFrame(charts, WEEKLY))) == [(2001, "a", 2.0, 2.0), (2001, "c", 9.0, 3.0), (2002, "c", None, None)]


def test_who_has_no_tier_is_in_the_lowest_of_a_position(spark):
    players = spark.createDataFrame([(2001, "a", "WR"), (2001, "z", "RB"), (2001, "y", "LS")], "season int, entity string, position string")
    charts = spark.createDataFrame([(2001, 1, "Offense", "WR", "a", "1")], WEEKLY)
    got = {r.entity: (r.depth_tier, r.depth_charted) for r in depth.with_tiers(players, depth.weekly(charts)).collect()}
    assert got == {"a": (1.0, True), "z": (3.0, False), "y": (None, False)}


def test_empty_charts(spark):
    assert depth.dated(spark.createDataFrame([], DATED), 8, 9).count() == depth.weekly(spark.createDataFrame([], WEEKLY)).count() == 0
