"""The enriched cohort against a plain version of its rules."""

from datetime import date

import pytest

from tidewell.operators import cohort

ROSTERS = [
    (1999, "a", 3, 1, "A", "QB", "ACT"), (1999, "a", 9, 2, "B", "qb", "ACT"), (1999, "b", 1, 3, "C", "LS", "ACT"), (1999, None, 1, 4, "C", "K", "ACT"),
    (2000, "a", 1, 5, "B", "QB", "ACT"), (2001, "a", 1, 6, "B", "QB", "RES"), (2001, "c", 1, 7, "D", "FB", None), (2001, "z", 2, 8, "D", "PK", "ACT"),
]
MEASURED = [
    (2000, "X1", "Cy", "Sy", "WR", None, "6-2", "201", 4.4, None), (2000, "X9", "No", "Sy", "TE", "E", "tall", "x", None, None), (2000, None, "Al Bo", "St. U", "WR", None, None, None, None, 7.0),
    (1998, "X0", "Ann", "Sy", "QB", "A", "5-11", "190", 4.9, None), (2001, "X0", "Ann", "Sy", "QB", "A", "5-10", "195", 4.1, None),
    (2000, None, None, None, "WR", None, None, None, None, None), (None, "X1", "Cy", "Sy", "WR", None, None, None, None, None),
]
DRAFT = [(2000, "X1", "Cy Young", "Sy", "WR", "F", 2.0, 40.0), (2000, "X0", "Ann", "Sy", "QB", "Q", 1.0, 1.0), (2000, "X5", "Punt", "Sy", "P", "F", 1.0, 2.0)]
PEOPLE = [
    ("a", "X0", "Ann", date(1970, 9, 1), None, 200.0, 1997, 2000, 3.0, 70.0), ("c", "X1", None, None, 70.0, None, None, None, None, None),
    ("d", "X1", "Double", None, None, None, None, None, None, None), ("a", "X0", "Aaa", None, None, None, None, None, None, None), (None, "X7", "Gone", None, None, None, None, None, None, None),
]
OUTCOMES = [(1999, "a", 8.0), (2000, "a", 5.0), (2001, "a", 3.0)]


def build(spark, current=2001, first=2000, last=None, rosters=ROSTERS, measured=MEASURED, draft=DRAFT, people=PEOPLE):
    make = spark.createDataFrame
    roster = make(rosters, "season int, entity string, week int, game long, team string, position string, status string")
    one = make(measured, "season int, code string, name string, school string, position string, team string, height_text string, weight_text string, forty double, draft_number double")
    for extra in ("bench", "vertical", "broad_jump", "cone", "shuttle"):
        one = one.selectExpr("*", f"cast(null as double) as {extra}")
    two = make(draft, "season int, code string, name string, school string, position string, team string, draft_round double, draft_number double")
    known = make(people, "entity string, code string, name string, birth date, height double, weight double, first_season int, draft_season int, draft_round double, draft_number double")
    return cohort.build(roster, [one, two], known, make(OUTCOMES, "season int, entity string, outcome double"), current, ["RES"], first, last)


def test_members_and_what_is_known_of_them(spark):
    got = {(r.season, r.entity): r for r in build(spark).collect()}
    assert set(got) == {(2000, "a"), (2000, "c"), (2000, "pfr:X9"), (2000, "prospect:2000:al-bo-st-u"), (2000, "prospect:2000:unknown"), (2001, "a"), (2001, "c"), (2001, "z")}
    a = got[2000, "a"]
    assert (a.origin, a.team, a.position, a.name, a.source_season) == ("prior_roster", "B", "QB", "Ann", 1999)  # the roster row, not the draft's
    assert a.age == pytest.approx(10958 / 365.2425) and (a.years_exp, a.is_rookie) == (3, 0)
    assert (a.height, a.weight, a.forty) == (71.0, 200.0, 4.9)  # measures of 1998: those of 2001 come later
    assert (a.draft_number, a.draft_round, a.was_drafted) == (70.0, 3.0, 1) and (a.outcome, a.previous_points) == (5.0, 8.0)
    c = got[2000, "c"]  # the smaller entity of a shared code; the row with a draft place comes first
    assert (c.name, c.team, c.forty, c.height, c.weight) == ("Cy Young", "F", 4.4, 70.0, 201.0)
    assert (c.draft_number, c.is_rookie, c.years_exp, c.age, c.outcome, c.previous_points) == (40.0, 1, 0, None, 0.0, 0.0)
    none = got[2000, "pfr:X9"]
    assert (none.height, none.weight, none.was_drafted, none.team) == (None, None, 0, "E")
    assert got[2000, "prospect:2000:al-bo-st-u"].draft_number == 7.0 and got[2000, "prospect:2000:unknown"].team == "UNK"


def test_the_current_season_is_its_roster_without_outcomes(spark):
    now = {r.entity: r for r in build(spark).where("season = 2001").collect()}
    assert {k: (r.available, r.status, r.origin, r.outcome) for k, r in now.items()} == {
        "a": (False, "RES", "current", None), "c": (True, None, "current", None), "z": (True, "ACT", "current", None),
    }
    assert (now["c"].position, now["z"].position, now["a"].forty, now["a"].previous_points) == ("RB", "K", 4.1, 5.0)
    assert now["z"].is_rookie == 0 and now["z"].years_exp is None


def test_a_draft_after_the_target_season_is_unknown(spark):
    later = [("a", "X0", "Ann", None, None, None, None, 2001, 3.0, 70.0)]
    got = {r.season: r for r in build(spark, people=later).where("entity = 'a'").collect()}
    assert (got[2000].draft_number, got[2000].was_drafted) == (None, 0) and (got[2001].draft_number, got[2001].was_drafted) == (70.0, 1)


def test_a_bounded_build_reads_no_later_season(spark):
    got = build(spark, last=2000)
    assert {(r.season, r.origin) for r in got.select("season", "origin").collect()} == {(2000, "prior_roster"), (2000, "entrant")}
    assert got.where("outcome is null").count() == 0
    late = [*ROSTERS, (2001, "a", 5, 9, "N", "TE", "ACT")]
    assert sorted(map(str, build(spark, last=2000, rosters=late).collect())) == sorted(map(str, got.collect()))
    with pytest.raises(ValueError):
        build(spark, first=2001)
    with pytest.raises(ValueError):
        build(spark, last=2002)


def test_keys_are_unique_and_the_audit_counts(spark):
    got = build(spark, rosters=ROSTERS * 2, measured=MEASURED * 2, draft=DRAFT * 2, people=PEOPLE * 2)
    assert got.count() == got.select("season", "entity").distinct().count() == 8
    assert sorted(map(tuple, cohort.audit(got).collect())) == [(2000, "entrant", 4, 4, 3), (2000, "prior_roster", 1, 0, 0), (2001, "current", 3, 0, 0)]


def test_empty_tables(spark):
    assert build(spark, rosters=[], measured=[], draft=[], people=[]).count() == 0
    alone = {r.entity for r in build(spark, measured=[], draft=[], people=[]).where("season = 2000").collect()}
    assert alone == {"a"}


def test_the_contract_counts_each_fault(spark):
    rows = [
        (2000, "a", "QB", "prior_roster", 1999, 1.0), (2000, "b", "QB", "entrant", 2000, 0.0), (2001, "c", "K", "current", 2001, None),
        (2000, "d", "QB", "prior_roster", 2000, 1.0), (2000, "e", "QB", "entrant", 1999, None), (2000, "f", "LS", "current", 2000, 0.0), (2001, "g", "K", "current", 2001, 2.0),
        (2000, "h", None, "prior_roster", None, 1.0),
    ]
    schema = "season int, entity string, position string, origin string, source_season int, outcome double"
    count = lambda rows: {r.check: r.violations for r in cohort.contract(spark.createDataFrame(rows, schema), 2001).collect()}
    assert set(count(rows[:3]).values()) == set(count([]).values()) == {0}
    assert count([*rows, *rows[:1] * 2]) == {
        "keys_are_unique": 3, "position_of_the_panel": 2, "current_outcome_is_unknown": 1, "earlier_outcome_is_known": 1,
        "prior_roster_is_older": 2, "entrants_are_of_the_season": 1, "current_is_current": 1,
    }
