"""The board from all its inputs: plain figures, coverage, dates, repeated and absent rows."""

import pytest

from tidewell.operators import board

PEOPLE = [(1, "QB", "A", True), (2, "QB", "B", True), (3, "QB", "A", True), (4, "K", "C", True), (5, "K", "C", False), (6, None, None, True)]
POINTS = [(1, 100.0), (2, 80.0), (3, 80.0), (4, 50.0), (5, 500.0), (6, 10.0), (7, 1.0)]
RISKS = [(1, 0.1), (2, 0.3), (3, 0.6), (4, 1.7), (5, 0.0), (6, 0.2)]
SCREEN = [(2, "Knee", "2001-12-31"), (2, "Ankle", "2001-12-31"), (9, "Hip", "1990-01-01")]


def build(spark, people=PEOPLE, points=POINTS, risks=RISKS, screen=SCREEN):
    make = spark.createDataFrame
    return board.assemble(
        make(people, "entity int, position string, team string, available boolean"), make(points, "entity int, points double"),
        make(risks, "entity int, risk double"), make(screen, "entity int, designation string, status_as_of string"), "2001-12-31",
    )


def test_figures_equal_plain_ones(spark):
    got = {r.entity: r for r in build(spark).collect()}
    assert set(got) == {1, 2, 3, 4, 6}  # 5 is not available and ranks nowhere
    assert [got[k].position_rank for k in (1, 2, 3, 4, 6)] == [1, 2, 2, 1, 1]
    assert [got[k].pct for k in (1, 2, 3, 4)] == pytest.approx([1, 0.5, 0.5, 1])
    assert [got[k].replacement for k in (1, 2, 3, 4, 6)] == [80.0, 80.0, 80.0, 50.0, 10.0]
    assert [got[k].vorp for k in (1, 2, 3)] == [20.0, 0.0, 0.0] and [got[k].overall_value for k in (1, 2)] == [1.0, 0.0]
    mean = (0.9 + 0.7 + 0.4) / 3
    assert got[1].relative_health == pytest.approx(0.9 - mean + 0.5) and got[1].draft_score == 98.0
    assert got[1].overall_score == pytest.approx(round(100 * (0.8 + 0.2 * (0.9 - mean + 0.5)), 2))
    assert (got[4].risk, got[4].health, got[4].risk_band, got[4].points_confidence) == (1.0, 0.0, "higher", "low (kicker)")
    assert [(got[k].listed, got[k].designation) for k in (1, 2)] == [(False, None), (True, "Ankle")]


@pytest.mark.parametrize("change", [
    {"points": POINTS[1:]}, {"risks": RISKS[:-1]}, {"points": [*POINTS, (1, 3.0)]}, {"people": [*PEOPLE, PEOPLE[0]]},
    {"points": [p for p in POINTS if p[0] != 5]}, {"screen": [(1, "Knee", "2001-11-30")]},
])
def test_what_is_not_covered_fails(spark, change):
    with pytest.raises(Exception, match="no forecast|repeated key|another date"):
        build(spark, **change).collect()


def test_many_starters_and_no_rows(spark):
    n = 40
    got = build(spark, [(i, "RB", "A", True) for i in range(n)], [(i, float(i)) for i in range(n)], [(i, 0.5) for i in range(n)], [(0, None, None)]).collect()
    assert {r.replacement for r in got} == {float(n - 24)} and sum(r.overall_value > 0 for r in got) == 23
    assert build(spark, people=[]).count() == 0
