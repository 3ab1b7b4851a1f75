"""Rounds of boosting are steps inside a job, and several tasks grow the trees of one."""

import numpy as np
import pytest

from tidewell.operators import boosting, together


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 20, (300, 2)).astype(float)
    rows = [(r.tolist(), float(r[0] - 2 * (r[1] > 9)), 1.0, i % 2) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "features array<double>, y double, weight double, since int").repartition(2).persist()


def test_jobs_do_not_grow_with_rounds(spark, df):
    sc, jobs = spark.sparkContext, []
    for rounds in (1, 12):
        sc.setJobGroup(f"rounds-{rounds}", "")
        boosting.fit(df, 2, rounds, 3, 0.3, 1.0, 8)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] < 11  # of 11 more rounds none is a job; Spark plans a few more or fewer around them


def test_several_tasks_grow_the_same_trees(df, monkeypatch):
    one = boosting.fit(df, 2, 4, 3, 0.3, 1.0, 8)
    monkeypatch.setattr(together, "ROWS", 100)
    assert together.tasks(df.sparkSession, 300) == 3
    three = boosting.fit(df, 2, 4, 3, 0.3, 1.0, 8)
    for a, b in zip(sum(one.trees, []), sum(three.trees, [])):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[4] == pytest.approx(b[4])
