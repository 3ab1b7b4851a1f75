import pathlib
import re

from pyspark.sql import functions as F

from tidewell.operators import bootstrap


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_draws_take_no_job_for_each_range(spark):
    rows = spark.range(4000).select(
        F.lit(2000).alias("season"), F.lit("QB").alias("position"), F.col("id").alias("entity"), (F.col("id") % 97).cast("double").alias("actual"),
        (F.col("id") % 89).cast("double").alias("predicted"), (F.col("id") % 2).cast("int").alias("label"),
    )
    rows = bootstrap.weighted(rows, 8).repartition(24).persist()
    rows.count()
    for name, run in (("mae", lambda: bootstrap.draw_mae(rows, 8)), ("auc", lambda: bootstrap.draw_auc(rows, 8, score="predicted")), ("rank", lambda: bootstrap.draw_spearman(rows, 8))):
        got, jobs = _jobs(spark, name, lambda run=run: run().count())
        assert got == 8 and jobs <= 16, (name, jobs)
    assert _jobs(spark, "mae_alone", lambda: bootstrap.draw_mae(rows, 8))[1] <= 2


def test_counts_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, once = {}, bootstrap.files.once

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return once(df, name)

    monkeypatch.setattr(bootstrap.files, "once", seen)
    ids = [*range(40), *range(40), None]
    rows = bootstrap.weighted(spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "entity int, k int"), 8)
    assert "Broadcast" not in plans["weighted"]
    got = rows.collect()
    assert sorted(r.k for r in got) == list(range(80)) and len({(r.entity, bytes(r.w)) for r in got}) == 40


def test_places_are_dropped_after_use(spark):  # F5
    written = bootstrap.files.once(spark.range(1), "before").inputFiles()[0]
    folder = pathlib.Path(re.sub("^file:/+", "/", written)).parents[1]
    before = {*folder.iterdir()}
    rows = bootstrap.weighted(spark.range(50).selectExpr("1 as season", "'QB' as position", "id as entity", "double(id % 7) as actual", "double(id % 5) as predicted"), 4)
    assert bootstrap.draw_spearman(rows, 4).count() == 4
    kept = {p.name.split("-")[0] for p in {*folder.iterdir()} - before}
    assert "weighted" in kept and "places" not in kept
