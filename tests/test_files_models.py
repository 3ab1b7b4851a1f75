"""Round trips of the file sources and invariants of the model operators."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.operators import evaluation, models, panel
from tidewell.sources import files


def test_periods_come_from_the_path(spark, tmp_path):
    df = spark.createDataFrame([(1, 1999), (2, 2000), (3, 2000), (4, 2001)], "k int, season int")
    path = files.write_periods(df, str(tmp_path / "p"))
    got = files.with_period_of_path(files.read_periods(spark, path, 2000, 2001)).select("k", "path_season").collect()
    assert sorted(map(tuple, got)) == [(2, 2000), (3, 2000), (4, 2001)]


def test_conform_adds_absent_and_fails_on_required(spark):
    df = spark.createDataFrame([("1", "x")], "a string, extra string")
    assert files.conform(df, {"a": "int", "b": "double"}).first().asDict() == {"a": 1, "b": None}
    with pytest.raises(ValueError):
        files.conform(df, {"b": "double"}, ("b",))


def test_csv_round_trip_keeps_quotes_and_commas(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "k int, v string")
    got = files.read_csv(spark, files.write_csv(df, str(tmp_path / "c")), df.schema)
    assert sorted(map(tuple, got.collect())) == [(1, 'a,"b"'), (2, None)]


def test_manifest_is_the_hash_of_the_bytes(spark, tmp_path):
    (tmp_path / "x.parquet").write_bytes(b"abc")
    assert files.manifest(spark, str(tmp_path)).first().asDict() == {"name": "x.parquet", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}


def test_walk_forward_sees_earlier_seasons_only(spark):
    df = spark.range(40).select((F.col("id") % 4 + 2000).cast("int").alias("season"), F.col("id").alias("entity"))
    seen = models.walk_forward(df, [2002, 2003], lambda before, now: now.crossJoin(before.agg(F.max("season").alias("m"))))
    assert seen.where("m <> season - 1").count() == 0 and seen.count() == 20


def test_shuffled_keeps_the_values_of_a_group(spark):
    df = spark.range(30).select((F.col("id") % 2).alias("season"), F.lit("a").alias("position"), F.col("id").alias("entity"), (F.col("id") * 1.5).alias("x"))
    got = models.shuffled(df, "x", ["entity"], 3)
    assert sorted(map(tuple, got.select("season", "x").collect())) == sorted(map(tuple, df.select("season", "x").collect()))


def test_leaks_and_weights(spark):
    df = spark.createDataFrame([(2000, 1999), (2000, 2000)], "season int, source_season int")
    assert panel.leaks(df, 1).count() == 1
    with pytest.raises(ValueError):
        evaluation.blend_ranks({"a": 0.5}, [])


def test_fingerprints_in_chunks_equal_whole_files(spark, tmp_path):
    for name, size in (("a.bin", 0), ("b.bin", 5), ("sub/c.bin", 100_003)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(bytes(k % 251 for k in range(size)))
    got = {r.name: (r.bytes, r.sha256) for r in files.manifest(spark, str(tmp_path), "*.bin", chunk=1000).collect()}
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.bin") if p.stat().st_size}
    assert got == want


def test_a_write_is_observed_in_its_own_job(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, id) as v")
    got = files.observed(df, str(tmp_path / "out"), rows=F.count(F.lit(1)), gaps=F.count_if(F.col("v").isNull()), top=F.max("v"))
    assert got == {"rows": 1000, "gaps": 100, "top": 999} and spark.read.parquet(str(tmp_path / "out")).count() == 1000
