"""Helpers that the operators of this subpackage share: table access, shared scratch tables, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Only a local session may lack it; such a session gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result as a table in the shared folder and read it back, which cuts its lineage.

    A lost executor then costs a re-read of the table, not a recomputation of what led to it.
    """
    path = f"{shared_dir(df.sparkSession)}/tidewell/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that materialize() wrote, once nothing that is still to run reads it."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k: the split between learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column of an Arrow batch as strings, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches, most: int = 4_000_000):
    """Cut Arrow batches so that no piece holds much over `most` bytes of its widest column.

    A few very long texts in a batch then don't multiply what a Python worker holds.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def without_collector(run):
    """run(batches) with Python's cycle collector off, for tables of very many small objects without cycles.

    It is on again when the task ends, as workers go on to other tasks.
    """

    def inner(batches):
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return inner


def quoted(name: str) -> Column:
    """The column of this very name, dots in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """`body(value)` with value computed once for a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]
