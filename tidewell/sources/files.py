"""File sources and sinks: yearly sets, declared columns, CSV, scoring profiles, manifests."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for a plan that uses it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a shared_path that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def conform(df: DataFrame, columns: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The declared columns and types in order; absent ones are null, an absent required one is an error."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """A master table with every column but its keys renamed by prefix."""
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def by_variant(frames: list[DataFrame], marker: str, new, old) -> DataFrame:
    """Union of frames of two layouts: those with the marker column go through `new`, the others through `old`."""
    out = None
    for df in frames:
        one = new(df) if marker in df.columns else old(df)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def write_periods(df: DataFrame, path: str, period: str = "season") -> str:
    """Parquet with a folder a period: rows go to the tasks of their period and a slice of it, so no period is one task."""
    df.repartition(period, F.pmod(F.xxhash64(*[c for c in df.columns if c != period]), F.lit(8))).write.partitionBy(period).parquet(path)
    return path


def read_periods(spark: SparkSession, path: str, first: int, last: int, period: str = "season") -> DataFrame:
    """Rows of periods first..last, the period taken from the folder's name; other folders are not read."""
    return spark.read.parquet(path).where(F.col(period).between(first, last))


def with_period_of_path(df: DataFrame, pattern: str = r"season=(\d+)", period: str = "path_season") -> DataFrame:
    """Add the period that the file's path names, null where it names none."""
    return df.withColumn(period, F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("")).cast("int"))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def exploded_member(df: DataFrame, payload: str, member: str, schema: str) -> DataFrame:
    """One row an object of a JSON member that is one object or an array of them; df's columns and `member`."""
    text = F.get_json_object(payload, f"$.{member}")
    one = f"struct<{_typed(schema)}>"
    rows = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    return df.withColumn("member", F.explode(rows))


def _typed(schema: str) -> str:
    """`a int, b long` as the fields of a struct type."""
    return ", ".join(":".join(field.split(None, 1)) for field in schema.split(", "))


def iso_utc(epoch: Column) -> Column:
    """Seconds since the epoch as an ISO 8601 time in UTC, whatever the session's time zone."""
    at = F.timestamp_seconds(epoch.cast("bigint"))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def load_profile(spark: SparkSession, path: str, fields: list[str]) -> dict[str, float]:
    """Coefficients of one JSON object; a missing or unknown-valued field is an error."""
    got = spark.read.option("multiLine", True).json(path).first().asDict()
    absent = [f for f in fields if got.get(f) is None]
    if absent:
        raise ValueError(f"the profile lacks {absent}")
    return {f: float(got[f]) for f in fields}


def manifest(spark: SparkSession, path: str, glob: str = "*.parquet", chunk: int = 1 << 20) -> DataFrame:
    """Name, bytes and SHA-256 of every file below a path that is not empty (Spark lists no empty ones).

    The listing reads no contents. Each file is then read in chunks inside a task, so that its size does not matter. Paths
    of a store that only Spark's own readers open are read whole, which takes files of under 2 GB.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    files = listed.select("path", name, F.col("length").alias("bytes"))
    first = files.select("path").first()
    if first is not None and opened(first.path) is None:
        return listed.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            digests = []
            for p in batch.column(0).to_pylist():
                store, at = opened(p)
                digest = hashlib.sha256()
                with store.open_input_stream(at) as stream:
                    while block := stream.read(chunk):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(digests, pa.string())], names=["name", "bytes", "sha256"])

    return files.mapInArrow(run, "name string, bytes long, sha256 string")


def opened(path: str):
    """The file system of a path and the path in it, None if only Spark's readers open it."""
    try:
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    except (pa.ArrowInvalid, OSError):
        return None


def observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write df as Parquet; the metrics (aggregates) are taken while its rows are written, in the same job."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
    return seen.get
