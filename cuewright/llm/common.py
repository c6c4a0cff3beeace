"""Shared helpers of the training-data operators: staged tables, whitespace rules, checked broadcasts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: \x20 and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows up to which a side that grows with the input may be broadcast.
BROADCAST_ROWS = 200_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session within one process may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-stage-"))
    return _own_dir[0]


def arrow_limits(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes as well as rows, so long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(3 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def give_back() -> None:
    """Return memory that this worker has freed to the system: Arrow's pool, and the C library's heap where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """A batches' function for mapInArrow that gives memory back when it ends: workers wait for tasks of other stages."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: computed once, lineage cut, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_join(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged side, marked for broadcast if it has at most `rows` narrow rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def normalised(text):
    """Column: null as empty, every white-space run as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
