"""Intermediate tables that every executor can read.

They are Parquet folders below ``spark.checkpoint.dir``. Where the session names none, a
temporary folder of the driver stands in on a local master, and nothing does on a cluster.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a batch that Spark hands to a Python worker, where the session sets none.
BATCH_BYTES = 4 << 20


def root(spark: SparkSession) -> str:
    """The shared folder; the session's own setting always wins. A cluster must have one:
    executors there don't share the driver's disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="fluvion-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """Where this application's tables go; other applications may share the root."""
    return f"{root(spark)}/fluvion/{spark.sparkContext.applicationId}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return what reads it: lineage ends here, and a lost
    executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_all(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that still
    read one fail afterwards, so call it once these are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, and what an
    allocator keeps for itself counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def configure(spark: SparkSession) -> None:
    """Bound the bytes of batches that go to Python workers, unless the session has a bound.
    The setting belongs to the session and stays; operators call this themselves, since
    it must still hold when their result is computed."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def quoted(name: str) -> str:
    """A column's name as SQL and select take it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns ``names`` as c0, c1...: what an operator adds to them clashes with no name."""
    return df.select(*(F.col(quoted(c)) for c in names)).toDF(*(f"c{k}" for k in range(len(names))))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it none of the table's columns,
    in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes (see configure), whatever the rows' lengths."""
    configure(df.sparkSession)

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            trim()

    return df.mapInArrow(lambda batches: run(fed(batches)), schema)
