"""Session helpers: tables, the shared folder, Arrow batch limits, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that reach a Python worker at once. Rows hold whole texts, so few are taken.
ARROW_ROWS = 256
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small: the default of 10,000 rows is hundreds of MB of text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. A local one is made only where the session names none and all runs on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = found.get() if found.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        got = tempfile.mkdtemp(prefix="tabulith-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _made is not None:
        _made.append(path)
    return out


_made: list[str] | None = None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame) -> None:
    """Delete the table of stored() that nothing reads any more: what came of it is written."""
    if hasattr(df, "stored_at"):
        _delete(df.sparkSession, df.stored_at)


@contextmanager
def only(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the tables that are stored within, but for those that the caller adds to the list that it gets."""
    global _made
    outer, _made, keep = _made, [], []
    try:
        yield keep
    finally:
        for path in _made:
            if path not in keep:
                _delete(spark, path)
        _made = outer
        if outer is not None:
            outer += keep


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df: the files' bytes where nothing else is known."""
    return min(int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), 1 << 50)


def buckets(spark: SparkSession, entries: float, per_bucket: int) -> int:
    """How many hash buckets hold so many entries: a few for each shuffle partition at least."""
    return int(min(65_536, max(2 * partitions(spark), entries // per_bucket + 1)))


def released() -> None:
    """Give memory that nothing uses back to the system: workers outlive their tasks, and others run beside them."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_limits(df.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(batches)
        released()

    return df.mapInArrow(mapped, schema)
