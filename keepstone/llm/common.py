"""What the corpus operators share: the shared folder, stashed tables, size checks, text handling."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch; bounds what a Python worker holds when texts are long.
ARROW_ROWS = 512


def setup(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


#: The temporary folder, once there is one.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="keepstone-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        found = _OWN[0]
    return found.rstrip("/")


#: Tables that this process has written and not yet deleted.
_WRITTEN: set[str] = set()


@atexit.register
def _delete_written() -> None:
    """At the end of the process nothing reads its intermediate tables any more."""
    context = SparkContext._active_spark_context
    with contextlib.suppress(Exception):  # the JVM may be gone before
        for path in _WRITTEN if context is not None else ():
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors.

    narrow: its rows are few and short beside the input, so a sixteenth of the shuffle partitions write it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if narrow:
        df = df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    _WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete a stashed table that nothing will read again."""
    path = getattr(df, "_stash_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _WRITTEN.discard(path)


def at_most(df: DataFrame, n: int) -> bool:
    """Whether a table has no more than n rows; reads n + 1 at most."""
    return df.limit(n + 1).count() <= n


def give_back() -> None:
    """Return freed memory to the system, so that a worker doesn't keep the most that it ever held."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def batches(stream: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has a bounded size (one row at least)."""
    for b in stream:
        if b.num_rows == 0:
            continue
        step = max(1, min(max_rows, b.num_rows * max_bytes // max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
    give_back()


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
