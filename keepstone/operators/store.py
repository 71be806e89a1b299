"""Tables in the shared folder that jobs write and read again."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: The temporary folder, once there is one.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a temporary one in local mode, an error on a cluster."""
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


#: Tables that this process has written.
_WRITTEN: set[str] = set()


@atexit.register
def _delete_written() -> None:
    """At the end of the process nothing reads its intermediate tables any more."""
    context = SparkContext._active_spark_context
    with contextlib.suppress(Exception):  # the JVM may be gone before
        for path in _WRITTEN if context is not None else ():
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes at the end of the process."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table and read it again: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
