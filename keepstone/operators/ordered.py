"""Places and neighbours in one global order, without one task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.operators.store import stash


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with part, seq and place (from 0) in the order of ``by``, which should have no ties.

    Rows are partitioned by ranges and sorted within them; a place is a count within the
    partition plus the sizes of the earlier ones, of which there is one row each.
    """
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    d = stash(ordered.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    sizes = d.groupBy("part").agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    base = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    return d.join(F.broadcast(base), "part").withColumn("place", F.col("seq") + F.col("before")).drop("before")


def previous(rows: DataFrame, columns: list[str]) -> DataFrame:
    """placed() rows with ``last``: these columns of the row before in the order, null for the first."""
    x = F.struct(*columns)
    ends = rows.groupBy("part").agg(F.max_by(x, "seq").alias("end"))
    carried = ends.select("part", F.lag("end").over(Window.orderBy("part")).alias("carried"))  # a row for each partition
    within = Window.partitionBy("part").orderBy("seq")
    return rows.withColumn("last", F.lag(x).over(within)).join(F.broadcast(carried), "part").withColumn("last", F.coalesce("last", "carried")).drop("carried")


def nth_of_group(rows: DataFrame, group: str, by: list[str], which: Column) -> DataFrame:
    """The row of each group whose place in it (from 0, in the order of ``by``) is ``which``, an expression of its size ``n``."""
    d = placed(rows, [group, *by])
    sizes = d.groupBy(F.col(group).alias("_g")).agg(F.min("place").alias("_first"), F.count("*").alias("n"))
    wanted = sizes.select("_g", (F.col("_first") + which).cast("long").alias("_place"))
    return d.join(wanted, F.col("place") == F.col("_place")).where(F.col(group).eqNullSafe(F.col("_g"))).select(*rows.columns)
