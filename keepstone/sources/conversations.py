"""Conversations as memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _line():
    return F.concat(F.lit("["), "role", F.lit("]: "), "text")


def turn_windows(turns: DataFrame, size: int = 4, stride: int = 2) -> DataFrame:
    """conv_id, start, chunk and turns: windows of ``size`` turns at every ``stride``-th, joined by line ends.

    Each turn is sent to the few windows that hold it, so no conversation is gathered whole.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("i", F.row_number().over(w) - 1).withColumn("line", _line())
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (size - 1)) / stride)).cast("int")
    t = t.withColumn("start", F.explode(F.transform(F.sequence(first, F.floor(F.col("i") / stride).cast("int")), lambda k: (k * stride).cast("long"))))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return t.groupBy("conv_id", "start").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("chunk"), F.count("*").alias("turns"))


def captured_calls(turns: DataFrame) -> DataFrame:
    """One memory for each call: its messages in order."""
    lines = F.array_sort(F.collect_list(F.struct("turn", _line().alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("content"))
