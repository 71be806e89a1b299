"""What the jobs share: their configuration, log and command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def configuration(spark: SparkSession, path: str) -> dict:
    """The JSON object in a small file, which may be remote."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def written(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table that an earlier run wrote; None before the first."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows in the place of the partitions that they belong to; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(run: Callable[..., dict], text: str, paths: list[str]) -> None:
    """Command line of a job: its paths and its configuration are options. Creates the session and stops it."""
    args = argparse.ArgumentParser(description=text)
    for p in [*paths, "config"]:
        args.add_argument(f"--{p}", required=True, help="a path that Spark can read or write")
    given = vars(args.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.getOrCreate()
    try:
        run(spark, *[given[p] for p in paths], configuration(spark, given["config"]))
    finally:
        spark.stop()
