"""Keeps daily digests of activity and the facts that follow from them: a batch job with a high-water mark.

    python -m jobs.rollup --source FILE --out DIR --config jobs/rollup.json

A run reads the events above the mark, finds the days that they fall on, late ones too, and makes
those days anew from all their events. Facts (the last value of each attribute of a user, its changes)
follow from the days' digests, for the buckets of users that were touched. Days are partitions of ``days`` (and
buckets within them), buckets of ``facts``. The mark is written last: a run that fails is
repeated on the same events and gives the same partitions.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, replace_partitions, written
from keepstone.operators.ordered import placed, previous

log = logging.getLogger("rollup")

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAYS = "user_id long, attribute string, n long, sessions long, changes long, first_value long, last_value long, first_at timestamp, last_at timestamp, day date, bucket int"
FACTS = "user_id long, attribute string, n long, changes long, sessions long, days long, value long, first_at timestamp, last_at timestamp, bucket int"
MARKS = "mark long, n long"


def mark_of(spark: SparkSession, out: str) -> int | None:
    """The largest event that a finished run has taken; None before the first."""
    d = written(spark, f"{out}/marks", MARKS)
    return None if d is None else d.agg(F.max("mark").alias("mark")).first()["mark"]


def digests(events: DataFrame, config: dict) -> DataFrame:
    """For each day, user and attribute (event type): events, sessions begun, changes of the value, its first and last.

    Events follow each other in one global order, cut into ranges, so a user with very many is no task's alone. A session begins
    with an event of that attribute that follows the user's last of it on that day by more than session_minutes, or has none before.
    """
    keys = ["day", "user_id", "attribute"]
    value = F.floor(F.col("value") / config["value_step"]).alias("v")
    rows = events.select(F.to_date("ts").alias("day"), "user_id", F.col("event_type").alias("attribute"), F.col("ts").alias("at"), "event_id", value)
    rows = previous(placed(rows, [*keys, "at", "event_id"]), [*keys, "at", "v"])
    same = F.coalesce(F.struct(*keys).eqNullSafe(F.struct(*[F.col(f"last.{k}").alias(k) for k in keys])), F.lit(False))
    gap = F.col("at").cast("double") - F.col("last.at").cast("double")
    starts = F.when(same & (gap <= 60 * config["session_minutes"]), 0).otherwise(1)
    changed = F.when(same & ~F.col("v").eqNullSafe(F.col("last.v")), 1).otherwise(0)
    order = F.struct("at", "event_id")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(starts.cast("long")).alias("sessions"), F.sum(changed.cast("long")).alias("changes"),
        F.min_by("v", order).alias("first_value"), F.max_by("v", order).alias("last_value"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    ).withColumn("bucket", F.pmod(F.coalesce("user_id", F.lit(0)), F.lit(config["buckets"])).cast("int"))


def facts_of(days: DataFrame) -> DataFrame:
    """For each user and attribute, from its days: the value that holds now and how often it has changed, between days too."""
    keys = ["user_id", "attribute"]
    d = previous(placed(days.select("bucket", *keys, "day", "n", "sessions", "changes", "first_value", "last_value", "first_at", "last_at"), ["bucket", *keys, "day"]), [*keys, "last_value"])
    same = F.coalesce(F.struct(*keys).eqNullSafe(F.struct(*[F.col(f"last.{k}").alias(k) for k in keys])), F.lit(False))
    over = F.when(same & ~F.col("first_value").eqNullSafe(F.col("last.last_value")), 1).otherwise(0)
    return d.groupBy("bucket", *keys).agg(
        F.sum("n").alias("n"), F.sum(F.col("changes") + over).alias("changes"), F.sum("sessions").alias("sessions"), F.count("*").alias("days"),
        F.max_by("last_value", "day").alias("value"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
    )


def run(spark: SparkSession, source: str, out: str, config: dict) -> dict[str, int]:
    """Bring the tables below ``out`` up to date with the events of ``source``; how much was read and written.

    Rows without an id or a time have no place in the order and are counted as skipped; null users and attributes are ones of their own.
    """
    every = spark.read.schema(EVENTS).parquet(source).where("event_id IS NOT NULL")
    mark = mark_of(spark, out)
    new = every if mark is None else every.where(F.col("event_id") > mark)
    seen = new.agg(F.max("event_id").alias("top"), F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("skipped")).first()
    if not seen["n"]:
        log.info("nothing above mark %s in %s", mark, source)
        return {"read": 0, "skipped": 0, "days": 0, "facts": 0}
    new = new.where((F.col("event_id") <= seen["top"]) & F.col("ts").isNotNull())
    touched = [r["day"] for r in new.select(F.to_date("ts").alias("day")).distinct().collect()]  # dates, not rows
    if touched:
        inside = every.where((F.col("event_id") <= seen["top"]) & (F.col("ts") >= F.lit(min(touched))) & (F.col("ts") < F.date_add(F.lit(max(touched)), 1)))
        day = F.to_date("ts")
        replace_partitions(digests(inside.where(day.isin(touched)), config), f"{out}/days", "day", "bucket")
    days = written(spark, f"{out}/days", DAYS)
    wrote = {"days": 0, "facts": 0}
    if days is not None and touched:
        buckets = [r["bucket"] for r in days.where(F.col("day").isin(touched)).select("bucket").distinct().collect()]  # config["buckets"] at most
        replace_partitions(facts_of(days.where(F.col("bucket").isin(buckets))), f"{out}/facts", "bucket")
        wrote = {"days": days.where(F.col("day").isin(touched)).count(), "facts": written(spark, f"{out}/facts", FACTS).where(F.col("bucket").isin(buckets)).count()}
    spark.range(1).select(F.lit(seen["top"]).cast("long").alias("mark"), F.lit(seen["n"]).cast("long").alias("n")).coalesce(1).write.mode("append").parquet(f"{out}/marks")
    log.info("read %d new events (%d without a time) of %d days above mark %s; wrote %d digests and %d facts to %s", seen["n"], seen["skipped"], len(touched), mark, wrote["days"], wrote["facts"], out)
    return {"read": seen["n"], "skipped": seen["skipped"], **wrote}


def tables(spark: SparkSession, out: str) -> DataFrame:
    """Digests and facts in one table: kind, day (null for facts), user_id, attribute, and their numbers."""
    shared = ["user_id", "attribute", "n", "sessions", "changes", "value", "first_at", "last_at"]
    empty = spark.createDataFrame([], DAYS)
    d = written(spark, f"{out}/days", DAYS)
    f = written(spark, f"{out}/facts", FACTS)
    d = (empty if d is None else d).withColumn("value", F.col("last_value")).select(F.lit("day").alias("kind"), "day", *shared)
    f = (spark.createDataFrame([], FACTS) if f is None else f).select(F.lit("fact").alias("kind"), F.lit(None).cast("date").alias("day"), *shared)
    return d.unionByName(f)


if __name__ == "__main__":
    main(run, __doc__.split("\n")[0], ["source", "out"])
