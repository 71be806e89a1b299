"""Habits in time-stamped memories: days, intervals, switches, trends, and what is likely to be asked next."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.operators.ordered import placed, previous

# Groups of keywords; fixed values.
TECH_GROUPS = {
    "frontend": ["react", "vue", "angular", "svelte", "nextjs", "css", "html", "tailwind"],
    "backend": ["django", "flask", "fastapi", "express", "rails", "spring", "node"],
    "language": ["python", "javascript", "typescript", "rust", "go", "java", "ruby", "c++"],
    "database": ["postgres", "mysql", "sqlite", "mongo", "redis", "dynamo"],
    "infra": ["docker", "kubernetes", "terraform", "aws", "gcp", "azure", "ci/cd"],
}


def weekday_habits(rows: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """tag, weekday (0: Monday), n, total of tags most of whose rows (ts, tags) fall on one day; ties to the earlier day."""
    t = rows.select(F.explode("tags").alias("tag"), F.weekday("ts").alias("weekday")).groupBy("tag", "weekday").agg(F.count("*").alias("n"))
    best = t.groupBy("tag").agg(F.sum("n").alias("total"), F.max_by(F.struct("weekday", "n"), F.struct("n", -F.col("weekday"))).alias("b"))
    return best.where((F.col("total") >= least) & (F.col("b.n") >= least) & (F.col("b.n") >= share * F.col("total"))).select("tag", "b.weekday", "b.n", "total")


def regular_intervals(rows: DataFrame, variation: float = 0.4, least_days: float = 2.0) -> DataFrame:
    """tag, mean_days and cv of tags that recur evenly: whole days between neighbours, zeros left out."""
    t = rows.select(F.explode("tags").alias("tag"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    d = previous(placed(t, ["tag", "t"]), ["tag", "t"])  # in one order over all tags, so that a frequent one isn't one task's
    gaps = d.withColumn("gap", F.when(F.col("tag") == F.col("last.tag"), F.floor((F.col("t") - F.col("last.t")) / 86_400_000_000)))
    s = gaps.groupBy("tag").agg(F.count("*").alias("n"), F.avg(F.when(F.col("gap") > 0, F.col("gap"))).alias("mean_days"), F.stddev_pop(F.when(F.col("gap") > 0, F.col("gap"))).alias("sd"))
    s = s.withColumn("cv", F.col("sd") / F.col("mean_days"))
    return s.where((F.col("n") >= 3) & (F.col("mean_days") >= least_days) & (F.col("cv") < variation)).select("tag", "mean_days", "cv")


def mentions(rows: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """ts, id, grp, pos, keyword for each keyword of a group that stands as a word in the text (id, ts, text)."""
    found: list[Column] = []
    for g, words in (groups or TECH_GROUPS).items():
        for i, w in enumerate(words):
            hit = F.lower("text").rlike(rf"(?U)\b{re.escape(w)}\b")
            found.append(F.when(hit, F.struct(F.lit(g).alias("grp"), F.lit(i).alias("pos"), F.lit(w).alias("keyword"))))
    return rows.select("id", "ts", F.explode(F.array_compact(F.array(*found))).alias("m")).select("id", "ts", "m.grp", "m.pos", "m.keyword")


def switches(mentioned: DataFrame) -> DataFrame:
    """grp, mentions, switches between neighbouring keywords in time, mean_gap in days between switches; two switches at least.

    Neighbours are found in one order over all partitions, so that a group's mentions needn't lie in one task.
    """
    rows = mentioned.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("grp", "us", "id", "pos", "keyword")
    d = previous(placed(rows, ["grp", "us", "id", "pos"]), ["grp", "keyword"])
    d = d.withColumn("sw", F.coalesce(((F.col("last.grp") == F.col("grp")) & (F.col("last.keyword") != F.col("keyword"))).cast("int"), F.lit(0)))
    n = d.groupBy("grp").agg(F.count("*").alias("mentions"), F.sum("sw").alias("switches"))
    at = previous(placed(d.where("sw = 1").select("grp", "us", "id", "pos"), ["grp", "us", "id", "pos"]), ["grp", "us"])
    gap = at.where(F.col("last.grp") == F.col("grp")).groupBy("grp").agg(F.avg(F.floor((F.col("us") - F.col("last.us")) / 86_400_000_000)).alias("mean_gap"))
    return n.where("mentions >= 4 AND switches >= 2").join(gap, "grp", "left")


def trends(mentioned: DataFrame, halves: DataFrame, least: int = 3, change: float = 0.4) -> DataFrame:
    """grp, keyword, early, recent, shift of keywords whose mentions move between the halves (id, late) of all rows."""
    d = mentioned.join(halves, "id").groupBy("grp", "keyword").agg(F.count_if(~F.col("late")).alias("early"), F.count_if("late").alias("recent"))
    d = d.withColumn("shift", (F.col("recent") - F.col("early")) / (F.col("recent") + F.col("early")))
    return d.where((F.col("early") + F.col("recent") >= least) & (F.abs("shift") >= change))


def halves(rows: DataFrame) -> DataFrame:
    """id and late: whether a row is in the later half by (ts, id)."""
    d = placed(rows.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")), ["t", "id"])
    return d.select("id", (F.col("place") >= rows.count() // 2).alias("late"))


def co_occurrence(topics: DataFrame, window: int = 5) -> DataFrame:
    """a, b, n: topics (session, seq, topic) that stand within ``window`` places of each other in a session."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(-(window - 1), -1)
    d = topics.withColumn("near", F.collect_list("topic").over(w)).select(F.col("topic").alias("a"), F.explode("near").alias("b")).where("a <> b")
    both = d.union(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("n"))


def transitions(topics: DataFrame) -> DataFrame:
    """a, b, n: topics that follow each other in a session."""
    w = Window.partitionBy("session").orderBy("seq")
    return topics.withColumn("b", F.lead("topic").over(w)).where("b IS NOT NULL AND b <> topic").groupBy(F.col("topic").alias("a"), "b").agg(F.count("*").alias("n"))


def predictions(topics: DataFrame, hour: int, last_topic: str, top: int = 5) -> DataFrame:
    """topic, confidence and reason of what is likely next: often near the last topic, usual at the hour, or following it."""
    near = co_occurrence(topics).where((F.col("a") == last_topic) & (F.col("n") >= 2)).orderBy(F.desc("n"), "b").limit(3).select(F.col("b").alias("topic"), F.least(F.col("n") / 10, F.lit(0.9)).alias("confidence"), F.lit("near").alias("reason"))
    usual = topics.where(F.hour("ts") == hour).groupBy("topic").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "topic").limit(3).select("topic", F.least(F.col("n") / 15, F.lit(0.7)).alias("confidence"), F.lit("hour").alias("reason"))
    after = transitions(topics).where((F.col("a") == last_topic) & (F.col("n") >= 2)).orderBy(F.desc("n"), "b").limit(5).select(F.col("b").alias("topic"), F.least(F.col("n") / 5, F.lit(0.8)).alias("confidence"), F.lit("after").alias("reason"))
    every = near.unionByName(usual).unionByName(after)
    best = every.groupBy("topic").agg(F.max("confidence").alias("confidence"), F.min_by("reason", F.expr("CASE reason WHEN 'near' THEN 1 WHEN 'hour' THEN 2 ELSE 3 END")).alias("reason"))
    return best.orderBy(F.desc("confidence"), "topic").limit(top)
