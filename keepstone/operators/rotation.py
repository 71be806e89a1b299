"""Memories by month: archives, what becomes of old ones, and search over them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.operators import retrieval as R
from keepstone.operators import writing as W

#: Months from which archives are packed more tightly, and beyond which only abstracts are kept.
PACK_AFTER, KEEP = 3, 12


def age_in_months(month: str, now: date) -> int:
    year, m = map(int, month.split("_"))
    return (now.year - year) * 12 + now.month - m


def archive(memories: DataFrame, path: str) -> None:
    """Write memories by the month in which they were made; a month that is written again is replaced, others stay."""
    d = memories.withColumn("month", F.date_format("created_at", "yyyy_MM"))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """month, n, first and last of the archives below a folder."""
    return spark.read.parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def consolidated(month: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An archived month without the memories that summaries take the place of, and the summaries. vectors: id, embedding, namespace."""
    made, superseded = W.consolidate(month, W.similar_pairs(vectors, 0.80, ["namespace"]))
    return month.join(superseded.select("id"), "id", "left_anti"), made


def aged(memories: DataFrame, now: date, pack_after: int = PACK_AFTER, keep: int = KEEP) -> DataFrame:
    """Archived memories (with l3) as they are kept: state fresh, packed (as bytes) or pruned (the abstract only)."""
    from keepstone.sources.imports import compressed

    months = F.months_between(F.trunc(F.lit(now.isoformat()).cast("date"), "month"), F.trunc("created_at", "month"))
    d = memories.withColumn("state", F.when(months > keep, "pruned").when(months >= pack_after, "packed").otherwise("fresh"))
    whole = F.when(F.col("state") == "fresh", F.col("content"))
    return d.withColumn("packed", compressed(F.when(F.col("state") == "packed", F.col("content")))).withColumn("content", whole)


def search(spark: SparkSession, path: str, terms: list[str], limit: int = 10) -> DataFrame:
    """archive, id and score of the best memories over all archives; each archive ranks its own texts, by its own frequencies."""
    texts = spark.read.parquet(path).select(F.col("month").alias("archive"), "id", F.col("content").alias("text"))
    return R.bm25(texts, terms, by="archive").orderBy(F.desc("score"), "archive", "id").limit(limit)
