"""The memory table: scans, statistics, change log and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions import scoring as S
from keepstone.functions import text as T


def list_memories(memories: DataFrame, limit: int | None = 50, offset: int = 0, source: str | None = None, tag: str | None = None, namespace: str | None = None, substring: bool = True) -> DataFrame:
    """Newest first. ``tag`` matches any part of the tags' JSON text, or with substring=False a whole tag."""
    d = memories
    if source is not None:
        d = d.where(F.col("source") == source)
    if namespace is not None:
        d = d.where(F.col("namespace") == namespace)
    if tag is not None:
        d = d.where(F.contains(F.to_json("tags"), F.lit(tag)) if substring else F.array_contains("tags", tag))
    d = d.orderBy(F.desc("created_at"), F.desc("id"))
    return d.offset(offset).limit(limit) if limit is not None else d


def between(memories: DataFrame, column: str, since: Column, until: Column) -> DataFrame:
    """Rows whose time lies in the closed interval, oldest first."""
    return memories.where(F.col(column).between(since, until)).orderBy(column, "id")


def store_stats(memories: DataFrame) -> DataFrame:
    """One row of totals; needs content, l1 (binary), original_tokens and compressed_tokens beside the usual columns."""
    size = F.length("l1")
    total, kept = F.sum("original_tokens"), F.sum("compressed_tokens")
    return memories.agg(
        F.count("*").alias("n"),
        F.sum(F.length("content") + size).alias("stored"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.avg(F.length("content") / F.greatest(size, F.lit(1))).alias("ratio"),
        total.alias("original_tokens"),
        kept.alias("compressed_tokens"),
        F.when(total > 0, F.round(1 - kept / total, 4)).otherwise(0.0).alias("savings"),
        (total - kept).alias("tokens_saved"),
    )


def current(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last change of each key, unless it is a deletion (op = 'delete')."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1 AND op <> 'delete'").drop("_r")


def versions(changes: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """History with version numbers from 1; each row is valid until the next."""
    w = Window.partitionBy(key).orderBy(order)
    return changes.withColumn("version", F.row_number().over(w)).withColumn("valid_until", F.lead("saved_at").over(w))


def as_of(versions: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """The latest version of each key that was saved at or before a time."""
    w = Window.partitionBy(key).orderBy(F.desc("saved_at"), F.desc("version"))
    return versions.where(F.col("saved_at") <= at).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snapshot(memories: DataFrame, versions: DataFrame, at: Column) -> DataFrame:
    """State of all memories created by a time: the content of the version then valid, else the present one, and a label which."""
    state = as_of(versions, at).select(F.col("id").alias("v_id"), F.col("version").alias("v"), F.col("content").alias("v_content"))
    history = versions.select(F.col("id").alias("h_id")).distinct()
    d = memories.where(F.col("created_at") <= at).join(state, F.col("id") == F.col("v_id"), "left").join(history, F.col("id") == F.col("h_id"), "left")
    label = F.when(F.col("v").isNotNull(), F.concat(F.lit("v"), F.col("v").cast("string"))).when(F.col("h_id").isNotNull(), "current").otherwise("current (no version history)")
    return d.select("id", F.coalesce("v_content", "content").alias("content"), label.alias("state"))


def forget(memories: DataFrame, gone: DataFrame) -> DataFrame:
    return memories.join(gone, "id", "left_anti")


def expired(memories: DataFrame, policy: dict, now: Column) -> DataFrame:
    """Memories past their retention, with ttl."""
    ttl = S.retention_days(policy, F.col("tags"), F.col("namespace"), F.col("memory_type"))
    d = memories.withColumn("ttl", ttl).where("ttl > 0")
    return d.where(now >= F.col("created_at") + F.make_dt_interval(days=F.col("ttl")))


def ingest(raw: DataFrame, now: Column) -> DataFrame:
    """The fast path of storing: first line as abstract, tokens by length, public text, type, staleness and topics; rows over 1,000,000 bytes go."""
    public = T.strip_private(F.col("content"))
    d = raw.where(F.octet_length("content") <= 1_000_000).withColumn("public", public)
    return d.select(
        *raw.columns,
        F.substring(F.element_at(F.split("public", "\n"), 1), 1, 200).alias("l3"),
        T.estimate_tokens(F.col("content")).alias("original_tokens"),
        T.memory_type(F.col("content")).alias("memory_type"),
        T.staleness_class(F.col("content")).alias("staleness"),
        T.topic_tags(F.col("content")).alias("auto_tags"),
        now.alias("created_at"),
    )


def budget_prefix(ranked: DataFrame, budget: int, tokens: str = "tokens", order: str = "rank", partition: list[str] | None = None, admit_first: bool = False) -> DataFrame:
    """Rows in order until one would exceed the budget; with admit_first the first always stays.

    Ranks begin at 1 and each row costs a token at least, so without ``partition`` no more than ``budget`` rows (and the first) are looked at.
    """
    ranked = ranked if partition else ranked.where(F.col(order) <= max(budget, 1))
    w = Window.partitionBy(*(partition or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = ranked.withColumn("_used", F.sum(tokens).over(w))
    fits = F.col("_used") <= budget
    if admit_first:
        fits = fits | (F.row_number().over(Window.partitionBy(*(partition or [])).orderBy(order)) == 1)
    return d.where(fits).drop("_used") if not admit_first else d.withColumn("_ok", fits).where("_ok").drop("_used", "_ok")


def budget_skip(ranked: DataFrame, budget: int, key: str, tokens: str = "tokens", order: str = "rank") -> DataFrame:
    """For each key the items in order, passing over those that don't fit: key and kept (orders)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).alias("t"))))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["t"] <= budget
        return F.struct((acc["used"] + F.when(fits, x["t"]).otherwise(0)).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(x["o"]))).otherwise(acc["kept"]).alias("kept"))

    return ranked.groupBy(key).agg(F.aggregate(items, start, step).alias("r")).select(key, "r.used", "r.kept")
