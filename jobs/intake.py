"""Takes new documents into a store of memories: a stream over files that remembers what it has taken.

    python -m jobs.intake --source DIR --out DIR --checkpoint DIR --config jobs/intake.json

Each batch of new files is guarded, stripped of private parts, redacted, classified and summarised.
A text that the store already has becomes no second memory but a copy of the first. Four tables
are written below ``out``, by batch: memories (and by namespace), copies, rejected, and keys, which later batches are
looked up in. A batch that is repeated after a failure has the same files, number and result, and
takes the place of its own partitions. ``out`` and ``checkpoint`` belong together.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, replace_partitions, written
from keepstone.functions import text as T
from keepstone.operators.summaries import summaries

log = logging.getLogger("intake")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
KEYS = "key string, memory_id long, file string, row long, batch long"
MEMORIES = "memory_id long, content string, source string, abstract string, facts array<string>, tags array<string>, memory_type string, staleness string, n_tokens int, n_marks int, key string, namespace string, batch long"
COPIES = "doc_id long, memory_id long, batch long"
REJECTED = "doc_id long, reason string, batch long"


def guarded(docs: DataFrame, config: dict) -> DataFrame:
    """docs with content (private parts taken out), its key, and the reason for which it isn't taken, if there is one."""
    content = T.strip_private(F.col("text"))
    short = F.coalesce(F.length(content) < config["shortest"], F.lit(True))
    reason = F.when(F.col("doc_id").isNull(), "no id").when(short, "short").when(F.octet_length(content) > config["largest_bytes"], "large")
    return docs.select("doc_id", "lang", "source", "file", "row", content.alias("content"), reason.alias("reason")).withColumn("key", F.sha2(F.col("content").cast("binary"), 256))


def enriched(rows: DataFrame, config: dict) -> DataFrame:
    """Memories from (memory_id, content, lang, source, key): redacted, summarised and classified."""
    content = T.redact_sensitive(F.col("content")) if config["redact"] else F.col("content")
    m = rows.withColumn("content", content)
    s = summaries(m.select(F.struct("memory_id", "lang", "source", "key").alias("id"), F.col("content").alias("text")), keep_text=True)
    return s.select(
        "id.memory_id",
        F.col("text").alias("content"),
        "id.source",
        F.col("l3").alias("abstract"),
        F.col("l2").alias("facts"),
        T.topic_tags(F.col("text")).alias("tags"),
        T.memory_type(F.col("text")).alias("memory_type"),
        T.staleness_class(F.col("text")).alias("staleness"),
        T.estimate_tokens(F.col("text")).alias("n_tokens"),
        F.regexp_count("text", F.lit(r"_REDACTED\]")).alias("n_marks"),
        "id.key",
        F.col("id.lang").alias("namespace"),
    )


def take(batch: DataFrame, number: int, out: str, config: dict) -> dict[str, int]:
    """Bring one batch of documents (with file and row, their place) into the store; how many rows went where.

    Equal texts of a batch: the smallest id is the memory, the first row of repeated ones. All but the text itself
    is narrow in the joins; rows are found again by their place, so no group of copies meets in one task.
    """
    spark = batch.sparkSession
    rows = guarded(batch, config)
    tag = F.lit(number).cast("long").alias("batch")
    replace_partitions(rows.where("reason IS NOT NULL").select("doc_id", "reason", tag), f"{out}/rejected", "batch")

    good = rows.where("reason IS NULL")
    first = F.min(F.struct("doc_id", "file", "row"))
    new = good.groupBy("key").agg(first.alias("f")).select("key", F.col("f.doc_id").alias("memory_id"), "f.file", "f.row")
    known = written(spark, f"{out}/keys", KEYS)
    if known is not None:  # a repeated batch doesn't see itself
        new = new.join(known.where(F.col("batch") < number).select("key"), "key", "left_anti")
    replace_partitions(new.select("*", tag), f"{out}/keys", "batch")
    keys = written(spark, f"{out}/keys", KEYS)
    if keys is not None:
        mine = keys.where(F.col("batch") == number)
        stored = good.drop("key").join(mine.select("key", "memory_id", "file", "row"), ["file", "row"])
        replace_partitions(enriched(stored, config).select("*", tag), f"{out}/memories", "batch", "namespace")
        places = keys.where(F.col("batch") <= number).withColumnRenamed("file", "at_file").withColumnRenamed("row", "at_row").withColumnRenamed("batch", "since")
        same = (F.col("file") == F.col("at_file")) & (F.col("row") == F.col("at_row")) & (F.col("since") == number)
        copies = good.select("doc_id", "key", "file", "row").join(places, "key").where(~same)
        replace_partitions(copies.select("doc_id", "memory_id", tag), f"{out}/copies", "batch")
    found = {}
    for name, schema in (("memories", MEMORIES), ("copies", COPIES), ("rejected", REJECTED)):
        d = written(spark, f"{out}/{name}", schema)
        found[name] = 0 if d is None else d.where(F.col("batch") == number).count()
    log.info("batch %d: read %d documents; wrote %d memories, %d copies, %d rejected to %s", number, sum(found.values()), *found.values(), out)
    return found


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Take what is new in the Parquet files of ``source``; how many rows this run has put where."""
    total = {"batches": 0, "memories": 0, "copies": 0, "rejected": 0}

    def each(batch: DataFrame, number: int) -> None:
        for name, n in take(batch, number, out, config).items():
            total[name] += n
        total["batches"] += 1

    docs = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    placed = docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    query = placed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("took %s from %s", total, source)
    return total


def store(spark: SparkSession, out: str) -> DataFrame:
    """What became of each document: doc_id, outcome (stored, copy or the reason why not), memory_id, and what the memory has."""
    parts = []
    kept = ["namespace", "source", "memory_type", "staleness", "n_tokens", "n_marks"]
    m = written(spark, f"{out}/memories", MEMORIES)
    if m is not None:
        parts.append(m.select(F.col("memory_id").alias("doc_id"), F.lit("stored").alias("outcome"), "memory_id", *kept, F.array_join("tags", ",").alias("tags"), F.size("facts").alias("n_facts"), F.length("content").alias("n_chars")))
    c = written(spark, f"{out}/copies", COPIES)
    if c is not None:
        parts.append(c.select("doc_id", F.lit("copy").alias("outcome"), "memory_id"))
    r = written(spark, f"{out}/rejected", REJECTED)
    if r is not None:
        parts.append(r.select("doc_id", F.col("reason").alias("outcome")))
    if not parts:
        return spark.createDataFrame([], "doc_id long, outcome string, memory_id long, namespace string, source string, memory_type string, staleness string, n_tokens int, n_marks int, tags string, n_facts int, n_chars int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


if __name__ == "__main__":
    main(run, __doc__.split("\n")[0], ["source", "out", "checkpoint"])
