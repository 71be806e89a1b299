"""Streams with state over the supplied tables, run to their end, against SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.operators.store import scratch
from keepstone.plans.registry import query
from keepstone.session import table
from keepstone.streaming import state as S


def ran(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """What a stream has written when all of its input is read; with the number of its batch."""
    path = scratch(spark, name)
    with S.state_store(spark):
        q = out.writeStream.outputMode("append").option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True)
        q.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/{i}")).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(path)


def events(spark: SparkSession, sf: str) -> DataFrame:
    # a file, or a folder of that name; a pattern takes either
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/[e]vents.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "st1_ended_sessions",
    "WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM s), "
    "g AS (SELECT user_id, run AS no, count(*) AS n, sum(value) AS total, list(event_id ORDER BY ts DESC, event_id DESC)[1:3] AS newest, max(ts) AS last FROM r GROUP BY user_id, run) "
    "SELECT user_id, CAST(no AS BIGINT) AS no, n, round(total, 6) AS total, array_to_string(list_reverse(newest), ',') AS newest FROM g WHERE epoch_us(last) + 1800000000 < (SELECT epoch_us(max(ts)) FROM events) - 600000000",
)
def st1(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that end by timers; those that the watermark hasn't passed stay open."""
    d = ran(spark, S.ended_sessions(events(spark, sf)), "sessions")
    return d.select("user_id", "no", "n", F.round("total", 6).alias("total"), F.array_join(F.col("newest").cast("array<string>"), ",").alias("newest"))


@query(
    "st6_budgeted_cache",
    "WITH n AS (SELECT user_id AS client, event_type AS id, max(ts) AS ts, arg_max(1 + event_id % 50, (ts, 1 + event_id % 50)) AS tokens FROM events GROUP BY user_id, event_type), "
    "f AS (SELECT *, max(ts) OVER (PARTITION BY client) AS latest FROM n), "
    "u AS (SELECT *, sum(tokens) OVER w AS used, row_number() OVER w AS r FROM f WHERE ts >= latest - INTERVAL 3 DAY WINDOW w AS (PARTITION BY client ORDER BY ts DESC, id)) "
    "SELECT client, id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, tokens FROM u WHERE used <= 60 OR r = 1",
)
def st6(spark: SparkSession, sf: str) -> DataFrame:
    """What each user's cache of the last of each kind of event holds at the end: three days and 60 tokens."""
    results = events(spark, sf).select(F.col("user_id").alias("client"), F.col("event_type").alias("id"), "ts", (1 + F.col("event_id") % 50).alias("tokens"))
    d = ran(spark, S.budgeted_cache(results, 3 * 86_400, 60), "caches").where("what = 'kept'")
    last = d.groupBy("client").agg(F.max("batch").alias("batch"))
    return d.join(last, ["client", "batch"]).select("client", "id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "tokens")


@query("s24_assembled_calls", "SELECT conv_id || ':' || turn AS call, CAST(greatest(1, ceil(length(coalesce(text, '')) / 20.0)) AS BIGINT) AS pieces, md5(coalesce(text, '')) AS text_md5 FROM conversations")
def s24(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations cut into pieces of 20 characters, shuffled, some of them sent twice, come back whole."""
    c = table(spark, sf, "conversations").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("call"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 20)).cast("int")
    p = c.select("call", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    p = p.select("call", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")).alias("ts"), F.col("seq").cast("long").alias("seq"), F.substr("text", F.col("seq") * 20 + 1, F.lit(20)).alias("piece"), (F.col("seq") == F.col("n") - 1).alias("last"))
    p = p.unionByName(p.where("seq % 5 = 0"))  # repeats
    path = scratch(spark, "pieces")
    p.repartition(4, F.xxhash64("call", "seq", F.rand(5))).sortWithinPartitions(F.xxhash64("seq", "call")).write.parquet(path)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path)
    d = ran(spark, S.assembled(stream, 86_400, "1 day"), "calls")
    return d.where("whole").select("call", "pieces", F.md5("text").alias("text_md5"))
