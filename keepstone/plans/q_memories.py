"""Scans, filters, statistics, versions, lifecycle and scores of memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import scoring as S
from keepstone.functions import text as T
from keepstone.operators import memories as M
from keepstone.operators.ordered import nth_of_group
from keepstone.plans.data import MEMORIES_SQL, NOW, memories, now, stamp, stamp_sql
from keepstone.plans.registry import query
from keepstone.session import table

_W = f"WITH {MEMORIES_SQL}"
_NOW = f"TIMESTAMP '{NOW}'"


@query("s1_point_lookup", _W + "SELECT id, namespace, md5(content) AS content_md5 FROM memories WHERE id = 42")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("id = 42").select("id", "namespace", F.md5("content").alias("content_md5"))


@query("s2_list", _W + f"SELECT id, source, {stamp_sql('created_at')} AS created FROM memories WHERE namespace = 'en' AND contains(to_json(tags), 'pin') ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 5")
def s2(spark: SparkSession, sf: str) -> DataFrame:
    return M.list_memories(memories(spark, sf), limit=20, offset=5, tag="pin", namespace="en").select("id", "source", stamp("created_at").alias("created"))


@query("s3_embeddings_scan", "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS dim FROM embeddings")
def s3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.size("embedding").alias("dim"))


@query("s4_live_embeddings", _W + "SELECT m.id, m.namespace FROM memories m JOIN embeddings e ON m.id = e.vec_id WHERE m.superseded_by IS NULL")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return memories(spark, sf).where("superseded_by IS NULL").join(e, "id").select("id", "namespace")


@query("s5_created_between", _W + f"SELECT id, {stamp_sql('created_at')} AS created FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'")
def s5(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda x: F.expr(f"timestamp_ntz'{x}'")
    return M.between(memories(spark, sf), "created_at", t("2024-01-05 00:00:00"), t("2024-01-15 00:00:00")).select("id", stamp("created_at").alias("created"))


@query("s6_deletions", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-10 00:00:00'")
def s6(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase' AND ts BETWEEN '2024-01-05 00:00:00' AND '2024-01-10 00:00:00'").select("event_id", "user_id")


@query("s7_audit", "SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 50")
def s7(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("user_id = 7").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("f1_any_tag", _W + "SELECT id FROM memories WHERE list_has_any(tags, ['t1', 'u3'])")
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.arrays_overlap("tags", F.array(F.lit("t1"), F.lit("u3")))).select("id")


@query("f2_tag_part", _W + "SELECT id FROM memories WHERE contains(to_json(tags), 'inn')")
def f2(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.contains(F.to_json("tags"), F.lit("inn"))).select("id")


@query("f3_namespaces", _W + "SELECT id, namespace FROM memories WHERE namespace IN ('de', 'fr')")
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.col("namespace").isin("de", "fr")).select("id", "namespace")


@query("f7_stale_age", _W + f"SELECT id FROM memories WHERE epoch({_NOW} - updated_at) / 86400.0 > 120")
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(S.days(now(), F.col("updated_at")) > 120).select("id")


_L1 = "memories_l1 AS (SELECT *, encode(content) AS l1, CAST(greatest(1, length(content) // 4) AS BIGINT) AS original_tokens, CAST(greatest(1, length(content) // 40) AS BIGINT) AS compressed_tokens FROM memories)"


@query(
    "a1_store_stats",
    _W + f", {_L1} SELECT count(*) AS n, CAST(sum(length(content) + octet_length(l1)) AS BIGINT) AS stored, {stamp_sql('min(created_at)')} AS oldest, {stamp_sql('max(created_at)')} AS newest, round(avg(length(content) / greatest(octet_length(l1), 1)), 9) AS ratio, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(compressed_tokens) AS BIGINT) AS compressed_tokens, round(1 - sum(compressed_tokens) / sum(original_tokens), 4) AS savings, CAST(sum(original_tokens) - sum(compressed_tokens) AS BIGINT) AS tokens_saved FROM memories_l1",
)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    d = memories(spark, sf).withColumn("l1", F.encode("content", "UTF-8")).withColumn("original_tokens", T.estimate_tokens(F.col("content")).cast("long"))
    d = d.withColumn("compressed_tokens", F.greatest(F.lit(1), F.floor(F.length("content") / 40)).cast("long"))
    return M.store_stats(d).withColumns({"oldest": stamp("oldest"), "newest": stamp("newest"), "ratio": F.round("ratio", 9)})


@query("a2_namespace_counts", _W + "SELECT namespace, count(*) AS n FROM memories GROUP BY namespace")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).groupBy("namespace").agg(F.count("*").alias("n"))


@query("a9_status_counts", _W + "SELECT memory_type, count(*) AS total, count(*) FILTER (superseded_by IS NULL) AS live, count(superseded_by) AS superseded FROM memories GROUP BY memory_type")
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).groupBy("memory_type").agg(F.count("*").alias("total"), F.count_if(F.col("superseded_by").isNull()).alias("live"), F.count("superseded_by").alias("superseded"))


@query("tk4_paging", _W + "SELECT id FROM memories ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 30")
def tk4(spark: SparkSession, sf: str) -> DataFrame:
    return M.list_memories(memories(spark, sf), limit=10, offset=30).select("id")


@query("tk6_top_tags", _W + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY tag ORDER BY n DESC, tag LIMIT 5")
def tk6(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(5)


@query("p13_stale_report", _W + f"""SELECT id, staleness, CAST(floor(epoch({_NOW} - updated_at) / 86400.0) AS BIGINT) AS age_days,
  CASE WHEN superseded_by IS NOT NULL THEN 'Superseded by ' || superseded_by
    WHEN staleness = 'volatile' AND epoch({_NOW} - updated_at) / 86400.0 > 30 THEN 'Volatile memory is ' || CAST(floor(epoch({_NOW} - updated_at) / 86400.0) AS BIGINT) || ' days old (threshold: 30d)'
    WHEN staleness = 'semi-stable' AND epoch({_NOW} - updated_at) / 86400.0 > 90 THEN 'Semi-stable memory is ' || CAST(floor(epoch({_NOW} - updated_at) / 86400.0) AS BIGINT) || ' days old (threshold: 90d)' END AS warning
  FROM memories QUALIFY warning IS NOT NULL""".replace("QUALIFY warning IS NOT NULL", "WHERE superseded_by IS NOT NULL OR (staleness = 'volatile' AND epoch(" + _NOW + " - updated_at) / 86400.0 > 30) OR (staleness = 'semi-stable' AND epoch(" + _NOW + " - updated_at) / 86400.0 > 90)"))
def p13(spark: SparkSession, sf: str) -> DataFrame:
    warning = S.staleness_warning(F.col("superseded_by"), F.col("staleness"), F.col("updated_at"), now())
    age = F.floor(S.days(now(), F.col("updated_at")))
    return memories(spark, sf).select("id", "staleness", age.alias("age_days"), warning.alias("warning")).where("warning IS NOT NULL")


@query("p15_access_stats", _W + f"SELECT id, access_count, {stamp_sql('last_accessed')} AS last_accessed FROM memories WHERE access_count > 0")
def p15(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where("access_count > 0").select("id", "access_count", stamp("last_accessed").alias("last_accessed"))


@query("p16_learn_from_others", _W + "SELECT id, source FROM memories WHERE list_contains(tags, 't2') AND namespace = 'en' AND source <> 'src0'")
def p16(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.array_contains("tags", "t2") & (F.col("namespace") == "en") & (F.col("source") != "src0")).select("id", "source")


@query("p19_pinned", _W + "SELECT id, priority FROM memories WHERE list_contains(tags, 'pinned')")
def p19(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.array_contains("tags", "pinned")).orderBy(F.desc("priority"), "id").select("id", "priority")


_AGE = f"greatest(epoch({_NOW} - created_at) / 86400.0, 0)"


@query("x20_adjusted_priority", _W + f"SELECT id, round(priority * pow(0.5, {_AGE} / 30.0) * (1 + ln(1 + access_count) / 10.0) * CASE WHEN last_accessed IS NULL THEN 1.0 ELSE 1 + 0.2 * pow(0.5, epoch({_NOW} - last_accessed) / 86400.0 / 7.0) END * (1 + 0.1 * tanh((id % 5) - 2)), 9) AS adjusted FROM memories")
def x20(spark: SparkSession, sf: str) -> DataFrame:
    p = S.adjusted_priority(F.col("priority"), F.col("created_at"), F.col("access_count"), F.col("last_accessed"), F.col("id") % 5 - 2, now())
    return memories(spark, sf).select("id", F.round(p, 9).alias("adjusted"))


_TIMES = """CASE WHEN last_accessed IS NULL THEN [epoch(created_at)]
  ELSE (CASE WHEN access_count > 1 AND last_accessed <> created_at THEN [epoch(created_at), epoch(last_accessed)] ELSE [epoch(created_at)] END)
    || (CASE WHEN access_count > 2 AND last_accessed <> created_at THEN list_transform(range(1, least(access_count - 1, 10)), lambda i: epoch(created_at) + i / (access_count - 1) * (epoch(last_accessed) - epoch(created_at))) ELSE [] END) END"""
_STRENGTH = f"ln(list_sum(list_transform({_TIMES}, lambda x: pow(CASE WHEN epoch({_NOW}) - x <= 0 THEN 1.0 ELSE epoch({_NOW}) - x END / 3600.0, -0.5))))"


@query("r13_activation", _W + f"SELECT id, round({_STRENGTH}, 8) AS strength, round(0.5 * (1 + 0.1 * greatest(0, {_STRENGTH})), 8) AS boosted FROM memories")
def r13(spark: SparkSession, sf: str) -> DataFrame:
    a = S.activation(F.col("created_at"), F.col("last_accessed"), F.col("access_count"), now())
    return memories(spark, sf).select("id", a.alias("a")).select("id", F.round("a", 8).alias("strength"), F.round(S.decay_boost(F.lit(0.5), F.col("a")), 8).alias("boosted"))


@query("r14_retrieval_probability", _W + f"SELECT id, round(least(1, greatest(0, exp(-(epoch({_NOW} - last_accessed) / 3600.0) / exp({_STRENGTH} + 8)))), 9) AS p FROM memories WHERE last_accessed IS NOT NULL")
def r14(spark: SparkSession, sf: str) -> DataFrame:
    a = S.activation(F.col("created_at"), F.col("last_accessed"), F.col("access_count"), now()) + 8
    return memories(spark, sf).where("last_accessed IS NOT NULL").select("id", F.round(S.retrieval_probability(F.col("last_accessed"), a, now()), 9).alias("p"))


def case_sql(key: str, table: dict, default) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"


_LIFE = f"({case_sql('memory_type', K.HALF_LIVES, 90.0)} * {case_sql('staleness', K.STALENESS_FACTORS, 1.0)} * least(3.0, 1 + 0.1 * least(access_count, 20)))"


@query("x21_forgetting_curve", _W + f"SELECT id, round(pow(2.0, -({_AGE} * pow(0.8, least(access_count, 30))) / CAST({_LIFE} AS DOUBLE)), 9) AS strength, pow(2.0, -({_AGE} * pow(0.8, least(access_count, 30))) / CAST({_LIFE} AS DOUBLE)) < 0.1 AS archive FROM memories")
def x21(spark: SparkSession, sf: str) -> DataFrame:
    s = S.retention_strength(F.col("created_at"), F.col("access_count"), F.col("memory_type"), F.col("staleness"), now())
    return memories(spark, sf).select("id", s.alias("s")).select("id", F.round("s", 9).alias("strength"), (F.col("s") < 0.1).alias("archive"))


POLICY = "default:140,type:code:30,tag:t1:100,tag:u3:20,ns:de:60"
_TTL = "CASE WHEN list_contains(tags, 'u3') THEN 20 WHEN list_contains(tags, 't1') THEN 100 WHEN namespace = 'de' THEN 60 WHEN memory_type = 'code' THEN 30 ELSE 140 END"


@query("x23_retention", _W + f"SELECT id, CAST({_TTL} AS INT) AS ttl FROM memories WHERE {_NOW} >= created_at + to_days(CAST({_TTL} AS INT))")
def x23(spark: SparkSession, sf: str) -> DataFrame:
    return M.expired(memories(spark, sf), S.parse_retention(POLICY), now()).select("id", "ttl")


@query("d8_purge", _W + f"SELECT id FROM memories WHERE NOT ({_NOW} >= created_at + to_days(CAST({_TTL} AS INT)))")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    return M.forget(m, M.expired(m, S.parse_retention(POLICY), now()).select("id")).select("id")


@query("a12_source_trust", "SELECT source, round((5.0 + count(*) FILTER (quality = 1)) / (10.0 + count(quality)), 9) AS trust FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def a12(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return j.groupBy("source").agg(F.round(S.trust(good, bad), 9).alias("trust"))


_CENTROID = """c AS (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
d AS (SELECT e.vec_id, sqrt(sum((CAST(e.x AS DOUBLE) - c.m) * (CAST(e.x AS DOUBLE) - c.m))) AS dist FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) e JOIN c ON e.i = c.i GROUP BY e.vec_id),
s AS (SELECT avg(dist) AS mean, stddev_pop(dist) AS std FROM d)"""


@query("a11_centroid", f"WITH {_CENTROID} SELECT CAST(i - 1 AS INT) AS pos, round(m, 9) AS mean FROM c")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    return centroid(table(spark, sf, "embeddings")).select("pos", F.round("mean", 9).alias("mean"))


def centroid(e: DataFrame) -> DataFrame:
    return e.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def z_scores(e: DataFrame) -> DataFrame:
    """Distance from the centroid in standard deviations; the centroid is one row of as many numbers as dimensions."""
    one = centroid(e).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("c")).select(F.transform("c", lambda x: x["mean"]).alias("c"))
    d = e.crossJoin(F.broadcast(one)).select("vec_id", F.sqrt(F.aggregate(F.zip_with("embedding", "c", lambda x, m: F.pow(x.cast("double") - m, 2)), F.lit(0.0), lambda a, x: a + x)).alias("dist"))
    s = d.agg(F.avg("dist").alias("mean"), F.stddev_pop("dist").alias("std"), F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(s)).select("vec_id", "dist", F.when((F.col("n") >= 10) & (F.col("std") > 0), (F.col("dist") - F.col("mean")) / F.col("std")).otherwise(0.0).alias("z"))


@query("x24_anomalies", f"WITH {_CENTROID} SELECT vec_id, round((dist - mean) / std, 6) AS z, (dist - mean) / std > 3 AS is_anomaly FROM d, s")
def x24(spark: SparkSession, sf: str) -> DataFrame:
    return z_scores(table(spark, sf, "embeddings")).select("vec_id", F.round("z", 6).alias("z"), (F.col("z") > 3).alias("is_anomaly"))


@query(
    "p14_trust_report",
    f"WITH {_CENTROID}, t AS (SELECT source, (5.0 + count(*) FILTER (quality = 1)) / (10.0 + count(quality)) AS trust FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source) SELECT x.doc_id AS id, round(coalesce(t.trust, 0.5), 3) AS trust, round(coalesce((d.dist - s.mean) / s.std, 0.0), 2) AS z, coalesce(t.trust, 0.5) >= 0.3 AND coalesce((d.dist - s.mean) / s.std, 0) <= 3 AS is_trusted FROM documents x CROSS JOIN s LEFT JOIN t ON x.source = t.source LEFT JOIN d ON x.doc_id = d.vec_id",
)
def p14(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    t = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(S.trust(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).alias("t"))
    z = z_scores(table(spark, sf, "embeddings"))
    d = docs.join(t, "source", "left").join(z, docs["doc_id"] == z["vec_id"], "left")
    trust, zs = F.coalesce("t", F.lit(0.5)), F.coalesce("z", F.lit(0.0))
    return d.select(F.col("doc_id").alias("id"), F.round(trust, 3).alias("trust"), F.round(zs, 2).alias("z"), ((trust >= 0.3) & (zs <= 3)).alias("is_trusted"))


_LOG = "log AS (SELECT user_id AS id, event_id AS seq, ts AS saved_at, CASE WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 'delete' ELSE 'put' END AS op, event_type || ':' || value AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)"


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 9 == 0), "delete").otherwise("put")
    return e.select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("saved_at"), op.alias("op"), "event_type", "value")


@query("d4_current_view", f"WITH {_LOG} SELECT id, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log) WHERE r = 1 AND op <> 'delete'")
def d4(spark: SparkSession, sf: str) -> DataFrame:
    return M.current(change_log(spark, sf)).select("id", "seq")


@query("w5_versions", f"WITH {_LOG} SELECT id, seq, version, {stamp_sql('lead(saved_at) OVER (PARTITION BY id ORDER BY seq)')} AS valid_until FROM log")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    return M.versions(change_log(spark, sf)).select("id", "seq", F.col("version").cast("long").alias("version"), stamp("valid_until").alias("valid_until"))


_AT = "TIMESTAMP '2024-01-12 00:00:00'"


@query("j6_as_of", f"WITH {_LOG} SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY saved_at DESC, version DESC) AS r FROM log WHERE saved_at <= {_AT}) WHERE r = 1")
def j6(spark: SparkSession, sf: str) -> DataFrame:
    return M.as_of(M.versions(change_log(spark, sf)), F.expr("timestamp_ntz'2024-01-12 00:00:00'")).select("id", F.col("version").cast("long").alias("version"))


@query(
    "r18_snapshot",
    _W + f", {_LOG}, v AS (SELECT id, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY saved_at DESC, version DESC) AS r FROM log WHERE saved_at <= {_AT}) WHERE r = 1) SELECT m.id, CASE WHEN v.version IS NOT NULL THEN 'v' || v.version WHEN m.id IN (SELECT id FROM log) THEN 'current' ELSE 'current (no version history)' END AS state FROM memories m LEFT JOIN v ON m.id = v.id WHERE m.created_at <= {_AT}",
)
def r18(spark: SparkSession, sf: str) -> DataFrame:
    v = M.versions(change_log(spark, sf).withColumn("content", F.concat_ws(":", "event_type", F.col("value").cast("string"))))
    return M.snapshot(memories(spark, sf), v, F.expr("timestamp_ntz'2024-01-12 00:00:00'")).select("id", "state")


@query("j7_updated_not_created", _W + "SELECT id FROM memories WHERE updated_at >= TIMESTAMP '2024-01-10 00:00:00' AND NOT created_at >= TIMESTAMP '2024-01-10 00:00:00'")
def j7(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    since = F.expr("timestamp_ntz'2024-01-10 00:00:00'")
    return m.where(F.col("updated_at") >= since).join(m.where(F.col("created_at") >= since).select("id"), "id", "left_anti").select("id")


@query("d3_store_batch", f"SELECT doc_id AS id, md5(substr(string_split(trim(regexp_replace(text, '(?s)<private>(.*?)</private>', '', 'g')), chr(10))[1], 1, 200)) AS l3_md5, CAST(greatest(1, length(text) // 4) AS INT) AS original_tokens FROM documents WHERE octet_length(encode(text)) <= 1000000")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return M.ingest(raw, now()).select("id", F.md5("l3").alias("l3_md5"), "original_tokens")


@query("d12_feedback", "SELECT doc_id AS id, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS BIGINT) AS feedback FROM labels GROUP BY doc_id")
def d12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("feedback"))


@query("d14_rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) > 2 AS limited FROM events")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    return table(spark, sf, "events").select("event_id", (F.count("*").over(w) > 2).alias("limited"))


_RANKED = "r AS (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INT) AS rank, CAST(1 + event_id % 50 AS BIGINT) AS tokens FROM events)"


def ranked_events(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(w).alias("rank"), (1 + F.col("event_id") % 50).alias("tokens"))


@query("w2_budget_prefix", f"WITH {_RANKED} SELECT user_id, event_id FROM (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY rank) AS u FROM r) WHERE u <= 100")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return M.budget_prefix(ranked_events(spark, sf), 100, partition=["user_id"]).select("user_id", "event_id")


@query("w3_budget_first", f"WITH {_RANKED} SELECT user_id, event_id FROM (SELECT *, sum(tokens) OVER (PARTITION BY user_id ORDER BY rank) AS u FROM r) WHERE u <= 30 OR rank = 1")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return M.budget_prefix(ranked_events(spark, sf), 30, partition=["user_id"], admit_first=True).select("user_id", "event_id")


@query(
    "w4_budget_skip",
    f"WITH RECURSIVE {_RANKED}, f AS (SELECT user_id, rank, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END AS used, CASE WHEN tokens <= 60 THEN 1 ELSE 0 END AS kept FROM r WHERE rank = 1 UNION ALL SELECT r.user_id, r.rank, CASE WHEN f.used + r.tokens <= 60 THEN f.used + r.tokens ELSE f.used END, CASE WHEN f.used + r.tokens <= 60 THEN f.kept + 1 ELSE f.kept END FROM f JOIN r ON f.user_id = r.user_id AND r.rank = f.rank + 1) SELECT user_id, CAST(max(used) AS BIGINT) AS used, CAST(max(kept) AS INT) AS n_kept FROM f GROUP BY user_id",
)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    return M.budget_skip(ranked_events(spark, sf), 60, "user_id").select("user_id", "used", F.size("kept").alias("n_kept"))


@query("a8_task_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("a20_accuracy_by_type", "SELECT event_type, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS accuracy, round(avg(value), 9) AS mean_latency, round(median(value), 9) AS median_latency FROM events GROUP BY event_type")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("accuracy"), F.round(F.avg("value"), 9).alias("mean_latency"), F.round(F.median("value"), 9).alias("median_latency"))


@query("w12_upper_median", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    """By places in one order over all partitions, so that no group's values lie in one task."""
    e = table(spark, sf, "events").select("event_type", "value", "event_id")
    return nth_of_group(e, "event_type", ["value", "event_id"], F.floor(F.col("n") / 2)).select("event_type", F.col("value").alias("upper_median"))


@query("a7_scoreboard", _W + ", l AS (SELECT m.source, l.quality FROM memories m JOIN labels l ON m.id = l.doc_id) SELECT source, count(*) FILTER (quality = 1) AS wins, count(*) FILTER (quality = 0) AS losses, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (quality = 1) / count(*), 6) ELSE 0.0 END AS ratio FROM l GROUP BY source")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    j = memories(spark, sf).select("id", "source").join(table(spark, sf, "labels"), F.col("id") == F.col("doc_id"))
    return j.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("wins"), F.count_if(F.col("quality") == 0).alias("losses"), F.round(F.count_if(F.col("quality") == 1) / F.count("*"), 6).alias("ratio"))
