"""Timelines, diffs, facts, patterns, conversations and workspaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.functions import scoring as S
from keepstone.functions import text as T
from keepstone.operators import patterns as P
from keepstone.operators import timeline as L
from keepstone.plans.data import MEMORIES_SQL, hours_after, memories, stamp, stamp_sql
from keepstone.plans.q_graph import raw_edges
from keepstone.plans.q_text import sentences_sql, tokens_sql
from keepstone.plans.registry import query
from keepstone.session import table

_M = f"WITH {MEMORIES_SQL}"


def _ts(x: str):
    return F.expr(f"timestamp_ntz'{x}'")


def _timeline_sql(fmt: str) -> str:
    return (
        _M
        + f""", k AS (SELECT strftime(created_at, '{fmt}') AS period, 'a' AS k FROM memories UNION ALL SELECT strftime(updated_at, '{fmt}'), 'm' FROM memories WHERE updated_at > created_at
    UNION ALL SELECT strftime(ts, '{fmt}'), 'd' FROM events WHERE event_type = 'purchase'),
  c AS (SELECT period, count(*) FILTER (k = 'a') AS added, count(*) FILTER (k = 'm') AS modified, count(*) FILTER (k = 'd') AS deleted FROM k GROUP BY period),
  t AS (SELECT period, tag, count(*) AS n FROM (SELECT strftime(created_at, '{fmt}') AS period, unnest(tags) AS tag FROM memories) GROUP BY period, tag),
  b AS (SELECT period, string_agg(tag, ',' ORDER BY r) AS top_tags FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, tag) AS r FROM t) WHERE r <= 5 GROUP BY period)
  SELECT c.period, added, modified, deleted, coalesce(top_tags, '') AS top_tags FROM c LEFT JOIN b ON c.period = b.period"""
    )


def _timeline(spark: SparkSession, sf: str, granularity: str) -> DataFrame:
    m = memories(spark, sf)
    gone = table(spark, sf, "events").where("event_type = 'purchase'").select("ts")
    out = L.timeline(m.select(F.col("created_at").alias("ts"), "tags"), m.where("updated_at > created_at").select(F.col("updated_at").alias("ts")), gone, granularity)
    return out.withColumn("top_tags", F.coalesce(F.array_join("top_tags", ","), F.lit("")))


@query("a5_timeline_day", _timeline_sql("%Y-%m-%d"))
def a5_day(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf, "day")


@query("a5_timeline_week", _timeline_sql("%Y-W%W"))
def a5_week(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf, "week")


@query("a5_timeline_month", _timeline_sql("%Y-%m"))
def a5_month(spark: SparkSession, sf: str) -> DataFrame:
    return _timeline(spark, sf, "month")


_BETWEEN = "BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"


@query("p22_diff", _M + f"SELECT id, 'new' AS change FROM memories WHERE created_at {_BETWEEN} UNION ALL SELECT id, 'updated' FROM memories WHERE updated_at {_BETWEEN} AND NOT created_at {_BETWEEN} UNION ALL SELECT DISTINCT user_id, 'deleted' FROM events WHERE event_type = 'purchase' AND ts {_BETWEEN}")
def p22(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    gone = table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("ts"))
    return L.diff(m, m, gone, _ts("2024-01-10 00:00:00"), _ts("2024-01-20 00:00:00"))


@query("a6_tag_changes", _M + ", o AS (SELECT DISTINCT unnest(tags) AS tag FROM memories WHERE id < 7), n AS (SELECT DISTINCT unnest(tags) AS tag FROM memories WHERE id >= 7) SELECT coalesce(o.tag, n.tag) AS tag, CASE WHEN o.tag IS NULL THEN 'added' ELSE 'removed' END AS change FROM o FULL JOIN n ON o.tag = n.tag WHERE o.tag IS NULL OR n.tag IS NULL")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    m = memories(spark, sf)
    return L.tag_changes(m.where("id < 7"), m.where("id >= 7"))


#: Users are entities, event types attributes, and values in steps of 25 what is known of them.
FACTS_SQL = """facts AS (SELECT 'u' || user_id AS entity, event_type AS attribute, CAST(floor(value / 25) AS BIGINT) AS value, ts AS t0, event_id AS seq FROM events),
f1 AS (SELECT *, coalesce(CAST(lag(value) OVER w <> value AS INT), 0) AS ch FROM facts WINDOW w AS (PARTITION BY entity, attribute ORDER BY t0, seq)),
f2 AS (SELECT *, sum(ch) OVER (PARTITION BY entity, attribute ORDER BY t0, seq) AS run FROM f1),
starts AS (SELECT entity, attribute, run, min(t0) AS s FROM f2 GROUP BY entity, attribute, run),
fv AS (SELECT f.entity, f.attribute, f.value, f.t0, f.seq, s.s AS valid_until FROM f2 f LEFT JOIN starts s ON f.entity = s.entity AND f.attribute = s.attribute AND s.run = f.run + 1),
cur AS (SELECT entity, attribute, arg_max(value, (t0, seq)) AS value FROM fv WHERE valid_until IS NULL GROUP BY entity, attribute)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity"), F.col("event_type").alias("attribute"), F.floor(F.col("value") / 25).alias("value"), F.col("ts").cast("timestamp_ntz").alias("at"), F.col("event_id").alias("seq"))
    return L.supersede(e)


@query("w7_fact_supersession", f"WITH {FACTS_SQL} SELECT seq, {stamp_sql('valid_until')} AS valid_until FROM fv")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).select("seq", stamp("valid_until").alias("valid_until"))


@query("p5_current_facts", f"WITH {FACTS_SQL} SELECT entity, attribute, value FROM cur")
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return L.current_facts(facts(spark, sf)).select("entity", "attribute", "value")


@query("p5_entity_history", f"WITH {FACTS_SQL} SELECT attribute, value, {stamp_sql('t0')} AS \"at\", valid_until IS NULL AS open FROM fv WHERE entity = 'u3'")
def p5_history(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).where("entity = 'u3'").orderBy("at").select("attribute", "value", stamp("at").alias("at"), F.col("valid_until").isNull().alias("open"))


@query("p9_entity_cards", f"WITH {FACTS_SQL} SELECT entity, string_agg(attribute || '=' || value, ';' ORDER BY attribute) AS card FROM cur GROUP BY entity")
def p9(spark: SparkSession, sf: str) -> DataFrame:
    c = L.current_facts(facts(spark, sf))
    pairs = F.array_sort(F.collect_list(F.struct("attribute", F.concat("attribute", F.lit("="), F.col("value").cast("string")).alias("t"))))
    return c.groupBy("entity").agg(F.array_join(F.transform(pairs, lambda x: x["t"]), ";").alias("card"))


@query("j16_fact_changes", f"WITH {FACTS_SQL}, n AS (SELECT entity, attribute, t0, arg_min(value, seq) AS new FROM fv WHERE valid_until IS NULL GROUP BY entity, attribute, t0) SELECT f.seq, f.value AS old, n.new FROM fv f JOIN n ON f.entity = n.entity AND f.attribute = n.attribute AND f.valid_until = n.t0")
def j16(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    n = f.where("valid_until IS NULL").groupBy("entity", "attribute", F.col("at").alias("valid_until")).agg(F.min_by("value", "seq").alias("new"))
    return f.join(n, ["entity", "attribute", "valid_until"]).select("seq", F.col("value").alias("old"), "new")


@query("p8_fact_stats", f"WITH {FACTS_SQL} SELECT count(*) AS total, count(*) FILTER (valid_until IS NULL) AS current, count(valid_until) AS superseded, count(DISTINCT (entity, attribute)) AS attributes FROM fv")
def p8(spark: SparkSession, sf: str) -> DataFrame:
    return facts(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("valid_until").isNull()).alias("current"), F.count("valid_until").alias("superseded"), F.count_distinct("entity", "attribute").alias("attributes"))


@query(
    "p6_infer",
    f"WITH {FACTS_SQL}, rel AS (SELECT DISTINCT 'u' || user_id AS s, 'u' || ((user_id * 7 + event_id) % 150) AS t FROM events), e AS (SELECT s AS x, t AS y FROM rel UNION SELECT t, s FROM rel), h AS (SELECT 'zz' AS n, 0 AS h UNION ALL SELECT 'u1', 1 UNION ALL SELECT DISTINCT y, 2 FROM e WHERE x = 'u1' AND y <> 'zz' AND y <> 'u1') SELECT n AS entity, h AS hops, value FROM h JOIN cur ON cur.entity = h.n AND attribute = 'view' ORDER BY h, n LIMIT 1",
)
def p6(spark: SparkSession, sf: str) -> DataFrame:
    rel = raw_edges(spark, sf).select("source", "target")
    rel = rel.unionByName(spark.createDataFrame([("zz", "u1")], "source string, target string"))
    return L.infer(L.current_facts(facts(spark, sf)), rel, "zz", "view")


@query("p7_knowledge_context", f"WITH {FACTS_SQL} SELECT entity, attribute, value FROM cur WHERE entity = 'u7' UNION ALL SELECT entity, attribute || ' (was)', value FROM (SELECT * FROM fv WHERE entity = 'u7' AND valid_until IS NOT NULL ORDER BY valid_until DESC, seq DESC LIMIT 3)")
def p7(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf).where("entity = 'u7'")
    was = f.where("valid_until IS NOT NULL").orderBy(F.desc("valid_until"), F.desc("seq")).limit(3)
    return L.current_facts(f).select("entity", "attribute", "value").unionAll(was.select("entity", F.concat("attribute", F.lit(" (was)")), "value"))


_ROWS = "tg AS (SELECT ts, unnest(['e:' || event_type, 'v:' || (user_id % 9)]) AS tag FROM events)"


def tagged_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("ts", F.array(F.concat(F.lit("e:"), "event_type"), F.concat(F.lit("v:"), (F.col("user_id") % 9).cast("string"))).alias("tags"))


@query("a15_weekday_habits", f"WITH {_ROWS}, c AS (SELECT tag, CAST(isodow(ts) - 1 AS INT) AS weekday, count(*) AS n FROM tg GROUP BY 1, 2), s AS (SELECT tag, sum(n) AS total FROM c GROUP BY tag), b AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, weekday) AS r FROM c) SELECT b.tag, weekday, n, CAST(total AS BIGINT) AS total FROM b JOIN s ON b.tag = s.tag WHERE r = 1 AND n >= 3 AND n >= 0.15 * total")
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return P.weekday_habits(tagged_events(spark, sf), share=0.15)


@query("a16_intervals", "WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) // 86400000000 AS gap FROM events), s AS (SELECT 'u' || user_id AS tag, count(*) AS n, avg(gap) FILTER (gap > 0) AS mean_days, stddev_pop(gap) FILTER (gap > 0) AS sd FROM g GROUP BY user_id) SELECT tag, round(mean_days, 6) AS mean_days, round(sd / mean_days, 6) AS cv FROM s WHERE n >= 3 AND mean_days >= 1.2 AND sd / mean_days < 0.6")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("ts", F.array(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("tags"))
    return P.regular_intervals(rows, variation=0.6, least_days=1.2).select("tag", F.round("mean_days", 6).alias("mean_days"), F.round("cv", 6).alias("cv"))


#: The corpus's own frequent words stand for the groups of keywords.
GROUPS = {"en": ["rewh", "thtion", "nd"], "fr": ["oi", "eau", "ment"]}
_MENTIONS = MEMORIES_SQL + ", mn AS (" + " UNION ALL ".join(f"SELECT id, created_at AS ts, '{g}' AS grp, {i} AS pos, '{w}' AS keyword FROM memories WHERE list_contains(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), '{w}')" for g, ws in GROUPS.items() for i, w in enumerate(ws)) + ")"


def mentioned(spark: SparkSession, sf: str) -> DataFrame:
    return P.mentions(memories(spark, sf).select("id", F.col("created_at").alias("ts"), F.col("content").alias("text")), GROUPS)


@query("w9_oscillation", f"WITH {_MENTIONS}, s AS (SELECT *, coalesce(CAST(lag(keyword) OVER (PARTITION BY grp ORDER BY ts, id, pos) <> keyword AS INT), 0) AS sw FROM mn), g AS (SELECT grp, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY grp ORDER BY ts, id, pos)) // 86400000000 AS gap FROM s WHERE sw = 1), n AS (SELECT grp, count(*) AS mentions, CAST(sum(sw) AS BIGINT) AS switches FROM s GROUP BY grp) SELECT n.grp, mentions, switches, round(m.g, 6) AS mean_gap FROM n LEFT JOIN (SELECT grp, avg(gap) AS g FROM g GROUP BY grp) m ON n.grp = m.grp WHERE mentions >= 4 AND switches >= 2")
def w9(spark: SparkSession, sf: str) -> DataFrame:
    return P.switches(mentioned(spark, sf)).withColumn("mean_gap", F.round("mean_gap", 6))


@query("a17_trends", f"WITH {_MENTIONS}, h AS (SELECT id, row_number() OVER (ORDER BY created_at, id) > (SELECT count(*) FROM memories) // 2 AS late FROM memories), c AS (SELECT grp, keyword, count(*) FILTER (NOT late) AS early, count(*) FILTER (late) AS recent FROM mn JOIN h ON mn.id = h.id GROUP BY grp, keyword) SELECT grp, keyword, early, recent, round((recent - early) / (recent + early), 6) AS shift FROM c WHERE early + recent >= 3 AND abs((recent - early) / (recent + early)) >= 0.01")
def a17(spark: SparkSession, sf: str) -> DataFrame:
    h = P.halves(memories(spark, sf).select("id", F.col("created_at").alias("ts")))
    return P.trends(mentioned(spark, sf), h, change=0.01).withColumn("shift", F.round("shift", 6))


_TOPICS = "tp AS (SELECT user_id AS session, event_id AS seq, event_type AS topic, ts FROM events)"


def topics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("topic"), "ts")


_CO = f"{_TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS i FROM tp), d AS (SELECT x.topic AS a, y.topic AS b FROM r x JOIN r y ON x.session = y.session AND y.i BETWEEN x.i - 4 AND x.i - 1 WHERE x.topic <> y.topic), co AS (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM d UNION ALL SELECT b, a FROM d) GROUP BY a, b), tr AS (SELECT topic AS a, b, count(*) AS n FROM (SELECT topic, lead(topic) OVER (PARTITION BY session ORDER BY seq) AS b FROM tp) WHERE b IS NOT NULL AND b <> topic GROUP BY topic, b)"


@query("a18_co_occurrence", f"WITH {_CO} SELECT a, b, n FROM co")
def a18(spark: SparkSession, sf: str) -> DataFrame:
    return P.co_occurrence(topics(spark, sf))


@query("a18_transitions", f"WITH {_CO} SELECT a, b, n FROM tr")
def a18_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return P.transitions(topics(spark, sf))


@query(
    "st7_predictions",
    f"WITH {_CO}, e AS (SELECT b AS topic, least(n / 10, 0.9) AS c, 1 AS o, 'near' AS reason FROM (SELECT * FROM co WHERE a = 'view' AND n >= 2 ORDER BY n DESC, b LIMIT 3) UNION ALL SELECT topic, least(n / 15, 0.7), 2, 'hour' FROM (SELECT topic, count(*) AS n FROM tp WHERE hour(ts) = 9 GROUP BY topic HAVING count(*) >= 3 ORDER BY n DESC, topic LIMIT 3) UNION ALL SELECT b, least(n / 5, 0.8), 3, 'after' FROM (SELECT * FROM tr WHERE a = 'view' AND n >= 2 ORDER BY n DESC, b LIMIT 5)) SELECT topic, max(c) AS confidence, arg_min(reason, o) AS reason FROM e GROUP BY topic ORDER BY confidence DESC, topic LIMIT 5",
)
def st7(spark: SparkSession, sf: str) -> DataFrame:
    return P.predictions(topics(spark, sf), hour=9, last_topic="view")


@query("s21_turn_windows", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), s AS (SELECT conv_id, unnest(range(0, n, 2)) AS st FROM (SELECT DISTINCT conv_id, n FROM t)) SELECT s.conv_id, s.st AS start, md5(string_agg('[' || t.role || ']: ' || t.text, chr(10) ORDER BY t.turn)) AS chunk_md5, count(*) AS turns FROM s JOIN t ON t.conv_id = s.conv_id AND t.i BETWEEN s.st AND s.st + 3 GROUP BY s.conv_id, s.st")
def s21(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.sources.conversations import turn_windows

    return turn_windows(table(spark, sf, "conversations"), size=4, stride=2).select("conv_id", "start", F.md5("chunk").alias("chunk_md5"), "turns")


@query("s24_captured_calls", "SELECT conv_id, md5(string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn)) AS call_md5 FROM conversations GROUP BY conv_id")
def s24(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.sources.conversations import captured_calls

    return captured_calls(table(spark, sf, "conversations")).select("conv_id", F.md5("content").alias("call_md5"))


_CAL = f"cal AS (SELECT conv_id, turn, role, unnest({sentences_sql('text')}) AS s FROM conversations), good AS (SELECT * FROM cal WHERE length(s) >= 15 AND len(regexp_extract_all(s, '[^ \\t\\n\\r\\f]+')) >= 4)"


@query("p10_calendar", f"WITH {_CAL} SELECT conv_id, turn, count(*) AS n_events FROM good GROUP BY conv_id, turn")
def p10(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.calendar import build

    c = table(spark, sf, "conversations").withColumn("session_date", hours_after(F.col("conv_id") * 24))
    return build(c, fillers=False).groupBy("conv_id", "turn").agg(F.count("*").alias("n_events"))


@query("p11_calendar_keywords", f"WITH {_CAL}, h AS (SELECT conv_id, turn, s, len(list_intersect(list_distinct({tokens_sql('s')}), ['rewh', 'thtion', 'ndre', 'hation'])) AS hits FROM good) SELECT conv_id, turn, md5(s) AS event_md5, CAST(hits AS INT) AS hits FROM h WHERE hits >= 2")
def p11(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.calendar import build, relevant

    c = table(spark, sf, "conversations").withColumn("session_date", hours_after(F.col("conv_id") * 24))
    out = relevant(build(c, fillers=False), ["rewh", "thtion", "ndre", "hation"], limit=None)
    return out.select("conv_id", "turn", F.md5("sentence").alias("event_md5"), "hits")


@query("f11_time_window", _M + "SELECT id FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-02-14 00:00:00' OR updated_at BETWEEN TIMESTAMP '2024-01-06 00:00:00' AND TIMESTAMP '2024-02-14 00:00:00'")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.calendar import within

    m = memories(spark, sf).withColumn("session_date", F.col("created_at")).withColumn("event_date", F.col("updated_at"))
    return within(m, _ts("2024-01-20 00:00:00"), _ts("2024-01-31 00:00:00"), 14).select("id")


@query("w6_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    k = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", k).alias("first_type"), F.max_by("event_type", k).alias("last_type"))


@query("x32_duration_between", "SELECT user_id, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days, round(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / 7.0, 1) AS weeks FROM events GROUP BY user_id")
def x32(spark: SparkSession, sf: str) -> DataFrame:
    d = F.datediff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))).cast("long")
    return table(spark, sf, "events").groupBy("user_id").agg(d.alias("days")).withColumn("weeks", F.round(F.col("days") / 7.0, 1))


_RANGE = "epoch(TIMESTAMP '2024-01-31 23:59:59') - epoch(TIMESTAMP '2024-01-01 00:00:00')"


@query("r4_temporal_range", _M + f"SELECT id, round(0.9 + 0.1 * (1 - least(abs(epoch(created_at) - (epoch(TIMESTAMP '2024-01-01 00:00:00') + ({_RANGE}) / 2)) / 86400.0 / (({_RANGE}) / 86400.0), 1)), 9) AS score FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59'")
def r4(spark: SparkSession, sf: str) -> DataFrame:
    """From a question's text; no text of the corpus names a date, so that creation decides alone."""
    from datetime import datetime

    from keepstone.operators.search import temporal_scores

    found = temporal_scores("what happened in January 2024?", memories(spark, sf), datetime(2024, 6, 1), 20)
    return found.select("id", F.round("score", 9).alias("score"))


@query(
    "r4_temporal_near",
    _M + "SELECT id, round(CASE WHEN g < 0.5 THEN 1.0 WHEN g <= 3.5 THEN 0.8 WHEN year(created_at) = 2024 AND month(created_at) = 1 THEN 0.6 WHEN year(created_at) = 2024 THEN 0.3 ELSE exp(-g / 30.0) END, 9) AS score FROM (SELECT *, abs(epoch(TIMESTAMP '2024-01-18 12:00:00') - epoch(created_at)) / 86400.0 AS g FROM memories) WHERE g <= 90",
)
def r4_near(spark: SparkSession, sf: str) -> DataFrame:
    from datetime import datetime

    from keepstone.operators.search import temporal_scores

    found = temporal_scores("what was said on 2024-01-18T12:00?", memories(spark, sf), datetime(2024, 6, 1), 20)
    return found.select("id", F.round("score", 9).alias("score"))


_T = "TIMESTAMP '2024-01-18 12:00:00'"
_GAP = f"abs(epoch({_T}) - epoch(created_at)) / 86400.0"


@query("r5_temporal_similarity", _M + f"SELECT id, round(CASE WHEN {_GAP} < 0.5 THEN 1.0 WHEN {_GAP} <= 3.5 THEN 0.8 WHEN year(created_at) = 2024 AND month(created_at) = 1 THEN 0.6 WHEN year(created_at) = 2024 THEN 0.3 ELSE exp(-{_GAP} / 30.0) END, 9) AS score FROM memories")
def r5(spark: SparkSession, sf: str) -> DataFrame:
    s = S.temporal_similarity(_ts("2024-01-18 12:00:00"), F.col("created_at"), F.lit("exact"))
    return memories(spark, sf).select("id", F.round(s, 9).alias("score"))


_BLOCK = "t AS (SELECT o_orderkey AS id, o_custkey AS owner, o_orderstatus AS status, o_orderkey + 1 AS blocker FROM orders)"


@query("j13_blocked_tasks", f"WITH {_BLOCK} SELECT t.id, b.id AS blocker, b.status AS blocker_status FROM t JOIN t b ON t.blocker = b.id WHERE b.status <> 'F'")
def j13(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.workspace import blocked

    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.array(F.col("o_orderkey") + 1).alias("blocked_by"))
    return blocked(t, done="F").select("id", "blocker", "blocker_status")


@query("d10_task_states", "WITH l AS (SELECT user_id AS task_id, arg_max(event_type, event_id) AS last, count(*) AS steps FROM events GROUP BY user_id) SELECT task_id, last AS status, steps FROM l")
def d10(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.workspace import task_states

    e = table(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return task_states(e).select("task_id", "status", "steps")


@query("p17_activity_feed", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id DESC LIMIT 25")
def p17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'view'").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id")


@query("j14_memberships", "SELECT c.c_custkey AS agent, n.n_name AS workspace FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def j14(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("agent"), F.col("n_name").alias("workspace"))  # 25 rows


@query("f12_handoffs", "SELECT event_id FROM events WHERE (user_id % 3 = 0 OR user_id = 7) AND event_type = 'click'")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    from keepstone.operators.workspace import visible_handoffs

    h = table(spark, sf, "events").where("event_type = 'click'").select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("to_agent"))
    return visible_handoffs(h, "7").select("event_id")


@query("d11_monthly_archive", _M + "SELECT strftime(created_at, '%Y-%m') AS archive, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM memories GROUP BY 1")
def d11(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).groupBy(F.date_format("created_at", "yyyy-MM").alias("archive")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("x37_profile_confidence", _M + "SELECT namespace, round(0.6 * least(1.0, count(*) FILTER (memory_type IN ('code', 'decision')) / count(*)) + 0.4 * least(1.0, count(*) / 50.0), 9) AS confidence FROM memories GROUP BY namespace")
def x37(spark: SparkSession, sf: str) -> DataFrame:
    c = 0.6 * F.least(F.lit(1.0), F.count_if(F.col("memory_type").isin("code", "decision")) / F.count("*")) + 0.4 * F.least(F.lit(1.0), F.count("*") / 50.0)
    return memories(spark, sf).groupBy("namespace").agg(F.round(c, 9).alias("confidence"))


@query("a13_word_frequency", f"WITH t AS (SELECT lang, unnest({tokens_sql('text')}) AS w FROM documents), c AS (SELECT lang, w, count(*) AS n FROM t GROUP BY lang, w) SELECT lang, w, n, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c) WHERE r <= 30")
def a13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select("lang", F.explode(T.tokenize(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where("r <= 30")
