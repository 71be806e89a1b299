"""Many questions at once, what their answers are worth, retrieval as of a time, and joins of spans with points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import embed as E
from keepstone.operators import graph as G
from keepstone.operators import questions as A
from keepstone.operators import search as Q
from keepstone.operators.intervals import within
from keepstone.operators.segments import Segments
from keepstone.operators.store import scratch, stash
from keepstone.plans.data import MEMORIES_SQL, NOW, TEXTS_SQL, hours_after, memories, now, sql_text, stamp, stamp_sql, texts
from keepstone.plans.q_embed import embedded_sql
from keepstone.plans.q_graph import EDGES_SQL, edges, raw_edges
from keepstone.plans.q_memories import _STRENGTH
from keepstone.plans.q_retrieval import _PRIORITY, RANGE_SQL, docs, index_of
from keepstone.plans.q_text import tokens_sql
from keepstone.plans.q_timeline import FACTS_SQL, facts
from keepstone.plans.registry import query
from keepstone.session import table

LIMIT, GRAPH = 20, 0.2


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item as a question: as it is, of a month, or of two entities; the choices are three items in a row."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text").withColumn("kind", F.col("qid") % 3)
    asked = F.when(F.col("kind") == 1, F.concat("text", F.lit(" in January 2024"))).when(F.col("kind") == 2, F.concat("text", F.lit(' of "u1" and "u'), (F.col("qid") % 10).cast("string"), F.lit('"'))).otherwise(F.col("text"))
    of_kind = lambda k, value: F.when(F.col("kind") == k, value)
    q = b.select("qid", "kind", asked.alias("question"), F.col("text").alias("answer"), now().alias("now"), F.col("kind").cast("int").alias("correct"), F.expr("qid div 3").alias("three"))
    q = q.withColumn("tags", of_kind(0, F.array(*[F.lit(t) for t in ("t0", "t1", "t2", "u1")]))).withColumn("namespaces", of_kind(1, F.array(F.lit("en"), F.lit("fr")))).withColumn("token_budget", of_kind(2, F.lit(600)))
    threes = b.groupBy(F.expr("qid div 3").alias("three")).agg(F.array_sort(F.collect_list(F.struct("qid", "text"))).alias("c"))  # three rows each
    return q.join(threes, "three").withColumn("choices", F.transform("c", lambda c: c["text"])).drop("c", "three")


def library(spark: SparkSession, sf: str) -> Q.Library:
    names = G.both_ways(raw_edges(spark, sf)).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("mentions"))
    return A.index_for(spark, memories(spark, sf), index_of(spark, sf), names, edges(spark, sf))


_DOCS = "dt AS (SELECT doc_id AS id, text FROM documents)"

ASKED_SQL = """qs AS (SELECT item_id AS qid, item_id % 3 AS kind, text AS answer, text || CASE item_id % 3 WHEN 1 THEN ' in January 2024' WHEN 2 THEN ' of "u1" and "u' || (item_id % 10) || '"' ELSE '' END AS question FROM benchmark),
qx AS (SELECT qid AS id, question AS text FROM qs)"""

_TOP = f"row_number() OVER (PARTITION BY qid, signal ORDER BY round(score, 9) DESC, id) <= {K.CANDIDATES * LIMIT}"

ANSWERS_SQL = f"""{MEMORIES_SQL}, {ASKED_SQL}, {_DOCS}, {EDGES_SQL}, {embedded_sql('dt', 'qx')},
tokd AS (SELECT id, t FROM et WHERE src = 0),
post AS (SELECT id, w, any_value(n) AS n, count(*) AS f FROM (SELECT id, len(t) AS n, unnest(t) AS w FROM tokd) GROUP BY id, w),
dfs AS (SELECT w, count(*) AS df FROM post GROUP BY w),
tot AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM tokd),
qt AS (SELECT id AS qid, unnest(list_distinct(t)) AS w FROM et WHERE src = 1),
bm AS (SELECT qid, id, sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM qt JOIN post USING (w) JOIN dfs USING (w), tot GROUP BY qid, id),
vs AS (SELECT q.id AS qid, d.id, sum(CAST(q.x AS DOUBLE) * CAST(d.x AS DOUBLE)) AS score FROM emb q JOIN emb d ON q.b = d.b AND q.src = 1 AND d.src = 0 GROUP BY q.id, d.id),
vx AS (SELECT q.id AS qid, d.id, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT id FROM emb WHERE src = 1) q CROSS JOIN dt d LEFT JOIN vs s ON s.qid = q.id AND s.id = d.id),
nm AS (SELECT qid, 'u1' AS node FROM qs WHERE kind = 2 UNION SELECT qid, 'u' || (qid % 10) FROM qs WHERE kind = 2),
mn AS (SELECT n AS node, count(*) AS m FROM (SELECT source AS n FROM edges0 UNION ALL SELECT target FROM edges0) GROUP BY n),
f0 AS (SELECT qid, node, least(m / 5.0, 2.0) AS boost FROM nm JOIN mn USING (node)),
r0 AS (SELECT qid, b.*, boost FROM f0 JOIN bw b USING (node)),
f1 AS (SELECT qid, other AS node, max(boost) * 0.5 AS boost FROM r0 WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.qid = r0.qid AND f0.node = other) GROUP BY qid, other),
r1 AS (SELECT qid, b.*, boost FROM f1 JOIN bw b USING (node)),
f2 AS (SELECT qid, other AS node, max(boost) * 0.5 AS boost FROM r1 WHERE NOT EXISTS (SELECT 1 FROM (SELECT qid, node FROM f0 UNION ALL SELECT qid, node FROM f1) s WHERE s.qid = r1.qid AND s.node = other) GROUP BY qid, other),
r2 AS (SELECT qid, b.*, boost FROM f2 JOIN bw b USING (node)),
gr AS (SELECT qid, memory_id AS id, max(s) AS score FROM (SELECT qid, memory_id, weight * boost AS s FROM r0 UNION ALL SELECT qid, memory_id, weight * boost / 2 FROM r1 UNION ALL SELECT qid, memory_id, weight * boost / 3 FROM r2) GROUP BY qid, memory_id),
tm AS (SELECT qid, id, 0.9 + 0.1 * (1 - least(abs(epoch(created_at) - (epoch(TIMESTAMP '2024-01-01 00:00:00') + ({RANGE_SQL}) / 2)) / 86400.0 / (({RANGE_SQL}) / 86400.0), 1)) AS score
  FROM qs, memories WHERE kind = 1 AND created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59'),
every AS (SELECT 'text' AS signal, qid, id, score FROM bm UNION ALL SELECT 'vector', qid, id, score FROM vx UNION ALL SELECT 'graph', qid, id, score FROM gr WHERE score > 0 OR score <= 0 UNION ALL SELECT 'temporal', qid, id, score FROM tm),
ranks AS (SELECT qid, id, signal, row_number() OVER (PARTITION BY qid, signal ORDER BY round(score, 9) DESC, id) AS rank FROM every QUALIFY {_TOP}),
wts AS (SELECT qid, CASE WHEN bool_or(signal = 'temporal') THEN 0.5 ELSE 0.8 END AS rest FROM ranks GROUP BY qid),
fused AS (SELECT qid, id, sum(CASE signal WHEN 'text' THEN 0.4 * rest WHEN 'vector' THEN 0.6 * rest WHEN 'graph' THEN {GRAPH} ELSE 0.3 END / (60 + rank)) AS rrf FROM ranks JOIN wts USING (qid) GROUP BY qid, id),
scored AS (SELECT f.qid, s.kind, m.*, CAST(f.rrf AS DOUBLE) * (0.5 + 0.5 * ({_PRIORITY})) * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1.0 END AS score FROM fused f JOIN memories m ON m.id = f.id JOIN qs s ON s.qid = f.qid),
top AS (SELECT *, score * (1 + 0.1 * greatest(0, {_STRENGTH})) AS final FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS r FROM scored
  WHERE (kind <> 0 OR list_has_any(tags, ['t0', 't1', 't2', 'u1'])) AND (kind <> 1 OR namespace IN ('en', 'fr'))) WHERE r <= {LIMIT}),
ord AS (SELECT qid, kind, id, content, final, row_number() OVER (PARTITION BY qid ORDER BY round(final, 12) DESC, id) AS rank, greatest(1, length(substr(content, 1, 200)) // 4) AS tokens FROM top),
ans AS (SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank) AS used FROM ord) WHERE kind <> 2 OR used <= 600)"""


@query("r16_questions", f"WITH {ANSWERS_SQL} SELECT qid, id, CAST(rank AS INT) AS rank, round(final, 9) AS score FROM ans")
def r16(spark: SparkSession, sf: str) -> DataFrame:
    """All benchmark questions answered in one plan, each with its own vector, filters and budget."""
    return A.answers(library(spark, sf), questions(spark, sf), LIMIT, graph_weight=GRAPH).select("qid", "id", "rank", F.round("score", 9).alias("score"))


@query("r7_question_signals", f"WITH {ANSWERS_SQL} SELECT signal, qid, count(*) AS n, CAST(sum(rank * id) AS BIGINT) AS places FROM ranks GROUP BY signal, qid")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    """How many memories each signal finds for each question, and a sum that tells which, in what order."""
    q = questions(spark, sf).where("question IS NOT NULL")
    s = A.signals(library(spark, sf), q, K.CANDIDATES * LIMIT, LIMIT)
    return s.groupBy("signal", "qid").agg(F.count("*").alias("n"), F.sum(F.col("rank") * F.col("id")).alias("places"))


_BENCH_STOP = "[" + ", ".join(map(sql_text, [*K.QUERY_STOP_WORDS, ""])) + "]"
_BLANK = lambda t: f"list_filter(list_distinct(string_split_regex(lower({t}), '[ \\t\\n\\x0B\\r\\f]+')), lambda w: NOT list_contains({_BENCH_STOP}, w))"
_MINUS = lambda a, b: f"list_filter({a}, lambda w: NOT list_contains({b}, w))"
_SHARE = lambda a: f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, have)) / len({a}) ELSE 0.0 END)"

WENT_SQL = f"""{ANSWERS_SQL},
rec AS (SELECT qid, string_agg(substr(content, 1, 1000) || chr(10) || '---' || chr(10), '' ORDER BY rank) AS recalled, flatten(list({tokens_sql('content')})) AS all_words, list({tokens_sql('content')}) AS words FROM ans GROUP BY qid),
cs AS (SELECT item_id // 3 AS three, list(text ORDER BY item_id) AS choices FROM benchmark GROUP BY item_id // 3),
qa AS (SELECT q.qid, q.kind, q.question, list_distinct({tokens_sql('q.answer')}) AS wanted, choices, coalesce(recalled, '') AS recalled, coalesce(all_words, []) AS all_words, coalesce(words, []) AS words FROM qs q JOIN cs ON cs.three = q.qid // 3 LEFT JOIN rec ON rec.qid = q.qid),
qc AS (SELECT qid, lower(recalled) AS low, {_BLANK('recalled')} AS have, {_BLANK('question')} AS asked, choices, unnest(range(len(choices))) AS j FROM qa),
qd AS (SELECT *, choices[j + 1] AS c, {_BLANK('choices[j + 1]')} AS cw, flatten(list_transform(list_filter(range(len(choices)), lambda i: i <> j), lambda i: {_BLANK('choices[i + 1]')})) AS others FROM qc),
qe AS (SELECT *, {_MINUS('cw', 'asked')} AS nw FROM qd),
qf AS (SELECT *, {_MINUS('nw', 'others')} AS own FROM qe),
qg AS (SELECT qid, j, CASE WHEN contains(low, lower(c)) THEN 2.0 ELSE 0.0 END + 1.5 * {_SHARE('own')} + 0.5 * {_SHARE('nw')} AS s FROM qf),
pred AS (SELECT qid, arg_min(j, (-s, j)) AS predicted FROM qg GROUP BY qid),
went AS (
  SELECT qa.qid, kind, predicted, qid % 3 AS correct, CASE WHEN len(wanted) = 0 THEN 1.0 ELSE len(list_intersect(wanted, all_words)) / len(wanted) END AS coverage,
    len(list_filter(words, lambda w: len(list_intersect(wanted, w)) > 0)) AS hits,
    CASE WHEN len(wanted) = 0 THEN 1.0 ELSE coalesce(list_max(list_transform(words, lambda w: len(list_intersect(wanted, w)))), 0) / len(wanted) END AS best
  FROM qa JOIN pred USING (qid)
),
modes AS (SELECT *, CASE WHEN coverage >= 0.8 THEN CASE WHEN predicted = correct THEN 'OK' ELSE 'SCORING_FAIL' END WHEN coverage >= 0.4 THEN 'PARTIAL_RETRIEVAL' ELSE 'RETRIEVAL_FAIL' END AS mode FROM went)"""


def went(spark: SparkSession, sf: str) -> DataFrame:
    q, lib = questions(spark, sf), library(spark, sf)
    return A.diagnosed(q, A.answers(lib, q, LIMIT, graph_weight=GRAPH), lib.memories).join(q.select("qid", "kind", "correct"), "qid")


@query("p21_question_modes", f"WITH {WENT_SQL} SELECT qid, round(coverage, 6) AS coverage, CAST(hits AS BIGINT) AS hits, round(best, 6) AS best_coverage, CAST(predicted AS INT) AS predicted, mode FROM modes")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each question failed in retrieval or in scoring."""
    return went(spark, sf).select("qid", F.round("coverage", 6).alias("coverage"), "hits", F.round("best_coverage", 6).alias("best_coverage"), "predicted", "mode")


@query("a20_question_accuracy", f"WITH {WENT_SQL} SELECT kind, count(*) AS n, count(*) FILTER (predicted = correct) AS right_ones, round(count(*) FILTER (predicted = correct) / count(*), 6) AS accuracy FROM modes GROUP BY kind")
def a20(spark: SparkSession, sf: str) -> DataFrame:
    return A.accuracy(went(spark, sf), "kind").select("kind", "n", F.col("right").alias("right_ones"), F.round("accuracy", 6).alias("accuracy"))


@query("x3_embeddings", f"WITH {_DOCS}, {embedded_sql('dt')} SELECT id, count(*) AS buckets, round(CAST(sum(CAST(x AS DOUBLE) * (b + 1)) AS DOUBLE), 3) AS weighed FROM emb GROUP BY id")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of all documents, weighed by their own frequencies: how many buckets each has, and a sum that tells which."""
    lib = A.index_for(spark, memories(spark, sf), index_of(spark, sf))
    e = lib.vectors.select("id", F.posexplode("embedding").alias("b", "x")).where("x <> 0")
    return e.groupBy("id").agg(F.count("*").alias("buckets"), F.round(F.sum(F.col("x").cast("double") * (F.col("b") + 1)), 3).alias("weighed"))


@query("x4_bucket_frequency", f"WITH {_DOCS}, {embedded_sql('dt')} SELECT b AS bucket, df AS n FROM edf")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return E.document_frequency(docs(spark, sf)).select("bucket", "n")


@query("x3_embedded_samples", f"WITH {TEXTS_SQL}, {embedded_sql('texts')} SELECT id, count(*) AS buckets, round(CAST(max(x) AS DOUBLE), 4) AS most, round(CAST(min(x) AS DOUBLE), 4) AS least FROM emb GROUP BY id")
def x3_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of documents and samples together: the largest and the smallest value of each."""
    t = texts(spark, sf)
    freq = {r["bucket"]: r["n"] for r in E.document_frequency(t).collect()}  # 256 rows
    e = E.embed(t, t.count(), freq).select("id", F.explode("embedding").alias("x")).where("x <> 0")
    return e.groupBy("id").agg(F.count("*").alias("buckets"), F.round(F.max("x").cast("double"), 4).alias("most"), F.round(F.min("x").cast("double"), 4).alias("least"))


@query("x4_sample_frequency", f"WITH {TEXTS_SQL}, {embedded_sql('texts')} SELECT b AS bucket, df AS n FROM edf")
def x4_samples(spark: SparkSession, sf: str) -> DataFrame:
    return E.document_frequency(texts(spark, sf)).select("bucket", "n")


# ---- as of a time

TIMES = ["2024-01-10 06:30:00", "2024-01-25 00:00:00", NOW]
VERSIONS_SQL = """versions AS (
  SELECT doc_id AS id, text, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS a, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id + doc_id % 90 AS INT)) AS b FROM documents
  UNION ALL SELECT doc_id, text || ' ' || source || ' rewh', TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id + doc_id % 90 AS INT)), CASE WHEN doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id + doc_id % 90 + 200 AS INT)) END FROM documents
)"""


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of each document, the second with more words; every thirteenth is forgotten."""
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    one = d.select(i.alias("id"), "text", hours_after(i).alias("valid_from"), hours_after(i + i % 90).alias("valid_until"))
    two = d.select(i.alias("id"), F.concat_ws(" ", "text", "source", F.lit("rewh")).alias("text"), hours_after(i + i % 90).alias("valid_from"), F.when(i % 13 == 0, hours_after(i + i % 90 + 200)).alias("valid_until"))
    return one.unionByName(two)


@query(
    "r18_questions_as_of",
    f"WITH {VERSIONS_SQL}, times AS (SELECT unnest(range({len(TIMES)})) AS j, unnest([{', '.join(f"TIMESTAMP '{t}'" for t in TIMES)}]) AS t), "
    f"live AS (SELECT j, id, {tokens_sql('text')} AS t FROM versions, times WHERE a <= t AND (b IS NULL OR t < b)), "
    "post AS (SELECT j, id, w, any_value(n) AS n, count(*) AS f FROM (SELECT j, id, len(t) AS n, unnest(t) AS w FROM live) GROUP BY j, id, w), "
    "dfs AS (SELECT j, w, count(*) AS df FROM post GROUP BY j, w), tot AS (SELECT j, count(*) AS total, avg(len(t)) AS mean FROM live GROUP BY j), "
    f"qt AS (SELECT item_id * {len(TIMES)} + j AS qid, j, unnest(list_distinct({tokens_sql('text')})) AS w FROM benchmark, times), "
    "bm AS (SELECT qid, id, sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM qt JOIN post USING (j, w) JOIN dfs USING (j, w) JOIN tot USING (j) GROUP BY qid, id) "
    "SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS INT) AS rank, round(score, 9) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 20",
)
def r18(spark: SparkSession, sf: str) -> DataFrame:
    """Each benchmark item asked as of three times, in one plan; the SQL searches a snapshot of each."""
    times = F.array(*[F.expr(f"timestamp_ntz'{t}'") for t in TIMES])
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), F.posexplode(times).alias("j", "at"))
    q = q.select((F.col("item_id") * len(TIMES) + F.col("j")).alias("qid"), "question", "at")
    return A.answers_as_of(q, A.build_history(versions(spark, sf)), 20).select("qid", "id", "rank", F.round("score", 9).alias("score"))


@query(
    "x4_followed_index",
    f"WITH l AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 2 THEN text || ' rewh rewh' ELSE text END AS text FROM documents WHERE doc_id % 9 <> 4), "
    f"live AS (SELECT id, coalesce({tokens_sql('text')}, []) AS t FROM l), "
    "post AS (SELECT id, w, any_value(n) AS n, count(*) AS f FROM (SELECT id, len(t) AS n, unnest(t) AS w FROM live) GROUP BY id, w), dfs AS (SELECT w, count(*) AS df FROM post GROUP BY w), tot AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM live), "
    f"qt AS (SELECT item_id AS qid, unnest(list_distinct({tokens_sql('text')})) AS w FROM benchmark), "
    "bm AS (SELECT qid, id, sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM qt JOIN post USING (w) JOIN dfs USING (w), tot GROUP BY qid, id) "
    "SELECT qid, id, round(score, 9) AS score FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) <= 10",
)
def x4_followed(spark: SparkSession, sf: str) -> DataFrame:
    """An index that has followed five batches: texts in three of them, updates of some, deletions of others; the SQL indexes what is left."""
    d = docs(spark, sf)
    index = Segments(spark, scratch(spark, "segments"))
    for k in range(3):
        index.put(d.where(F.col("id") % 3 == k))
    index.put(d.where("id % 5 = 2").select("id", F.concat("text", F.lit(" rewh rewh")).alias("text")))
    index.delete(d.where("id % 9 = 4").select("id"))
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    scores = stash(index.scores(A.terms_of(q)), "scores")
    top = A.best(scores, "text", 10)
    return scores.join(top, ["qid", "id"], "left_semi").select("qid", "id", F.round("score", 9).alias("score"))


# ---- spans and points


@query(
    "f11_many_windows",
    "WITH w AS (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS lo, CASE WHEN doc_id % 97 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id + doc_id % 90 AS INT)) END AS hi FROM documents) "
    "SELECT doc_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM w JOIN events ON ts >= lo AND (hi IS NULL OR ts <= hi) GROUP BY doc_id",
)
def f11(spark: SparkSession, sf: str) -> DataFrame:
    """The window of each document's time against all events; some windows have no end."""
    i = F.col("doc_id")
    w = table(spark, sf, "documents").select("doc_id", hours_after(i).alias("lo"), F.when(i % 97 != 0, hours_after(i + i % 90)).alias("hi"))
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("at"))
    return within(e, w, "at", "lo", "hi").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "f6_facts_at_dates",
    f"WITH {FACTS_SQL}, days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) "
    f"SELECT day, seq, value, {stamp_sql('t0')} AS since FROM days JOIN fv ON t0 <= day AND (valid_until IS NULL OR day < valid_until)",
)
def f6(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact against every day on which something happened."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day")).distinct()
    d = within(days.withColumn("midnight", F.col("day").cast("timestamp_ntz")), facts(spark, sf), "midnight", "at", "valid_until", end_open=True)
    return d.select("day", "seq", "value", stamp("at").alias("since"))


@query(
    "f6_latest_before_order",
    f"WITH {FACTS_SQL} SELECT o.o_orderkey, f.attribute, f.seq, f.value FROM orders o JOIN fv f ON f.entity = 'u' || (o.o_custkey % 150) AND f.t0 <= TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o.o_orderkey % 720 AS INT)) AND (f.valid_until IS NULL OR TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o.o_orderkey % 720 AS INT)) < f.valid_until)",
)
def f6_orders(spark: SparkSession, sf: str) -> DataFrame:
    """What was held true of an order's user at the order's time: spans are joined within users."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("u"), (F.col("o_custkey") % 150).cast("string")).alias("entity"), hours_after(F.col("o_orderkey") % 720).alias("placed"))
    return within(o, facts(spark, sf), "placed", "at", "valid_until", on=("entity",), end_open=True).select("o_orderkey", "attribute", "seq", "value")
