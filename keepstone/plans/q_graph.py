"""Entities, relationships, walks, similarity pairs and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.operators import graph as G
from keepstone.plans.data import MEMORIES_SQL, TEXTS_SQL, memories, sql_text, texts
from keepstone.plans.q_text import key_terms_sql
from keepstone.plans.registry import query
from keepstone.session import table

#: Letters outside a-z stand as an underscore, a word character in every engine; no pattern of a name takes it for a letter.
_ASCII_SQL = "regexp_replace(text, '[^\\P{L}a-zA-Z]', '_', 'g')"


def plain_texts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", F.regexp_replace("text", r"[\p{L}&&[^a-zA-Z]]", "_").alias("text"))


_STOP = "[" + ", ".join(map(sql_text, K.STOP_ENTITIES)) + "]"
_FOUND = " UNION ALL ".join(
    [f"SELECT id, 0 AS o, 'concept' AS t, unnest(regexp_extract_all(text, '[^.!?\\n]\\b([A-Z][a-z]{{2,}})\\b', 1)) AS n FROM pt"]
    + [f"SELECT id, {o}, '{kind}', unnest({'list_filter(list_transform(' if kind == 'concept' else ''}regexp_extract_all(text, {sql_text(p)}, {g}){', lambda n: trim(n)), lambda n: length(n) >= 2)' if kind == 'concept' else ''}) FROM pt" for o, (kind, p, g) in enumerate(K.ENTITY_PATTERNS, 1)]
)
ENTITIES_SQL = f"""{TEXTS_SQL}, pt AS (SELECT id, {_ASCII_SQL} AS text FROM texts), found AS ({_FOUND}),
entities AS (SELECT id, n AS name, arg_max(t, o) AS type FROM found WHERE NOT (o IN (0, 6) AND len(list_filter(string_split_regex(n, '[ \\t\\n\\r\\f]+'), lambda w: NOT list_contains({_STOP}, w))) = 0) GROUP BY id, n)"""


@query("x25_entities", f"WITH {ENTITIES_SQL} SELECT id, name, type FROM entities")
def x25(spark: SparkSession, sf: str) -> DataFrame:
    return G.extract_entities(plain_texts(spark, sf))


_VERBS = " UNION ALL ".join(
    f"SELECT id, regexp_extract(s, {sql_text(p)}, 1) AS source, regexp_extract(s, {sql_text(p)}, 2) AS target, '{r}' AS relation, names FROM st WHERE list_contains(names, regexp_extract(s, {sql_text(p)}, 1)) AND list_contains(names, regexp_extract(s, {sql_text(p)}, 2))"
    for r, p in K.VERB_PATTERNS
)
_RELATIONS = f"""{ENTITIES_SQL}, nm AS (SELECT id, list_sort(list(DISTINCT name)) AS names FROM entities GROUP BY id),
st AS (SELECT p.id, names, unnest(string_split_regex(text, '[.!?\\n]+')) AS s FROM pt p JOIN nm ON p.id = nm.id),
pr AS (SELECT id, s, unnest(list_filter(names, lambda n: contains(s, n))) AS n, row_number() OVER () AS k FROM st),
co AS (SELECT DISTINCT st.id, a.n AS source, b.n AS target, 'co_occurs' AS relation FROM st, LATERAL (SELECT unnest(list_filter(names, lambda n: contains(s, n))) AS n) a, LATERAL (SELECT unnest(list_filter(names, lambda n: contains(s, n))) AS n) b WHERE a.n < b.n),
relationships AS (SELECT id, source, target, relation FROM co UNION SELECT id, source, target, relation FROM ({_VERBS}))"""


@query("x26_relationships", f"WITH {_RELATIONS} SELECT id, source, target, relation FROM relationships")
def x26(spark: SparkSession, sf: str) -> DataFrame:
    return G.extract_relationships(plain_texts(spark, sf))


@query(
    "x27_temporal_markers",
    f"WITH {TEXTS_SQL}, pt AS (SELECT id, {_ASCII_SQL} AS text FROM texts), m AS (SELECT id, nullif(regexp_extract(text, {sql_text(K.MARK_DATE)}, 1), '') AS date_hint, regexp_matches(text, {sql_text(K.MARK_ENDED)}) AS ended, regexp_matches(text, {sql_text(K.MARK_CURRENT)}) AS cur FROM pt) SELECT id, CASE WHEN ended OR cur THEN date_hint END AS valid_from, ended, date_hint FROM m",
)
def x27(spark: SparkSession, sf: str) -> DataFrame:
    return plain_texts(spark, sf).select("id", *[c.alias(k) for k, c in G.temporal_markers(F.col("text")).items()])


@query("d7_entity_upsert", f"WITH {ENTITIES_SQL} SELECT name, count(*) AS mention_count, min(id) AS first_seen, max(id) AS last_seen FROM entities GROUP BY name")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    e = G.extract_entities(plain_texts(spark, sf))
    return e.groupBy("name").agg(F.count("*").alias("mention_count"), F.min("id").alias("first_seen"), F.max("id").alias("last_seen"))


@query("f15_entity_search", f"WITH {ENTITIES_SQL} SELECT name, count(*) AS mentions FROM entities WHERE contains(lower(name), 'co') GROUP BY name ORDER BY mentions DESC, name LIMIT 10")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    e = G.extract_entities(plain_texts(spark, sf)).where(F.contains(F.lower("name"), F.lit("co")))
    return e.groupBy("name").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(10)


EDGES_SQL = """edges0 AS (SELECT event_id AS edge_id, event_id AS memory_id, 'u' || user_id AS source, 'u' || ((user_id * 7 + event_id) % 150) AS target, CASE WHEN event_id % 4 = 0 THEN 'co_occurs' ELSE event_type END AS relation, value / 100.0 AS weight, ts AS created_at FROM events),
edges AS (SELECT *, CASE WHEN relation <> 'co_occurs' THEN lead(edge_id) OVER w END AS superseded_by, CASE WHEN relation <> 'co_occurs' THEN lead(created_at) OVER w END AS valid_until FROM edges0 WINDOW w AS (PARTITION BY source, target, relation ORDER BY created_at, edge_id)),
act AS (SELECT * FROM edges WHERE valid_until IS NULL AND superseded_by IS NULL),
bw AS (SELECT source AS node, target AS other, memory_id, weight FROM act UNION ALL SELECT target, source, memory_id, weight FROM act)"""


def raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("edge_id"),
        F.col("event_id").alias("memory_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("u"), ((F.col("user_id") * 7 + F.col("event_id")) % 150).cast("string")).alias("target"),
        F.when(F.col("event_id") % 4 == 0, "co_occurs").otherwise(F.col("event_type")).alias("relation"),
        (F.col("value") / 100.0).alias("weight"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.supersede(raw_edges(spark, sf))


@query("w8_edge_supersession", f"WITH {EDGES_SQL} SELECT edge_id, superseded_by FROM edges")
def w8(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).select("edge_id", "superseded_by")


@query("f5_active_edges", f"WITH {EDGES_SQL} SELECT edge_id, source, target FROM act")
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return G.active(edges(spark, sf)).select("edge_id", "source", "target")


@query("f6_valid_at", f"WITH {EDGES_SQL} SELECT edge_id FROM edges WHERE created_at <= TIMESTAMP '2024-01-15 00:00:00' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 00:00:00')")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    return G.valid_at(edges(spark, sf).withColumn("valid_from", F.col("created_at")), F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("edge_id")


@query("p1_entity_edges", f"WITH {EDGES_SQL} SELECT edge_id, CASE WHEN source = 'u7' THEN target ELSE source END AS other FROM edges WHERE source = 'u7' OR target = 'u7'")
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).where("source = 'u7' OR target = 'u7'").select("edge_id", F.when(F.col("source") == "u7", F.col("target")).otherwise(F.col("source")).alias("other"))


@query("p2_fact_timeline", f"WITH {EDGES_SQL} SELECT edge_id, relation, valid_until IS NULL AND superseded_by IS NULL AS active FROM edges WHERE source = 'u3' OR target = 'u3'")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).where("source = 'u3' OR target = 'u3'").orderBy("created_at")
    return e.select("edge_id", "relation", (F.col("valid_until").isNull() & F.col("superseded_by").isNull()).alias("active"))


@query("j3_edges_entities", f"WITH {EDGES_SQL}, n AS (SELECT 'u' || c_custkey AS name, c_mktsegment AS seg FROM customer) SELECT e.edge_id, a.seg AS source_seg, b.seg AS target_seg FROM edges e JOIN n a ON e.source = a.name JOIN n b ON e.target = b.name")
def j3(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("seg"))
    e = raw_edges(spark, sf)
    return e.join(n.toDF("source", "source_seg"), "source").join(n.toDF("target", "target_seg"), "target").select("edge_id", "source_seg", "target_seg")


@query("a4_graph_stats", f"WITH {EDGES_SQL}, m AS (SELECT n AS name, count(*) AS mentions FROM (SELECT source AS n FROM edges0 UNION ALL SELECT target FROM edges0) GROUP BY n) SELECT name, mentions, (SELECT count(*) FROM m) AS entities, (SELECT count(*) FROM edges0) AS edges FROM m ORDER BY mentions DESC, name LIMIT 10")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return G.statistics(raw_edges(spark, sf))


#: A walk from two entities; a fifth of an entity's mentions is what it counts, 2 at most.
WALK_SQL = f"""{EDGES_SQL},
f0 AS (SELECT n AS node, least(count(*) / 5.0, 2.0) AS boost FROM (SELECT source AS n FROM edges0 UNION ALL SELECT target FROM edges0) WHERE n IN ('u1', 'u2') GROUP BY n),
r0 AS (SELECT b.*, boost FROM f0 JOIN bw b USING (node)),
f1 AS (SELECT other AS node, max(boost) * 0.5 AS boost FROM r0 WHERE other NOT IN (SELECT node FROM f0) GROUP BY other),
r1 AS (SELECT b.*, boost FROM f1 JOIN bw b USING (node)),
f2 AS (SELECT other AS node, max(boost) * 0.5 AS boost FROM r1 WHERE other NOT IN (SELECT node FROM f0 UNION SELECT node FROM f1) GROUP BY other),
r2 AS (SELECT b.*, boost FROM f2 JOIN bw b USING (node)),
sc AS (SELECT memory_id, weight * boost AS s FROM r0 UNION ALL SELECT memory_id, weight * boost / 2 FROM r1 UNION ALL SELECT memory_id, weight * boost / 3 FROM r2)"""


@query("r3_graph_walk", f"WITH {WALK_SQL} SELECT memory_id, round(max(s), 9) AS score FROM sc GROUP BY memory_id")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    """From a question's text: the entities that it names are where the walk begins."""
    from keepstone.operators.search import graph_scores

    names = G.both_ways(raw_edges(spark, sf)).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("mentions"))
    out = graph_scores('what is known of "u1" and "u2"?', names, edges(spark, sf))
    return out.select(F.col("id").alias("memory_id"), F.round("score", 9).alias("score"))


@query("j15_hops", f"WITH {WALK_SQL} SELECT node, 0 AS hop FROM f0 UNION ALL SELECT node, 1 FROM f1 UNION ALL SELECT node, 2 FROM f2")
def j15(spark: SparkSession, sf: str) -> DataFrame:
    e = G.both_ways(G.active(edges(spark, sf))).select("node", "other").distinct()
    zero = spark.createDataFrame([("u1", 0), ("u2", 0)], "node string, hop int")
    one = zero.join(e, "node").select(F.col("other").alias("node")).distinct().join(zero, "node", "left_anti").select("node", F.lit(1).alias("hop"))
    two = one.join(e, "node").select(F.col("other").alias("node")).distinct().join(zero.unionByName(one), "node", "left_anti").select("node", F.lit(2).alias("hop"))
    return zero.unionByName(one).unionByName(two)


@query(
    "p3_related",
    f"WITH {EDGES_SQL}, e AS (SELECT DISTINCT source AS node, target AS other FROM edges0 UNION SELECT target, source FROM edges0), o AS (SELECT other AS name, 1 AS hop FROM e WHERE node = 'u5'), t AS (SELECT e.other AS name, 2 AS hop FROM o JOIN e ON o.name = e.node) SELECT name, min(hop) AS hop FROM (SELECT * FROM o UNION ALL SELECT * FROM t) WHERE name <> 'u5' GROUP BY name ORDER BY hop, name LIMIT 40",
)
def p3(spark: SparkSession, sf: str) -> DataFrame:
    return G.related(raw_edges(spark, sf), "u5", depth=2, limit=40)


@query("p4_delete_for_memory", f"WITH {EDGES_SQL} SELECT edge_id FROM edges0 WHERE memory_id NOT IN (SELECT event_id FROM events WHERE event_type = 'view')")
def p4(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("memory_id"))
    return raw_edges(spark, sf).join(gone, "memory_id", "left_anti").select("edge_id")


TERMS_SQL = f"kt AS (SELECT doc_id AS id, {key_terms_sql('text')} AS t FROM documents), kc AS (SELECT t, min(id) AS id FROM kt GROUP BY t), ex AS (SELECT id, unnest(t) AS w FROM kc), sh AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM ex x JOIN ex y ON x.w = y.w AND x.id < y.id GROUP BY x.id, y.id), jp AS (SELECT a, b FROM sh JOIN kc p ON p.id = a JOIN kc q ON q.id = b WHERE k / (len(p.t) + len(q.t) - k) >= 0.6 UNION ALL SELECT kc.id, kt.id FROM kt JOIN kc ON kt.t = kc.t WHERE kt.id <> kc.id AND len(kt.t) > 0)"


@query("j11_jaccard_pairs", f"WITH {TERMS_SQL} SELECT a, b FROM jp")
def j11(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.key_terms(F.col("text")).alias("terms"))
    return G.jaccard_pairs(t, 0.6)


@query("j9_entity_semijoin", f"WITH {EDGES_SQL} , {MEMORIES_SQL.strip()} SELECT id FROM memories WHERE id IN (SELECT memory_id FROM edges0 WHERE source = 'u9' OR target = 'u9')")
def j9(spark: SparkSession, sf: str) -> DataFrame:
    linked = raw_edges(spark, sf).where("source = 'u9' OR target = 'u9'").select(F.col("memory_id").alias("id"))
    return memories(spark, sf).join(linked, "id", "left_semi").select("id")
