"""Ranked retrieval over memories and embeddings."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import embed as E
from keepstone.operators import graph as G
from keepstone.operators import retrieval as R
from keepstone.operators import search as Q
from keepstone.operators.summaries import summaries
from keepstone.plans.data import MEMORIES_SQL, NOW, memories, now, texts
from keepstone.plans.q_events import all_events
from keepstone.plans.q_graph import WALK_SQL, edges, raw_edges
from keepstone.plans.q_memories import _AGE, _STRENGTH
from keepstone.plans.q_text import tokens_sql
from keepstone.plans.registry import query
from keepstone.session import table

TERMS = ["rewh", "nd", "thtion", "oi"]
QUERY_VECTOR = 7
_NOW = f"TIMESTAMP '{NOW}'"
#: Seconds of the month that questions ask for.
RANGE_SQL = "epoch(TIMESTAMP '2024-01-31 23:59:59') - epoch(TIMESTAMP '2024-01-01 00:00:00')"


def bm25_sql(terms: list[str], x: str = "") -> str:
    """CTEs that end in bm (id, score); with a suffix to their names."""
    names = ", ".join(f"('{t}')" for t in terms)
    return f"""tok{x} AS (SELECT doc_id AS id, {tokens_sql('text')} AS t FROM documents),
q{x}(w) AS (VALUES {names}),
tf{x} AS (SELECT id, w, len(t) AS n, len(list_filter(t, lambda x: x = w)) AS f FROM tok{x}, q{x}),
df{x} AS (SELECT w, count(*) FILTER (f > 0) AS df FROM tf{x} GROUP BY w),
tot{x} AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM tok{x}),
bm{x} AS (SELECT id, sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf{x} JOIN df{x} USING (w), tot{x} GROUP BY id HAVING sum(f) > 0)"""


_INDEXES: dict[tuple, Q.Postings] = {}


def files_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another state of it gives another tuple."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def index_of(spark: SparkSession, sf: str, stems: bool = False) -> Q.Postings:
    """The index of the documents, built once for a session and a state of the table."""
    key = spark.sparkContext.applicationId, sf, stems, files_of(spark, f"{sf}/documents.parquet")
    if key not in _INDEXES:
        _INDEXES[key] = Q.build_postings(docs(spark, sf), stems)
    return _INDEXES[key]


_VEC = f"vq AS (SELECT embedding AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR}), vec AS (SELECT vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS score FROM embeddings, vq)"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    return vectors(spark, sf).where(F.col("id") == QUERY_VECTOR).first()["embedding"]


@query("r2_bm25", f"WITH {bm25_sql(TERMS)} SELECT id, round(score, 9) AS score FROM bm ORDER BY score DESC, id LIMIT 100")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    return Q.bm25_scores(spark, index_of(spark, sf), TERMS).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 9).alias("score"))


@query("r2_index", f"WITH t AS (SELECT {tokens_sql('text')} AS t FROM documents) SELECT count(*) AS texts, round(avg(len(t)), 6) AS mean FROM t")
def r2_index(spark: SparkSession, sf: str) -> DataFrame:
    """Builds the index that the questions of a session are asked of."""
    index = index_of(spark, sf)
    return spark.createDataFrame([(index.total, round(index.mean, 6))], "texts long, mean double")


@query("r2_postings", f"WITH t AS (SELECT doc_id AS id, unnest({tokens_sql('text')}) AS term FROM documents) SELECT term, count(*) AS occurrences, count(DISTINCT id) AS texts FROM t GROUP BY term")
def r2_postings(spark: SparkSession, sf: str) -> DataFrame:
    return R.postings(docs(spark, sf)).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("texts"))


@query("r1_vector_top", f"WITH {_VEC} SELECT id, round(score, 9) AS score FROM vec ORDER BY score DESC, id LIMIT 25")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    return R.vector_top(vectors(spark, sf), query_vector(spark, sf), 25).select("id", F.round("score", 9).alias("score"))


#: The queries of a batch search: every fiftieth row, against all rows.
ASKED = "vec_id % 50 = 0"


@query(
    "tk1_vector_batch",
    f"WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE {ASKED}), p AS (SELECT qid, vec_id AS id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings, q) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS INT) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5",
)
def tk1(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "embeddings").where(ASKED).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return R.vector_top_by(vectors(spark, sf), q, 5).select("qid", "id", "rank")


_RANKS = f"""{bm25_sql(TERMS)}, {_VEC},
ranks AS (
  SELECT id, 'text' AS signal, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 100
  UNION ALL SELECT id, 'vector', row_number() OVER (ORDER BY score DESC, id) FROM vec QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 100
)"""


def signals(spark: SparkSession, sf: str, k: int = 100) -> list[DataFrame]:
    return [R.ranked(Q.bm25_scores(spark, index_of(spark, sf), TERMS), "text", k), R.ranked(R.vector_top(vectors(spark, sf), query_vector(spark, sf), k), "vector", k)]


@query("w1_signal_ranks", f"WITH {_RANKS} SELECT id, signal, CAST(rank AS INT) AS rank FROM ranks")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    a, b = signals(spark, sf)
    return a.unionByName(b)


_FUSED = f"{_RANKS}, fused AS (SELECT id, sum(CASE signal WHEN 'text' THEN 0.4 ELSE 0.6 END / (60 + rank)) AS rrf FROM ranks GROUP BY id)"


@query("r7_rank_fusion", f"WITH {_FUSED} SELECT id, round(CAST(rrf AS DOUBLE), 9) AS rrf FROM fused")
def r7(spark: SparkSession, sf: str) -> DataFrame:
    a, b = signals(spark, sf)
    return R.fuse(a.unionByName(b), R.signal_weights()).select("id", F.round("rrf", 9).alias("rrf"))


_PRIORITY = f"priority * pow(0.5, {_AGE} / 30.0) * (1 + ln(1 + access_count) / 10.0) * CASE WHEN last_accessed IS NULL THEN 1.0 ELSE 1 + 0.2 * pow(0.5, epoch({_NOW} - last_accessed) / 86400.0 / 7.0) END"
_SCORED = f"{MEMORIES_SQL}, {_FUSED}, scored AS (SELECT m.*, CAST(f.rrf AS DOUBLE) * (0.5 + 0.5 * ({_PRIORITY})) * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1.0 END AS score FROM memories m JOIN fused f ON m.id = f.id)"


@query("r8_boosts", f"WITH {_SCORED} SELECT id, round(score, 9) AS score FROM scored")
def r8(spark: SparkSession, sf: str) -> DataFrame:
    return R.retrieve(memories(spark, sf), signals(spark, sf), R.signal_weights(), now(), limit=1000, decay=False).select("id", F.round("score", 9).alias("score"))


#: A question that names words, a time, and two entities.
QUESTION = 'rewh nd thtion oi in January 2024 of "u1" and "u2"'
_ASKED_TERMS = ["rewh", "nd", "thtion", "oi", "january", "2024", "u1", "u2"]
_SIGNALS = f"""{bm25_sql(_ASKED_TERMS)}, {_VEC}, {WALK_SQL},
gr AS (SELECT memory_id AS id, max(s) AS score FROM sc GROUP BY memory_id),
tm AS (SELECT doc_id AS id, 0.9 + 0.1 * (1 - least(abs(epoch(created_at) - (epoch(TIMESTAMP '2024-01-01 00:00:00') + ({RANGE_SQL}) / 2)) / 86400.0 / (({RANGE_SQL}) / 86400.0), 1)) AS score
  FROM (SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INT)) AS created_at FROM documents) WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-31 23:59:59'),
every AS (SELECT 'text' AS signal, * FROM bm UNION ALL SELECT 'vector', * FROM vec UNION ALL SELECT 'graph', * FROM gr UNION ALL SELECT 'temporal', * FROM tm),
ranks AS (SELECT id, signal, row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) AS rank FROM every QUALIFY row_number() OVER (PARTITION BY signal ORDER BY score DESC, id) <= 100),
fused AS (SELECT id, sum(CASE signal WHEN 'text' THEN 0.4 * 0.5 WHEN 'vector' THEN 0.6 * 0.5 WHEN 'graph' THEN 0.2 ELSE 0.3 END / (60 + rank)) AS rrf FROM ranks GROUP BY id)"""


def library(spark: SparkSession, sf: str) -> Q.Library:
    """All that questions are asked of; vectors are the supplied ones, so a question's place among them is that of a fixed row."""
    e = edges(spark, sf)
    names = G.both_ways(raw_edges(spark, sf)).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("mentions"))
    return Q.Library(memories(spark, sf), index_of(spark, sf), vectors(spark, sf), names, e, nearest=lambda _, k: R.vector_top(vectors(spark, sf), query_vector(spark, sf), k))


@query("r7_five_signals", f"WITH {_SIGNALS} SELECT id, signal, CAST(rank AS INT) AS rank FROM ranks")
def r7_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The signals of a question, from its text; events have nothing to tell of these texts and so no weight."""
    told = all_events(spark, sf).where("id >= 0")  # of the documents
    return Q.signals_of(replace(library(spark, sf), events=told), QUESTION, datetime(2024, 6, 1), 100, graph_weight=0.2)[0]


_BOOSTED = f"scored AS (SELECT m.*, CAST(f.rrf AS DOUBLE) * (0.5 + 0.5 * ({_PRIORITY})) * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1.0 END AS score FROM memories m JOIN fused f ON m.id = f.id)"
_RETRIEVED = f"{MEMORIES_SQL}, {_SIGNALS}, {_BOOSTED}, top AS (SELECT *, score * (1 + 0.1 * greatest(0, {_STRENGTH})) AS final FROM (SELECT * FROM scored WHERE namespace IN ('en', 'fr') AND list_has_any(tags, ['t0', 't1', 't2', 'u1']) AND score >= 0.001 ORDER BY score DESC, id LIMIT 20)), o AS (SELECT id, final, row_number() OVER (ORDER BY final DESC, id) AS rank, greatest(1, length(substr(content, 1, 200)) // 4) AS tokens FROM top)"


@query("r16_retrieve", f"WITH {_RETRIEVED} SELECT id, round(final, 9) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, sum(tokens) OVER (ORDER BY rank) AS used FROM o) WHERE used <= 600")
def r16(spark: SparkSession, sf: str) -> DataFrame:
    out = Q.answer(library(spark, sf), QUESTION, datetime(2024, 6, 1), limit=20, tags=["t0", "t1", "t2", "u1"], namespaces=["en", "fr"], min_score=0.001, token_budget=600, graph_weight=0.2)
    return out.select("id", F.round("score", 9).alias("score"), "rank")


@query(
    "r9_rerank",
    f"WITH {_SCORED}, top AS (SELECT id, score, len(list_intersect(list_distinct({tokens_sql('content')}), ['rewh', 'nd', 'thtion', 'oi'])) / 4.0 AS s FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 30)), n AS (SELECT min(s) AS lo, max(s) AS hi FROM top) SELECT id, round(0.7 * score + 0.3 * CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.5 END, 9) AS score FROM top, n",
)
def r9(spark: SparkSession, sf: str) -> DataFrame:
    base = R.retrieve(memories(spark, sf), signals(spark, sf), R.signal_weights(), now(), limit=1000, decay=False)
    return R.rerank(base, R.overlap_scorer(" ".join(TERMS))).select("id", F.round("score", 9).alias("score"))


#: A question of two parts; it is asked whole and in parts.
_PARTS = "rewh nd and also thtion oi"
_SUB = [["rewh", "nd", "thtion", "oi"], ["rewh", "nd"], ["thtion", "oi"]]


def part_sql(terms: list[str], x: str, limit: int = 20) -> str:
    """CTEs that end in r (id, rank): the answer to one question by full-text search alone."""
    rank = "row_number() OVER (ORDER BY score DESC, id)"
    return f"""{bm25_sql(terms, x)}, f{x} AS (SELECT id, 0.4 / (60 + {rank}) AS rrf FROM bm{x} QUALIFY {rank} <= {5 * limit}),
s{x} AS (SELECT m.*, CAST(f.rrf AS DOUBLE) * (0.5 + 0.5 * ({_PRIORITY})) * CASE WHEN superseded_by IS NOT NULL THEN 0.5 ELSE 1.0 END AS score FROM memories m JOIN f{x} f ON m.id = f.id ORDER BY score DESC, m.id LIMIT {limit}),
r{x} AS (SELECT id, row_number() OVER (ORDER BY score * (1 + 0.1 * greatest(0, {_STRENGTH})) DESC, id) AS rank FROM s{x})"""


@query(
    "r10_decomposed",
    f"WITH {MEMORIES_SQL}, " + ", ".join(part_sql(t, f"_{i}") for i, t in enumerate(_SUB)) + ", u AS (" + " UNION ALL ".join(f"SELECT id, rank FROM r_{i}" for i in range(3)) + ") SELECT id, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 20",
)
def r10(spark: SparkSession, sf: str) -> DataFrame:
    only_text = Q.Library(memories(spark, sf), index_of(spark, sf))
    return Q.answer(only_text, _PARTS, datetime(2024, 6, 1), limit=20, decompose=True).select("id", F.round("score", 9).alias("score"))


@query("r2_stemmed")
def r2_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    """Full-text search on stems over content, abstract, facts and tags."""
    m = memories(spark, sf).select("id", "content", "tags")
    s = summaries(m.select("id", F.col("content").alias("text")))
    index = Q.build_postings(Q.indexed_text(m.join(s, "id")), stems=True)
    return Q.bm25_scores(spark, index, TERMS).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 9).alias("score"))


@query("r19_details", f"WITH {MEMORIES_SQL} SELECT id, memory_type, md5(content) AS content_md5 FROM memories WHERE id IN (3, 5, 8, 13)")
def r19(spark: SparkSession, sf: str) -> DataFrame:
    return memories(spark, sf).where(F.col("id").isin(3, 5, 8, 13)).select("id", "memory_type", F.md5("content").alias("content_md5"))


@query("r21_what_changed", f"WITH {_SCORED} SELECT id FROM (SELECT id FROM scored WHERE list_contains(tags, 'pinned') UNION SELECT id FROM (SELECT id FROM scored ORDER BY score DESC, id LIMIT 5))")
def r21(spark: SparkSession, sf: str) -> DataFrame:
    base = R.retrieve(memories(spark, sf), signals(spark, sf), R.signal_weights(), now(), limit=1000, decay=False)
    return base.where(F.array_contains("tags", "pinned")).select("id").union(base.orderBy(F.desc("score"), "id").limit(5).select("id")).distinct()


_COVERED = f"tok AS (SELECT doc_id, {tokens_sql('text')} AS t FROM documents), b AS (SELECT item_id, text, list_distinct({tokens_sql('text')}) AS w FROM benchmark), x AS (SELECT item_id, doc_id, len(list_intersect(w, t)) / greatest(len(w), 1) AS c FROM b, tok)"


def covering(spark: SparkSession, sf: str, k: int) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("item"), "text")
    return R.coverage(spark.read.parquet(index_of(spark, sf).path), docs(spark, sf), items, k)


@query("p21_diagnostics", f"WITH {_COVERED}, m AS (SELECT item_id, max(c) AS c FROM x GROUP BY item_id) SELECT item_id, round(c, 6) AS coverage, CASE WHEN c >= 0.8 THEN 'OK' WHEN c >= 0.5 THEN 'PARTIAL_RETRIEVAL' ELSE 'RETRIEVAL_FAIL' END AS mode FROM m")
def p21(spark: SparkSession, sf: str) -> DataFrame:
    c = covering(spark, sf, 1)
    mode = F.when(F.col("coverage") >= 0.8, "OK").when(F.col("coverage") >= 0.5, "PARTIAL_RETRIEVAL").otherwise("RETRIEVAL_FAIL")
    return c.select(F.col("item").alias("item_id"), F.round("coverage", 6).alias("coverage"), mode.alias("mode"))


@query(
    "r22_choice_scores",
    f"WITH {_COVERED}, r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) AS r FROM x QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY c DESC, doc_id) <= 3), ch AS (SELECT b.item_id, {tokens_sql('b.text')} AS t, lower(b.text) AS low, {tokens_sql('n.text')} AS other FROM b JOIN benchmark n ON n.item_id = b.item_id + 1), d AS (SELECT doc_id, lower(text) AS low, {tokens_sql('text')} AS t FROM documents) SELECT ch.item_id, d.doc_id, CAST(CASE WHEN contains(d.low, ch.low) THEN 2.0 ELSE 0.0 END + 1.5 * len(list_intersect(list_filter(list_distinct(ch.t), lambda x: NOT list_contains(other, x)), d.t)) + 0.5 * len(list_intersect(list_distinct(ch.t), d.t)) AS DOUBLE) AS score FROM ch JOIN r ON r.item_id = ch.item_id JOIN d ON d.doc_id = r.doc_id",
)
def r22(spark: SparkSession, sf: str) -> DataFrame:
    """Each item as a choice, with the next item as the other choice, in the three texts that cover it best."""
    from keepstone.functions import text as T

    b = table(spark, sf, "benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") - 1).alias("item_id"), T.tokenize(F.col("text")).alias("other"))
    at = covering(spark, sf, 3).select(F.col("item").alias("item_id"), F.col("id").alias("doc_id"))
    d = at.join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("ctx")), "doc_id").join(b, "item_id").join(other, "item_id")
    return d.select("item_id", "doc_id", R.choice_score(F.lit(""), F.col("ctx"), F.col("text"), F.col("other")).alias("score"))


@query("x3_embed")
def x3(spark: SparkSession, sf: str) -> DataFrame:
    """Feature-hashed embeddings with the corpus's own document frequencies."""
    t = texts(spark, sf)
    freq = {r["bucket"]: r["n"] for r in E.document_frequency(t).collect()}  # 256 rows
    return E.embed(t, t.count(), freq)


@query("x4_document_frequency")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    return E.document_frequency(texts(spark, sf))
