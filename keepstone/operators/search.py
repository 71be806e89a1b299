"""Retrieval from a question's text: stored postings, five signals, fusion and sub-questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import dates as D
from keepstone.functions import embed as E
from keepstone.functions import scoring as S
from keepstone.functions import text as T
from keepstone.functions.decompose import sub_queries
from keepstone.functions.stem import stem, stemmed
from keepstone.operators import events as V
from keepstone.operators import graph as G
from keepstone.operators import retrieval as R
from keepstone.operators.store import scratch

#: Words of a run of postings that a task sorts at once, and texts that are added to it at once.
RUN_WORDS, RUN_TEXTS = 1 << 19, 1_000


@dataclass(frozen=True)
class Postings:
    """A written index: rows (term, id, tf, length) by term, the number of texts and their mean length."""

    path: str
    total: int
    mean: float
    stems: bool
    texts: DataFrame | None = None  # what was indexed (id, text)

    def rows(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """The rows of a few terms; the scan skips row groups without them."""
        return spark.read.parquet(self.path).where(F.col("term").isin(terms))


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term, id, tf, length) of texts (id, t): the words of each text are counted where it is; runs of texts are put in the order of terms."""

    def run(ids: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
        n = np.concatenate([pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) for x in lists]).astype(np.int32)
        coded = pa.concat_arrays([pc.list_flatten(x) for x in lists]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        key, tf = np.unique(place[coded.indices.to_numpy()] * len(n) + np.repeat(np.arange(len(n)), n), return_counts=True)
        term, row = np.divmod(key, max(1, len(n)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order[term])), pa.concat_arrays(ids).take(pa.array(row)), pa.array(tf, pa.int64()), pa.array(n[row])], ["term", "id", "tf", "length"])

    ids, lists, words = [], [], 0
    for b in parts:
        for start in range(0, b.num_rows, RUN_TEXTS):
            some = b.slice(start, RUN_TEXTS)
            ids.append(some.column(0))
            lists.append(some.column(1))
            words += len(pc.list_flatten(some.column(1)))
            if words >= RUN_WORDS:
                yield run(ids, lists)
                ids, lists, words = [], [], 0
    if words:
        yield run(ids, lists)


def counted(words: DataFrame) -> DataFrame:
    """term, id, tf and length for (id, t), an id once: nothing is shuffled, as a text's words are in its row."""
    kind = words.schema["id"].dataType.simpleString()
    return words.select("id", "t").mapInArrow(_counted, f"term string, id {kind}, tf long, length int")


def build_postings(texts: DataFrame, stems: bool = False) -> Postings:
    """Index (id, text), an id once: each text is cut into words and counted in the task that reads it; rows lie in the order of terms within each run.

    With ``stems`` words are Porter stems. Files are those of the tasks, so a frequent term's rows lie in all of them.
    """
    spark = texts.sparkSession
    path = scratch(spark, "postings")
    counted(words_of(texts, stems)).write.option("parquet.block.size", 8 << 20).parquet(path)
    lengths = spark.read.parquet(path).agg(F.sum("tf").alias("words")).first()["words"] or 0
    total = texts.count()
    return Postings(path, total, lengths / total if total else 0.0, stems, texts)


def words_of(texts: DataFrame, stems: bool = False) -> DataFrame:
    """id and t, the words of (id, text) in order."""
    words = texts.select("id", T.tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    return stemmed(words) if stems else words


def bm25_scores(spark: SparkSession, index: Postings, terms: list[str], k1: float = K.BM25_K1, b: float = K.BM25_B) -> DataFrame:
    """id and score of the texts with any of the terms, from the terms' rows alone."""
    terms = list(dict.fromkeys(stem(t.lower()) if index.stems else t.lower() for t in terms))
    rows = index.rows(spark, terms)
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((index.total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    norm = k1 * (1 - b + b * F.col("length") / (index.mean or 1.0))
    scored = rows.join(F.broadcast(df), "term").withColumn("part", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm))  # a row for each term of the question
    # added in the order of the terms, so that equal texts have equal scores to the last bit, wherever their rows come from
    parts = [F.coalesce(F.sum(F.when(F.col("term") == t, F.col("part"))), F.lit(0.0)) for t in terms]
    return scored.groupBy("id").agg(reduce(lambda x, y: x + y, parts, F.lit(0.0)).alias("score"))


def indexed_text(memories: DataFrame) -> DataFrame:
    """(id, text) of all that full-text search looks at: content, abstract, facts and tags."""
    parts = [F.col("content"), *[F.array_join(c, " ") if c in ("l2", "tags") else F.col(c) for c in ("l3", "l2", "tags") if c in memories.columns]]
    return memories.select("id", F.concat_ws(" ", *parts).alias("text"))


def mentioned_entities(query: str, entities: DataFrame) -> DataFrame:
    """Seeds of a walk (node, boost): entities (name, mentions) that a question names; a fifth of the mentions counts, 2 at most."""
    asked = G.extract_entities(entities.sparkSession.createDataFrame([(0, query)], "id long, text string")).select("name").distinct()
    known = entities.join(F.broadcast(asked), "name")  # the names in one question
    return known.select(F.col("name").alias("node"), F.least(F.col("mentions") / 5.0, F.lit(2.0)).alias("boost"))


def graph_scores(query: str, entities: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    return G.walk(edges, mentioned_entities(query, entities), hops).select(F.col("memory_id").alias("id"), "score")


def _at(when: datetime) -> Column:
    return F.lit(when.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def temporal_scores(query: str, memories: DataFrame, now: datetime, limit: int, window_days: int = 90) -> DataFrame | None:
    """id and score by time, None for a question without one: created in a range that it names or near a date,
    or naming such a date in content or tags (looked for in the newest CANDIDATES x limit memories). The best of them counts."""
    parsed = D.parse_query(query, now)
    if not parsed["dates"] and not parsed["ranges"]:
        return None
    created = F.col("created_at")
    found = []
    for lo, hi in parsed["ranges"]:
        inside = memories.where(created.between(_at(lo), _at(hi)))
        found.append(inside.select("id", D.creation_range_score(created, _at(lo), _at(hi)).alias("score")))
    for day in parsed["dates"]:
        near = memories.where(created.between(_at(day - timedelta(days=window_days)), _at(day + timedelta(days=window_days))))
        found.append(near.select("id", S.temporal_similarity(_at(day), created, F.lit("exact")).alias("score")))
    newest = memories.orderBy(F.desc("created_at"), F.desc("id")).limit(K.CANDIDATES * limit)
    named = newest.select("id", F.explode(D.content_dates(F.concat_ws(" ", "content", F.to_json("tags")))).alias("d")).select("id", F.col("d.date").cast("timestamp_ntz").alias("at"), F.col("d.kind").alias("kind"))
    scores = [S.temporal_similarity(_at(day), F.col("at"), F.col("kind")) for day in parsed["dates"]]
    for lo, hi in parsed["ranges"]:
        s = S.temporal_similarity(_at(lo + (hi - lo) / 2), F.col("at"), F.col("kind"))
        scores.append(F.when(F.col("at").between(_at(lo), _at(hi)), F.greatest(s, F.lit(0.9))).otherwise(s))
    found.append(named.select("id", F.array_max(F.array(*scores)).alias("score")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.where("score > 0").groupBy("id").agg(F.max("score").alias("score"))


@dataclass(frozen=True)
class SignIndex:
    """A written index of unit vectors by sign projections: rows (key, id) in the order of keys, and the vectors."""

    path: str
    bits: int
    tables: int
    planes: np.ndarray
    vectors: DataFrame

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """id and score of the best rows among those that share a key with the query, or a key that differs in its most doubtful bit.

        Approximate: how many of the nearest are found depends on how near they are; the tests measure it.
        """
        side = np.asarray(query, np.float64) @ self.planes
        weight = 1 << np.arange(self.bits, dtype=np.int64)
        signs, doubt = (side > 0).reshape(self.tables, self.bits), np.abs(side).reshape(self.tables, self.bits)
        key = signs @ weight
        flipped = key ^ weight[doubt.argmin(1)]
        probes = np.concatenate([key, flipped]) * self.tables + np.tile(np.arange(self.tables), 2)
        ids = self.vectors.sparkSession.read.parquet(self.path).where(F.col("key").isin(probes.tolist())).select("id").distinct()
        return R.vector_top(self.vectors.join(ids, "id", "left_semi"), query, k)


def build_sign_index(vectors: DataFrame, tables: int = 48, rows_in_bucket: int = 256, seed: int = 3) -> SignIndex:
    """Index (id, embedding): bits grow with the number of rows, so that a question reads about 2 x tables x rows_in_bucket of them."""
    spark = vectors.sparkSession
    n = vectors.count()
    first = vectors.select(F.size("embedding").alias("n")).first()
    bits = max(2, math.ceil(math.log2(max(n, 1) / rows_in_bucket)))
    planes = np.random.default_rng(seed).standard_normal((first["n"] if first else 1, bits * tables))
    shared = spark.sparkContext.broadcast(planes)  # dimensions x bits x tables numbers

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in parts:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                key = ((v @ shared.value > 0).reshape(b.num_rows, tables, bits) @ weight) * tables + np.arange(tables)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), tables)))], ["key", "id"])

    path = scratch(spark, "signs")
    made = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(keys, "key long, id long")
    made.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.block.size", 4 << 20).parquet(path)
    return SignIndex(path, bits, tables, planes, vectors)


@dataclass
class Library:
    """What questions are asked of. Parts that are None give no signal.

    memories: id, content, namespace, tags, priority and times; vectors: id, embedding; entities: name, mentions; edges and
    events as their operators make them; n_docs and frequency: what weighs the words of an embedded question.
    """

    memories: DataFrame
    postings: Postings | None = None
    vectors: DataFrame | None = None
    entities: DataFrame | None = None
    edges: DataFrame | None = None
    events: DataFrame | None = None
    n_docs: int = 0
    frequency: dict[int, int] = field(default_factory=dict)
    nearest: Callable[[list[float], int], DataFrame] | None = None  # in the place of exact search


def question_terms(spark: SparkSession, query: str) -> list[str]:
    """Words and pairs of words of a question, as texts are cut."""
    return E.terms_of(spark.createDataFrame([(0, query)], "id long, text string")).first()["terms"]


def signals_of(library: Library, query: str, now: datetime, k: int, graph_weight: float = K.WEIGHT_GRAPH, temporal_weight: float = K.WEIGHT_TEMPORAL, events_weight: float = K.WEIGHT_EVENTS) -> tuple[DataFrame, dict[str, float]]:
    """The ranks of a question's signals (id, signal, rank), and their weights: those of dates and events count only if they find anything.

    Signals are found side by side, each by one job; of each the best k rows reach the driver.
    """
    spark = library.memories.sparkSession
    jobs: dict[str, Callable[[], DataFrame | None]] = {}
    if library.vectors is not None:

        def nearest() -> DataFrame:
            if library.nearest is not None:
                return library.nearest(E.vector(question_terms(spark, query), library.n_docs, library.frequency).tolist(), k)
            return R.vector_top(library.vectors, E.vector(question_terms(spark, query), library.n_docs, library.frequency).tolist(), k)

        jobs["vector"] = nearest
    if library.postings is not None:
        jobs["text"] = lambda: bm25_scores(spark, library.postings, T.full_text_terms(query))
    if library.edges is not None and library.entities is not None:
        jobs["graph"] = lambda: graph_scores(query, library.entities, library.edges)
    jobs["temporal"] = lambda: temporal_scores(query, library.memories, now, k // K.CANDIDATES or 1)
    if library.events is not None:
        jobs["events"] = lambda: V.search_events(library.events, query, now.date(), k)

    def found(name: str) -> list:
        scores = jobs[name]()
        return [] if scores is None else R.ranked(scores, name, k).collect()

    with ThreadPoolExecutor(len(jobs)) as pool:
        ranks = dict(zip(jobs, pool.map(found, jobs), strict=True))
    extra = {"graph": graph_weight} if "graph" in jobs else {}
    extra |= {name: w for name, w in (("temporal", temporal_weight), ("events", events_weight)) if ranks.get(name)}
    rows = [tuple(r) for rs in ranks.values() for r in rs]
    return spark.createDataFrame(rows, f"id {library.memories.schema['id'].dataType.simpleString()}, signal string, rank int"), R.signal_weights(**extra)


def answer(library: Library, query: str, now: datetime, limit: int = 20, decompose: bool = False, min_score: float = 0.0, tags: list[str] | None = None, namespaces: list[str] | None = None, token_budget: int | None = None, scorer=None, **weights: float) -> DataFrame:
    """id, score, rank and warning of the memories that answer a question, from its text alone.

    Each of CANDIDATES x limit rows a signal is fused by rank, boosted, reranked with ``scorer`` where given, decayed and cut to
    the limit. With ``decompose`` each part of the question is answered alone, and the answers are fused by rank with equal weights.
    """
    asked = sub_queries(query) if decompose else [query]
    if len(asked) > 1:
        each = max(limit, 10)
        parts = None
        for i, q in enumerate(asked):
            one = answer(library, q, now, each, False, 0.0, tags, namespaces, None, scorer, **weights).select(F.lit(i).alias("query"), "id", "rank")
            parts = one if parts is None else parts.unionByName(one)
        fused = R.merge_subqueries(parts, limit).where(F.col("score") >= min_score)
        return R.ranked(fused, "parts", limit).join(fused, "id").select("id", "score", "rank")
    ranks, w = signals_of(library, query, now, K.CANDIDATES * limit, **weights)
    signals = [ranks]
    at = _at(now)
    if scorer is None:
        return R.retrieve(library.memories, signals, w, at, limit, tags, namespaces, min_score, token_budget)
    first = R.retrieve(library.memories, signals, w, at, K.RERANK_TOP, tags, namespaces, min_score, None, decay=False)
    again = R.rerank(first, scorer, top_n=K.RERANK_TOP, weight=K.RERANK_WEIGHT)
    return R.finish(again, at, limit, token_budget)


def touched(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with access_count and last_accessed brought up to date by a log of accesses (id, at) that is only appended to."""
    seen = accesses.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    d = memories.join(seen, "id", "left")
    return d.withColumn("access_count", (F.col("access_count") + F.coalesce("n", F.lit(0))).cast("int")).withColumn("last_accessed", F.greatest("last_accessed", "last")).drop("n", "last")
