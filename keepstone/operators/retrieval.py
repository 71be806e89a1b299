"""Ranked retrieval: BM25, exact vector search, rank fusion, boosts and the whole retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import scoring as S
from keepstone.functions import text as T

#: Queries that are sent to the workers at once, and rows that are multiplied with them at once.
QUERY_BLOCK, ROW_BLOCK = 2_048, 512


def postings(texts: DataFrame) -> DataFrame:
    """term, id, tf and length of the text in terms, for (id, text); written once it serves many queries."""
    t = texts.select("id", T.tokenize(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def bm25(texts: DataFrame, terms: list[str], k1: float = K.BM25_K1, b: float = K.BM25_B, by: str | None = None) -> DataFrame:
    """id and score of texts with any of the terms. One pass counts the few terms within each row, another the totals; nothing but
    matching rows is kept. With ``by``, a column of the texts without nulls that comes back too, each of its values has frequencies and totals of its own."""
    own = [by] if by else []
    wanted = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)])
    t = texts.select(*own, "id", T.tokenize(F.col("text")).alias("t"))
    counted = t.select(*own, "id", F.size("t").alias("n"), F.transform(wanted, lambda w: F.size("t") - F.size(F.array_remove("t", w))).alias("tf"))
    sums = counted.groupBy(*own).agg(F.count("*").alias("total"), F.avg("n").alias("mean"), *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(set(terms)))])
    dfs = F.array(*[F.col(f"df{i}") for i in range(len(set(terms)))])
    found = counted.where(F.exists("tf", lambda x: x > 0))
    d = found.join(sums, by) if by else found.crossJoin(F.broadcast(sums))  # one row of totals
    idf = F.transform(dfs, lambda n: F.greatest(F.log((F.col("total") - n + 0.5) / (n + 0.5)), F.lit(1e-6)))
    norm = k1 * (1 - b + b * F.col("n") / F.col("mean"))
    parts = F.zip_with("tf", idf, lambda f, i: i * f * (k1 + 1) / (f + norm))
    return d.select(*own, "id", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("score"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """id and score of the k rows (id, embedding) with the largest dot product; ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", dot("embedding", q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def vector_top_by(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id, score and rank of the k best rows of (id, embedding) for each row of (qid, q); ties to the smaller id.

    Queries are taken in blocks, which are sent to the workers; a worker multiplies batches with a
    block and keeps k rows for each query, so only workers x k rows a query are shuffled.
    """
    spark = vectors.sparkSession
    asked = queries.select("qid", F.col("q").cast("array<double>").alias("q"), F.pmod(F.xxhash64("qid"), F.lit(1 << 20)).alias("h"))
    n_blocks = max(1, -(-asked.count() // block))
    out = None
    for i in range(n_blocks):
        one = asked.where(F.pmod("h", F.lit(n_blocks)) == i).toPandas()  # about ``block`` rows
        if one.empty and out is not None:
            continue
        part = vectors.select("id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(_nearest(spark.sparkContext.broadcast((one["qid"].to_numpy(np.int64), np.array(one["q"].tolist(), np.float64))), k), "qid long, id long, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(shared, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best_s, best_i = np.full((len(qid), k), -np.inf), np.full((len(qid), k), np.iinfo(np.int64).max)
        for whole in parts:
            for start in range(0, whole.num_rows if len(qid) else 0, ROW_BLOCK):
                b = whole.slice(start, ROW_BLOCK)
                s = q @ b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).T
                own = np.flatnonzero((s >= best_s[:, -1:]).any(axis=1))  # the queries for which any of these rows counts
                s = np.concatenate([best_s[own], s[own]], axis=1)
                ids = np.concatenate([best_i[own], np.broadcast_to(b.column(0).to_numpy(zero_copy_only=False), (len(own), b.num_rows))], axis=1)
                top = np.lexsort((ids, -s), axis=1)[:, :k]
                best_s[own], best_i[own] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
        found = best_s > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, found.sum(1))), pa.array(best_i[found]), pa.array(best_s[found])], ["qid", "id", "score"])

    return run


def coverage(words: DataFrame, ids: DataFrame, items: DataFrame, k: int = 1) -> DataFrame:
    """item, id, coverage and rank of the k texts that have most of each item's distinct words.

    words: (id, term), each once, such as stored postings; ids: all texts (id); items: (item, text). Ties to the smaller id. Texts
    without any of the words count as well: of those only the smallest ids can be among an item's best.
    """
    wanted = items.select("item", F.array_distinct(T.tokenize(F.col("text"))).alias("w"))
    asked = wanted.select("item", F.size("w").alias("n"), F.explode("w").alias("term"))
    some = words.select("id", "term").join(asked, "term").groupBy("item", "id").agg((F.count("*") / F.max("n")).alias("coverage"))
    first = ids.select("id").orderBy("id").limit(2 * k)
    none = items.select("item").join(F.broadcast(first), F.lit(True)).withColumn("coverage", F.lit(0.0))  # 2 x k rows
    w = Window.partitionBy("item").orderBy(F.desc("coverage"), "id")
    top = some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    both = top.unionByName(none.select(*top.columns)).groupBy("item", "id").agg(F.max("coverage").alias("coverage"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(scores: DataFrame, signal: str, k: int) -> DataFrame:
    """id, signal and rank of the k best of (id, score)."""
    top = scores.orderBy(F.desc("score"), "id").limit(k)
    return top.select("id", F.lit(signal).alias("signal"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))  # k rows


def signal_weights(graph: float | None = None, temporal: float | None = None, events: float | None = None, vector: float = K.WEIGHT_VECTOR, text: float = K.WEIGHT_TEXT) -> dict[str, float]:
    """Weights of the active signals; vector and text share what the others leave."""
    others = {k: v for k, v in (("graph", graph), ("temporal", temporal), ("events", events)) if v is not None}
    left = max(0.0, 1.0 - sum(others.values()))
    both = vector + text
    return others | {"vector": vector / both * left if both else left / 2, "text": text / both * left if both else left / 2}


def fuse(ranks: DataFrame, weights: dict[str, float], k: int = K.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (id, signal, rank): id and rrf."""
    w = F.lit(0.0)
    for name, value in weights.items():
        w = F.when(F.col("signal") == name, value).otherwise(w)
    return ranks.groupBy("id").agg(F.sum(w / (k + F.col("rank"))).alias("rrf"))


def boosted(rrf: Column, priority: Column, superseded_by: Column) -> Column:
    return rrf * (0.5 + 0.5 * priority) * F.when(superseded_by.isNotNull(), 0.5).otherwise(1.0)


def rerank(results: DataFrame, scorer: Callable[[Column], Column], text: str = "content", top_n: int = 30, weight: float = 0.3, normalise: bool = True) -> DataFrame:
    """Blend the score of the best ``top_n`` rows with a scorer's, brought to 0..1 within them."""
    top = results.orderBy(F.desc("score"), "id").limit(top_n).withColumn("_s", scorer(F.col(text)).cast("double"))
    if normalise:
        w = Window.partitionBy(F.lit(0))  # top_n rows
        lo, hi = F.min("_s").over(w), F.max("_s").over(w)
        top = top.withColumn("_s", F.when(hi > lo, (F.col("_s") - lo) / (hi - lo)).otherwise(0.5))
    return top.withColumn("score", (1 - weight) * F.col("score") + weight * F.col("_s")).drop("_s")


def overlap_scorer(query: str) -> Callable[[Column], Column]:
    """Share of the query's distinct terms that a text has."""
    terms = list(dict.fromkeys(w.lower() for w in T.full_text_terms(query)))
    return lambda text: F.size(F.array_intersect(T.tokenize(text), F.array(*[F.lit(t) for t in terms]))) / max(1, len(terms))


def retrieve(memories: DataFrame, signals: list[DataFrame], weights: dict[str, float], now: Column, limit: int = 20, tags: list[str] | None = None, namespaces: list[str] | None = None, min_score: float = 0.0, token_budget: int | None = None, decay: bool = True) -> DataFrame:
    """Fused, boosted and decayed results with staleness warnings, best first: id, score, rank, warning.

    The signals (ranked()) are small, so the memories are filtered and joined once; filters come
    before the limit.
    """
    ranks = signals[0]
    for s in signals[1:]:
        ranks = ranks.unionByName(s)
    m = memories
    if namespaces:
        m = m.where(F.col("namespace").isin(namespaces))
    if tags:
        m = m.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    fused = fuse(ranks, weights)
    d = m.join(F.broadcast(fused), "id")  # at most the sum of the signals' limits
    priority = S.adjusted_priority(F.col("priority"), F.col("created_at"), F.col("access_count"), F.col("last_accessed"), F.lit(0.0), now)
    d = d.withColumn("score", boosted(F.col("rrf"), priority, F.col("superseded_by"))).where(F.col("score") >= min_score)
    return finish(d, now, limit, token_budget, decay)


def finish(scored: DataFrame, now: Column, limit: int, token_budget: int | None = None, decay: bool = True) -> DataFrame:
    """The best ``limit`` rows of memories with a score: decayed, ranked, cut to a budget of tokens, with warnings."""
    d = scored.orderBy(F.desc("score"), "id").limit(limit)
    if decay:
        d = d.withColumn("score", S.decay_boost(F.col("score"), S.activation(F.col("created_at"), F.col("last_accessed"), F.col("access_count"), now)))
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("tokens", T.estimate_tokens(F.substring("content", 1, 200)))  # limit rows
    if token_budget is not None:
        w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        d = d.withColumn("_u", F.sum("tokens").over(w)).where(F.col("_u") <= token_budget).drop("_u")
    return d.withColumn("warning", S.staleness_warning(F.col("superseded_by"), F.col("staleness"), F.col("updated_at"), now))


def merge_subqueries(results: DataFrame, limit: int, k: int = K.RRF_K) -> DataFrame:
    """Fuse (query, id, rank) of several queries with equal weights."""
    return results.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def choice_score(question: Column, context: Column, choice: Column, others: Column) -> Column:
    """A choice's support in a context: 2 if it stands in it, 1.5 for each of its own words and 0.5 for each word in common."""
    c, ctx = T.tokenize(choice), T.tokenize(context)
    own = F.array_except(c, others)
    return F.when(F.contains(F.lower(context), F.lower(choice)), 2.0).otherwise(0.0) + 1.5 * F.size(F.array_intersect(own, ctx)) + 0.5 * F.size(F.array_intersect(F.array_distinct(c), ctx))
