"""Approximate nearest neighbours by additive quantisation.

Every codebook has full-dimensional entries; a vector is the sum of one entry of each. Encoding is
a beam search over the residuals. The squared norm of each sum is stored, so that a cosine with a
query needs a table of the query's products with all entries, and one look-up for each codebook.
The cosine between a vector and its sum is stored too: angles obey the triangle inequality, so a vector whose
sum is too far from the query can't be among the nearest. All others are ranked by the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import batches, record_batch, setup, stash

#: Vectors on which codebooks are fitted, at most; a bound on the driver's memory.
SAMPLE = 8_000
#: Codebooks and their entries.
BOOKS, ENTRIES = 16, 256
#: Partial sums that the beam keeps.
BEAM = 8
#: Queries that are handled at once.
QUERY_BLOCK = 2_048
#: What single precision may add to a cosine of a sum.
SLACK = 1e-4


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        to = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(to, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, to, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


class AdditiveQuantiser:
    def __init__(self, books: np.ndarray) -> None:
        self.books = books.astype(np.float32)  # books x entries x dimensions
        self.flat = self.books.reshape(-1, self.books.shape[2])
        self.gram = self.flat @ self.flat.T  # products between entries of all books

    def __reduce__(self):
        return AdditiveQuantiser, (self.books,)  # the products are made anew

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 2, seed: int = 0) -> AdditiveQuantiser:
        """Residual k-means first; then, in turns, beam-search codes and least squares for all entries together."""
        rng = np.random.default_rng(seed)
        x = x.astype(np.float32)
        entries = max(1, min(entries, len(x) // 4))
        rest, found = x.copy(), []
        for _ in range(books):
            c = _kmeans(rest, entries, 6, rng)
            found.append(c)
            rest = rest - c[(rest @ c.T * 2 - (c * c).sum(1)).argmax(1)]
        out = cls(np.stack(found))
        for _ in range(rounds):
            codes = out.encode(x)[0]
            n, k = len(x), books * entries
            cols = codes + np.arange(books) * entries
            a = np.zeros((k, k), np.float32)
            for i in range(books):
                for j in range(books):
                    np.add.at(a, (cols[:, i], cols[:, j]), 1)
            b = np.zeros((k, x.shape[1]), np.float32)
            for i in range(books):
                np.add.at(b, cols[:, i], x)
            a[np.arange(k), np.arange(k)] += 1e-2 * max(1.0, n / k)
            b += 1e-2 * max(1.0, n / k) * out.flat
            out = cls(np.linalg.solve(a, b).reshape(out.books.shape))
        return out

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8 for up to 256 entries) and squared norms of the sums; equal vectors get equal codes."""
        got = [self._encode(x[i : i + 512], beam) for i in range(0, len(x), 512)]
        return np.concatenate([c for c, _ in got]), np.concatenate([n for _, n in got])

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        m, k, _ = self.books.shape
        n = len(x)
        own = x.astype(np.float32) @ self.flat.T  # products with all entries
        codes = np.zeros((n, 1, 0), np.int64)
        norm = np.zeros((n, 1), np.float32)  # of the partial sums
        dot = np.zeros((n, 1), np.float32)
        for i in range(m):
            cross = np.zeros((n, codes.shape[1], k), np.float32)
            for j in range(i):
                cross += self.gram[j * k + codes[:, :, j], i * k : (i + 1) * k]
            sq = self.gram.diagonal()[i * k : (i + 1) * k]
            norms = norm[:, :, None] + sq + 2 * cross
            dots = dot[:, :, None] + own[:, None, i * k : (i + 1) * k]
            error = (norms - 2 * dots).reshape(n, -1)
            width = min(beam if i < m - 1 else 1, error.shape[1])
            best = np.argpartition(error, width - 1, axis=1)[:, :width]
            from_, entry = best // k, best % k
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, from_], entry[:, :, None]], axis=2)
            norm, dot = norms.reshape(n, -1)[rows, best], dots.reshape(n, -1)[rows, best]
        return codes[:, 0].astype(np.uint8 if k <= 256 else np.int64), norm[:, 0]

    def compared(self, x: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared norms of the sums, and their cosines with the unit vectors that they stand for; -1 for a small sum, of which nothing follows."""
        total = np.zeros(x.shape)
        for i in range(len(self.books)):
            total += self.books[i][codes[:, i]]
        norm = (total * total).sum(1)
        return norm, np.where(norm > 1e-2, (x * total).sum(1) / np.sqrt(np.maximum(norm, 1e-2)), -1.0)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query its products with all entries: queries x books x entries."""
        return (q.astype(np.float32) @ self.flat.T).reshape(len(q), *self.books.shape[:2])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and v (array of doubles): rows without null id or vector, null or non-finite components, or zero vectors."""
    d = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return d.where(finite).where(F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of ``vectors`` by cosine for each row of ``queries`` (both: id and vector), but itself.

    Returns query_id, rank, vec_id, score double (cosine of the original vectors in double
    precision), ties to the smaller id. Rows with null ids, null or zero vectors or with null or non-finite
    components take no part; vectors of a length other than the most frequent sampled one take none
    either. Codebooks are fitted on the SAMPLE rows of the smallest hash; every row is encoded.
    Queries are taken in blocks of ``block``; each is broadcast and meets all codes. A worker ranks by their original vectors
    all rows that the angles between query, sum and vector don't rule out, and keeps k for each query: none of the nearest is
    missed, however many rows have much the same code.
    Repeated ids are rows of their own; a repeated query id is asked with the smallest of its vectors. With fewer candidates than k
    all are returned. Scoring is exhaustive: each block of queries takes one pass over all codes (BOOKS bytes a row and a norm).
    """
    spark = vectors.sparkSession
    setup(spark)
    every = usable(vectors, id_col, vec_col)
    n = every.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    share = min(1.0, SAMPLE / n)
    picked = every.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).toPandas()["v"]
    sizes = [len(v) for v in picked] or [every.select(F.size("v")).first()[0]]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s))
    x = np.array([v for v in picked if len(v) == dim] or [every.where(F.size("v") == dim).first()["v"]])
    model = AdditiveQuantiser.fit(x / np.linalg.norm(x, axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast(model)  # BOOKS x ENTRIES entries and their products

    def encode(stream):
        for b in batches(stream, max_rows=1024):
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, dim)
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            codes, _ = shared.value.encode(u)
            norm, off = shared.value.compared(u, codes)
            schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("code", pa.binary()), ("norm", pa.float32()), ("off", pa.float64())])
            yield record_batch(schema, {"id": b.column(0), "v": b.column(1), "code": [c.tobytes() for c in codes], "norm": norm, "off": off})

    coded = stash(every.where(F.size("v") == dim).mapInArrow(encode, "id long, v array<double>, code binary, norm float, off double"), "coded")
    asked = stash(usable(queries, id_col, vec_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")), "asked", narrow=True)
    n_blocks = max(1, -(-asked.count() // block))
    parts = []
    for i in range(n_blocks):
        one = asked.where(F.pmod("h", F.lit(n_blocks)) == i).orderBy("id").toPandas()  # about ``block`` queries
        if len(one):
            parts.append(stash(_block(coded, one, shared, k), "nearest", narrow=True))
    if not parts:
        return empty
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block(coded: DataFrame, one, shared, k: int) -> DataFrame:
    """The result for one block of queries."""
    q_ids = one["id"].to_numpy(np.int64)
    told = coded.sparkSession.sparkContext.broadcast((q_ids, np.array(one["v"].tolist(), np.float64)))

    def scan(stream):
        q_ids, q = told.value
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        tables = shared.value.tables(unit)
        books = tables.shape[1]
        # for each query the k best so far, score and id in order, and what the k-th has at least
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        least = np.full(len(q), -np.inf)
        for b in batches(stream, max_rows=4096):
            ids, off = b.column(0).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, books).astype(np.int64)
            norm = 1 / np.sqrt(np.maximum(b.column(3).to_numpy(zero_copy_only=False), 1e-12))
            u = v / np.linalg.norm(v, axis=1, keepdims=True)
            aside = np.sqrt(np.maximum(0, 1 - off * off))
            for j in range(len(q)):
                s = tables[j, 0][codes[:, 0]].copy()
                for m in range(1, books):
                    s += tables[j, m][codes[:, m]]
                s *= norm
                own = ids == q_ids[j]
                if least[j] == -np.inf and b.num_rows > 4 * k:  # a first bound, from the best sums
                    some = np.flatnonzero(~own)
                    some = some[np.argpartition(-s[some], 4 * k - 1)[: 4 * k]] if len(some) > 4 * k else some
                    first = np.sort(u[some] @ unit[j])[::-1]
                    least[j] = first[k - 1] - 1e-9 if len(first) >= k else -np.inf
                rows = np.flatnonzero(_reachable(s, off, aside, least[j]) & ~own)
                if not len(rows):
                    continue
                near = u[rows] @ unit[j]  # but for rounding
                if len(rows) > k:
                    least[j] = max(least[j], np.partition(near, len(near) - k)[len(near) - k] - 1e-9)
                rows = rows[near >= least[j]]
                score, i = np.concatenate([best[j][0], _cosine(q[j], v[rows])]), np.concatenate([best[j][1], ids[rows]])
                top = np.lexsort((i, -score))[:k]
                best[j] = score[top], i[top]
                if len(top) == k:
                    least[j] = max(least[j], score[top[-1]] - 1e-9)
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for i in range(0, len(q), 512):
            part = best[i : i + 512]
            n = [len(x) for _, x in part]
            if sum(n):
                yield record_batch(schema, {"query_id": np.repeat(q_ids[i : i + 512], n), "vec_id": np.concatenate([x for _, x in part]), "score": np.concatenate([x for x, _ in part])})

    near = coded.select("id", "v", "code", "norm", "off").mapInArrow(scan, "query_id long, vec_id long, score double")  # at most k rows a query from each worker
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reachable(s: np.ndarray, off: np.ndarray, aside: np.ndarray, least: float) -> np.ndarray:
    """Whether a vector can have a cosine of ``least`` with the query, whose cosine with its sum is s and its own with that sum ``off``.

    The angle between query and sum is at most that between query and vector and that between vector and sum together.
    """
    if least <= -1:
        return np.ones(len(s), bool)
    most = min(least, 1.0)
    return (s >= most * off - np.sqrt(1 - most * most) * aside - SLACK) | (most <= -off)


def _cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of q and the rows of v, summed in the order of the dimensions: equal vectors get equal cosines, wherever they lie."""
    dot = lambda x, y: np.cumsum(x * y, axis=-1)[..., -1]
    return dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v)))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(e, e.where("vec_id % 50 = 0"))
