"""Language identification by nearest centroid over TF-IDF character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import batches, give_back, record_batch, setup, stash, unstash

#: Size of the hashed n-gram space.
BUCKETS = 1 << 13
#: Labelled rows of each language from which the model is fitted, at most.
SAMPLE_PER_LANGUAGE = 600
#: The same for all languages together, where that leaves at least LEAST_PER_LANGUAGE for each.
SAMPLE_ROWS, LEAST_PER_LANGUAGE = 3_000, 100
#: Languages whose rates of sampling are broadcast; with more of them the join shuffles.
BROADCAST_LANGUAGES = 10_000
#: Centroids for each language, rounds of their clustering, and the share of a language's own least similarity that rejects.
CLUSTERS, ROUNDS, SLACK = 4, 8, 0.6
UNKNOWN = "und"
#: Shorter texts are further from every centroid by chance: the least cosine falls with the root of their length.
FULL_LENGTH = 400


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased letters, with one mark for each run of others."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points != 0xD7) & (points != 0xF7))
    mark = np.where(letter, points, 32)
    mark = mark[letter | np.r_[True, letter[:-1]]].astype(np.uint64) + 1  # one mark for a run
    one = mark * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) + mark[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + mark[2:] * np.uint64(0x27D4EB2F165667C5)
    top = np.uint64(64 - BUCKETS.bit_length() + 1)
    out = np.zeros(BUCKETS)
    for h in (one, two * np.uint64(0x9E3779B97F4A7C15), three * np.uint64(0x9E3779B97F4A7C15)):
        if len(h):
            out += np.bincount((h >> top).astype(np.int64), minlength=BUCKETS)
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def inverse_frequency(n_rows: int, n_with: np.ndarray) -> np.ndarray:
    """Smoothed IDF of each bucket, from the number of fitted rows that have it."""
    return (np.log((1 + n_rows) / (1 + n_with)) + 1).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of rows of counts."""
    return _unit(np.log1p(counts, dtype=np.float32) * idf)


def cluster(own: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroids of one language's unit vectors by cosine, from evenly spaced rows, and its least similarity for acceptance.

    That is SLACK times the least cosine with the nearest centroid but for one in a hundred of the rows.
    """
    k = min(CLUSTERS, len(own))
    c = own[np.linspace(0, len(own) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        to = (own @ c.T).argmax(1)
        c = _unit(np.stack([own[to == j].sum(0) if (to == j).any() else c[j] for j in range(k)])).astype(np.float32)
    return c, SLACK * float(np.quantile((own @ c.T).max(1), 0.01))


class CentroidModel:
    """Several centroids for each language, an IDF vector and a least cosine for each language."""

    def __init__(self, languages: list[str], owner: np.ndarray, centroids: np.ndarray, idf: np.ndarray, floor: dict[str, float]) -> None:
        self.languages, self.owner, self.centroids, self.idf, self.floor = languages, owner, centroids, idf, floor

    @classmethod
    def of(cls, idf: np.ndarray, fitted: dict[str, tuple[np.ndarray, float]]) -> CentroidModel:
        """From centroids and least similarity of each language."""
        languages = sorted(fitted)
        owner = np.array([i for i, lang in enumerate(languages) for _ in fitted[lang][0]], int)
        centroids = np.concatenate([np.zeros((0, BUCKETS), np.float32), *[fitted[lang][0] for lang in languages]])
        return cls(languages, owner, centroids, idf, {lang: fitted[lang][1] for lang in languages})

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """For each text: the language, the cosine with its nearest centroid, and whether it is too far away."""
        out: list[tuple[str, float, bool]] = []
        for t in texts:
            if not self.languages or not has_letter(t):
                out.append((UNKNOWN, 0.0, True))
                continue
            near = self.centroids @ weighted(gram_counts(t), self.idf)
            best = int(near.argmax())
            lang, score = self.languages[self.owner[best]], float(min(1.0, max(0.0, near[best])))
            out.append((lang, score, score < self.floor[lang] * min(1.0, len(t) / FULL_LENGTH) ** 0.5))
        return out


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows to learn from: text and lang not null, crc32 of the id as text modulo 4 not 2."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))


def fit_model(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> CentroidModel:
    """Fit on a bounded sample of labelled rows: for each language those with the smallest hash of id and text.

    The sampled texts are read whole, on the executors, which send counts of n-grams on: how many rows
    have each bucket gives the IDF, and one task for each language clusters its at most
    SAMPLE_PER_LANGUAGE vectors. All languages are learned; only BUCKETS counts and the centroids (32 kB each) reach the driver. Equal rows count
    once, texts without a letter don't count; without labelled rows the model knows no language.
    """
    spark = docs.sparkSession
    setup(spark)
    rows = training_rows(docs).select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "text")
    sizes = stash(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages", narrow=True)
    languages = sizes.count()
    if not languages:
        return CentroidModel.of(np.ones(BUCKETS, np.float32), {})
    most = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE_ROWS // languages))
    share = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(most)) / F.col("n")).alias("share"))
    took = rows.join(F.broadcast(share) if languages <= BROADCAST_LANGUAGES else share, "lang").where(F.pmod("h", F.lit(1 << 32)) < F.col("share") * float(1 << 32)).select("lang", "h", "text")

    def count(stream):
        schema = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))])
        for b in batches(stream):
            out = []
            for lang, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if has_letter(t):
                    n = gram_counts(t)
                    at = np.flatnonzero(n)
                    out.append((lang, h, at, n[at]))
            yield record_batch(schema, {f.name: [x[i] for x in out] for i, f in enumerate(schema)})

    counted = stash(took.mapInArrow(count, "lang string, h long, at array<int>, n array<float>").dropDuplicates(["lang", "h"]), "counted", narrow=True)
    n_rows = counted.count()
    n_with = np.zeros(BUCKETS)
    for r in counted.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():  # BUCKETS rows at most
        n_with[r["at"]] = r["n"]
    idf = inverse_frequency(n_rows, n_with)

    def centre(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("h")
        counts = np.zeros((len(own), BUCKETS), np.float32)
        for i, (at, n) in enumerate(zip(own["at"], own["n"], strict=True)):
            counts[i, at] = n
        c, floor = cluster(weighted(counts, idf))
        del counts
        give_back()
        return pd.DataFrame({"lang": own["lang"].iloc[0], "no": np.arange(len(c)), "floor": floor, "vector": [x.tobytes() for x in c]})

    found = counted.groupBy("lang").applyInPandas(centre, "lang string, no int, floor double, vector binary").orderBy("lang", "no").collect()  # CLUSTERS rows a language
    unstash(counted)
    fitted: dict[str, tuple[np.ndarray, float]] = {}
    for lang in {r["lang"] for r in found}:
        own = [r for r in found if r["lang"] == lang]
        fitted[lang] = np.stack([np.frombuffer(r["vector"], np.float32) for r in own]), own[0]["floor"]
    return CentroidModel.of(idf, fitted)


def identify(docs: DataFrame, model: CentroidModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of each whole text.

    Returns id, lang_pred, score (cosine, 0 to 1), rejected, and the columns in ``keep``. Null
    texts and texts without a letter give ``und``, 0 and rejected. Each row is judged alone and
    by its text only; repeated rows, null ids and other columns have no influence. Ties between
    centroids go to the language first in the alphabet. Without fitted rows all are ``und``.
    """
    spark = docs.sparkSession
    setup(spark)
    shared = spark.sparkContext.broadcast(model)  # clusters x languages x BUCKETS numbers
    cols = [id_col, text_col, *[c for c in keep if c not in (id_col, text_col)]]
    carried = [id_col, *[c for c in keep if c != id_col]]
    src = docs.select(*[docs[c] for c in cols])

    def run(stream):
        for b in batches(stream):
            got = shared.value.predict(b.column(1).to_pylist())
            fields = [(c, b.column(cols.index(c)).type) for c in carried]
            schema = pa.schema([*fields, ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
            yield record_batch(schema, {c: b.column(cols.index(c)) for c in carried} | {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]})

    out = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + ["lang_pred string", "score double", "rejected boolean"])
    return src.mapInArrow(run, out)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, fit_model(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))  # nothing is learned from a row without an id either
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
