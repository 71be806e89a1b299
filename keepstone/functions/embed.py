"""Feature-hashed TF-IDF embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.functions import text as T

DIM = 256


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit x86 form of MurmurHash3, unsigned."""
    mask, c1, c2 = 0xFFFFFFFF, 0xCC9E2D51, 0x1B873593
    h, n = seed, len(data)
    whole = n - n % 4
    blocks = [int.from_bytes(data[i : i + 4], "little") for i in range(0, whole, 4)]
    for i, k in enumerate([*blocks, int.from_bytes(data[whole:], "little")]):
        k = k * c1 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * c2 & mask
        if i < len(blocks):
            h = ((h << 13 | h >> 19) * 5 + 0xE6546B64) & mask
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h


def murmur3_all(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """The same for many pieces of one buffer, all pieces of a length together."""
    out = np.full(len(starts), seed, np.uint32)

    def mixed(k: np.ndarray) -> np.ndarray:
        k = k * np.uint32(0xCC9E2D51)
        return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)

    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        h = out[own]
        for i in range(0, n, 4):
            k = np.zeros(len(own), np.uint32)
            for j in range(min(4, n - i)):
                k |= data[starts[own] + i + j].astype(np.uint32) << np.uint32(8 * j)
            h ^= mixed(k)
            if i + 4 <= n:
                h = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(n)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
        out[own] = h
    return out


def _counted(lists: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """For lists of terms the sums of their signs by bucket, and which buckets they have at all (lists x dim each)."""
    signs, has = np.zeros((len(lists), dim)), np.zeros((len(lists), dim), bool)
    coded = lists.flatten().dictionary_encode()
    terms = coded.dictionary  # each is hashed once
    if len(terms):
        _, offsets, data = terms.buffers()
        ends = np.frombuffer(offsets, np.int32)[terms.offset : terms.offset + len(terms) + 1].astype(np.int64)
        raw, starts, sizes = np.frombuffer(data, np.uint8), ends[:-1], np.diff(ends)
        bucket = murmur3_all(raw, starts, sizes, 0).astype(np.int64) % dim
        sign = np.where(murmur3_all(raw, starts, sizes, 1) < 1 << 31, 1.0, -1.0)
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        index = coded.indices.to_numpy()
        at = row * dim + bucket[index]
        signs = np.bincount(at, sign[index], len(lists) * dim).reshape(signs.shape)
        has.reshape(-1)[at] = True
    return signs, has


def _damped(signs: np.ndarray, n_docs: int, frequency: dict[int, int]) -> np.ndarray:
    """Signed counts damped by the logarithm, weighted by inverse document frequency, of length 1."""
    v = np.sign(signs) * (1 + np.log(np.maximum(np.abs(signs), 1)))
    if n_docs:
        v = v * np.log(1 + n_docs / (1 + np.array([frequency.get(b, 0) for b in range(v.shape[1])])))
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def vector(terms: list[str], n_docs: int = 0, frequency: dict[int, int] | None = None, dim: int = DIM) -> np.ndarray:
    """The embedding of one list of terms."""
    return _damped(_counted(pa.array([terms], pa.list_(pa.string())), dim)[0], n_docs, frequency or {})[0]


def terms_of(texts: DataFrame) -> DataFrame:
    """id and terms (words, and pairs of adjacent words) of (id, text). The words are a column first, so that they are found once for each text."""
    t = texts.select("id", T.tokenize(F.col("text")).alias("t"))
    return t.select("id", F.concat("t", T.bigrams(F.col("t"))).alias("terms"))


def document_frequency(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """bucket and the number of texts that have it, for (id, text): at most ``dim`` rows."""

    def buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            n = _counted(b.column(0), dim)[1].sum(0)
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(n[hit], pa.int64())], ["bucket", "n"])

    return terms_of(texts).select("terms").mapInArrow(buckets, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def embed(texts: DataFrame, n_docs: int = 0, frequency: dict[int, int] | None = None, dim: int = DIM) -> DataFrame:
    """id and embedding (array of floats) for (id, text); zeros for a text without terms."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v = _damped(_counted(b.column(1), dim)[0], n_docs, frequency or {}).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), pa.array(v.reshape(-1)))], ["id", "embedding"])

    return terms_of(texts).mapInArrow(make, f"id {texts.schema['id'].dataType.simpleString()}, embedding array<float>")


def hashed(texts: DataFrame, dim: int = DIM) -> DataFrame:
    """id, signs (sums by bucket) and has (the buckets that it has) of (id, text): what frequencies() and embedded() need, for one pass over texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            signs, has = _counted(b.column(1), dim)
            ends = np.concatenate(([0], np.cumsum(has.sum(1)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(np.arange(0, signs.size + 1, dim, dtype=np.int32), pa.array(signs.astype(np.float32).reshape(-1)))  # whole numbers
            yield pa.RecordBatch.from_arrays([b.column(0), listed, pa.ListArray.from_arrays(ends, pa.array(np.nonzero(has)[1].astype(np.int32)))], ["id", "signs", "has"])

    return terms_of(texts).mapInArrow(count, f"id {texts.schema['id'].dataType.simpleString()}, signs array<float>, has array<int>")


def frequencies(rows: DataFrame) -> DataFrame:
    """As document_frequency(), of rows of hashed()."""
    return rows.select(F.explode("has").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def embedded(rows: DataFrame, n_docs: int = 0, frequency: dict[int, int] | None = None, dim: int = DIM) -> DataFrame:
    """As embed(), of rows of hashed()."""

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            v = _damped(b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim), n_docs, frequency or {}).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), pa.array(v.reshape(-1)))], ["id", "embedding"])

    return rows.select("id", "signs").mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<float>")
