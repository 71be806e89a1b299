"""Packing documents into sequences of a fixed number of tokens, by patterns fitted to the histogram of lengths.

A pattern is a multiset of few lengths that fill a sequence. How often each pattern is used
follows from non-negative least squares: repeats times patterns should give the histogram. The
repeats are rounded, within what there is of each length, and what remains is packed by best fit on
the histogram. The plan depends on the histogram alone, which has an entry for each length; pieces
get their places from their number within their length, on the executors.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import batches, record_batch, setup, stash

CAPACITY = 1024
END = 2
#: Steps of the least-squares fit.
STEPS = 500
#: Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1)
#: Texts over this many characters are encoded by the library, whatever they hold.
LONG = 200_000
#: A length and a number within it make one 64-bit key: 2**44 pieces of a length.
NUMBER = 44


# ---- tokens


class ByteBPE:
    """Ids of a byte-level BPE, as the library that the definition is written for gives them.

    Texts of characters whose classes no Unicode version has changed are encoded by the faster of
    the two libraries, from the same vocabulary; all others by the library itself.
    """

    def __init__(self, definition: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        d = json.loads(definition)
        self.whole = Tokenizer.from_str(definition)
        self.whole.no_truncation()
        self.whole.no_padding()
        special = {t["content"]: t["id"] for t in d["added_tokens"]}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in d["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in d["model"]["merges"]]
        made = [d["model"]["vocab"][a + b] for a, b in pairs]
        byte_level = d["pre_tokenizer"]["type"] == "ByteLevel" and not d["pre_tokenizer"]["add_prefix_space"] and d["normalizer"] is None
        #: The other library takes ids for ranks.
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special) if byte_level and made == sorted(made) else None
        self.settled: set[str] = set()

    def _safe(self, text: str) -> bool:
        if self.fast is None or len(text) > LONG:
            return False
        if text.isascii():
            return True
        new = set(text) - self.settled
        old = unicodedata.ucd_3_2_0.category
        if any(unicodedata.category(c) != (k := old(c)) or k in ("Cn", "Cs", "Co") for c in new):
            return False
        self.settled |= new
        return True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for i, t in enumerate(texts):
            if self._safe(t):
                out[i] = np.array(self.fast.encode(t, allowed_special="all"), "<u4")
            else:
                slow.append(i)
        for i in slow:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, "<u4")
        return out


_MODELS: dict[int, ByteBPE] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: id, piece int, start long, length long, ids_crc32 long, [ids,] and part, nth.

    part is the task that read the document and nth the number of earlier pieces of that length there.
    """
    spark = docs.sparkSession
    setup(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: a fixed size
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = ByteBPE(shared.value)
        model, part = _MODELS[key], TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches(stream):
            cols: dict = {n: [] for n, _ in fields}
            row = []
            for r, ids in enumerate(model.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.append(ids, np.array([end_id], "<u4"))
                first = (len(ids) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if k else 0
                    piece = ids[start:end]
                    row.append(r)
                    n = len(piece)
                    for name, value in zip(cols, (k, start, n, zlib.crc32(piece.tobytes()), part, seen[n], piece.astype(np.int64) if with_ids else None), strict=False):
                        cols[name].append(value)
                    seen[n] += 1
            schema = pa.schema([b.schema.field(0).with_name(id_col), *fields])
            yield record_batch(schema, cols | {id_col: b.column(0).take(pa.array(row, pa.int32()))})

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<long>" * with_ids
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, out)


# ---- the plan


def patterns(there: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three lengths that there are and that fill a sequence, a row each, longest first; 0 is no length."""
    lengths = np.flatnonzero(there)
    a, b = (x.ravel() for x in np.meshgrid(lengths, np.append(lengths, 0), indexing="ij"))
    c = capacity - a - b
    fits = (b <= a) & (c >= 0) & (c <= b)
    a, b, c = a[fits], b[fits], c[fits]
    known = (c == 0) | np.append(there, np.zeros(1, bool))[c]
    return np.stack([a[known], b[known], c[known]], axis=1)


def fit(shapes: np.ndarray, histogram: np.ndarray, capacity: int) -> np.ndarray:
    """Repeats x >= 0 of patterns that minimise the squared gaps between their lengths and the histogram, times the lengths.

    Accelerated projected gradient steps; a product with the matrix of patterns is three look-ups.
    """
    weight = np.sqrt(np.arange(capacity + 1) / capacity)
    goal = weight * histogram
    cols = shapes.T

    def times(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(c, x, capacity + 1) for c in cols)

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        r[0] = 0
        return sum(r[c] for c in cols)

    v = np.ones(len(shapes))
    for _ in range(30):  # the largest eigenvalue
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(STEPS):
        x_new = np.maximum(0, y - back(times(y) - goal) / (1.02 * top))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if np.dot(y - x_new, x_new - x) > 0:  # it overshoots
            t_new = 1.0
        y = x_new + (t - 1) / t_new * (x_new - x) if t_new > 1 else x_new
        x, t = x_new, t_new
    return x


def rounded(shapes: np.ndarray, x: np.ndarray, left: list[int]) -> list[tuple[list[tuple[int, int]], int]]:
    """Repeats rounded down, most repeated first, within what is left of each length, which they are taken from."""
    out = []
    whole = np.floor(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable")[: np.count_nonzero(whole)].tolist():
        row = shapes[i].tolist()
        content = [(k, row.count(k)) for k in dict.fromkeys(row) if k]
        n = min(int(whole[i]), *(left[k] // c for k, c in content))
        if n > 0:
            out.append((content, n))
            for k, c in content:
                left[k] -= n * c
    return out


def best_fit(left: list[int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts of lengths: sequences that have the same content are one entry."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in range(capacity, 0, -1):
        n = left[length]
        for space in range(length, capacity):
            groups = open_.get(space)
            while n and groups:
                content, times = groups.pop()
                each = min(space // length, n)
                used = min(times, n // each)
                if used < times:
                    groups.append((content, times - used))
                open_.setdefault(space - each * length, []).append(([*content, (length, each)], used))
                n -= used * each
            if not n:
                break
        each = capacity // length
        if full := n // each:
            open_.setdefault(capacity - each * length, []).append(([(length, each)], full))
            n -= full * each
        if n:
            open_.setdefault(capacity - n * length, []).append(([(length, n)], 1))
    return [g for groups in open_.values() for g in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Contents of sequences, (length, how many) each, and their repeats, that use up the counts exactly.

    Where much is too long to be filled up, patterns that fill sequences exactly can leave remains that pack badly; so
    the repeats are tried at each of SHARES of the fit, and the plan of the fewest sequences is taken.
    """
    histogram = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        histogram[k] = n
    shapes = patterns(histogram > 0, capacity)
    if not len(shapes):
        return best_fit(histogram.tolist(), capacity)
    x = fit(shapes, histogram.astype(float), capacity)
    tried = []
    for share in SHARES:
        left = histogram.tolist()
        tried.append(rounded(shapes, share * x, left) + best_fit(left, capacity))
    return min(tried, key=lambda contents: sum(times for _, times in contents))


def slots(contents: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces of a length from number ``first`` on take ``each`` places a sequence, from ``sequence`` on, at ``offset``."""
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for content, times in contents:
        offset = 0
        for length, each in content:
            rows.append(((length << NUMBER) + used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {name: np.ascontiguousarray(table[:, i]) for i, name in enumerate(("key", "each", "sequence", "offset"))}


# ---- the operator


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences as it can.

    Returns a row for each piece: id, piece int (from 0), start long, length long, ids_crc32 long
    (of little-endian unsigned 32-bit ids), sequence_id long, offset long and, with_ids, ids.

    A document is its ids and end_id; null and empty texts are end_id alone. Documents over the
    capacity are cut into pieces of it, of which the first may be shorter. Every row is a document: repeated
    rows and ids are packed each, null ids too; other columns have no influence. Very long texts are
    encoded whole, one at a time. An empty table gives no rows.

    The driver holds a count for each length and the plan, whose size depends on the capacity
    alone (about capacity**2 / 12 patterns); pieces are numbered within the task that read
    them, and by running sums over the tasks' counts.
    """
    spark = docs.sparkSession
    cut = stash(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    tally = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task that read
    bases = stash(tally.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts", narrow=True)
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    keep = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    number = F.col("base") + F.col("nth")
    numbered = cut.join(bases.select("length", "part", "base"), ["length", "part"]).select(*keep, number.alias("number"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for b in batches(stream, max_rows=1 << 16):
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            length, number = (cols[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            i = np.searchsorted(at["key"], (length << NUMBER) + number, side="right") - 1
            nth = number - (at["key"][i] & ((1 << NUMBER) - 1))
            each = at["each"][i]
            cols |= {"sequence_id": pa.array(at["sequence"][i] + nth // each), "offset": pa.array(at["offset"][i] + nth % each * length)}
            schema = pa.schema([*[b.schema.field(c) for c in keep], ("sequence_id", pa.int64()), ("offset", pa.int64())])
            yield record_batch(schema, cols)

    kinds = {f.name: f.dataType.simpleString() for f in numbered.schema}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", sequence_id long, offset long"
    return numbered.mapInArrow(run, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens from all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
