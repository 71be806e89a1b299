"""What happens when memories are written: duplicates, contradictions, consolidation, reflection and the whole path."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import embed as E
from keepstone.functions import text as T
from keepstone.operators import events as V
from keepstone.operators import graph as G
from keepstone.operators import overlaps as O
from keepstone.operators.retrieval import dot
from keepstone.operators.store import stash
from keepstone.operators.summaries import summaries

#: Members of a piece of a part at most, where vectors have 64 numbers: two pieces meet in a task. And members up to which a part isn't cut only to give all tasks something.
PIECE, WHOLE = 65_536, 2_048
#: Cells that pieces make are dealt over so many partitions at most.
MOST_CELLS = 1_024


def _coded(rows: DataFrame) -> DataFrame:
    """id, part, fresh and code of (id, part, fresh, embedding): a code is the vector in bytes, their scale and how far they are off."""

    def codes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                v = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                scale = np.maximum(np.abs(v).max(axis=1), np.float32(1e-30)) / np.float32(127)
                small = np.rint(v / scale[:, None]).astype(np.int8)
                off = np.linalg.norm(v - small * scale[:, None], axis=1).astype(np.float32)
                code = [small[i].tobytes() + scale[i].tobytes() + off[i].tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code, pa.binary())], ["id", "part", "fresh", "code"])

    return rows.select("id", "part", "fresh", F.col("embedding").cast("array<float>").alias("v")).mapInArrow(codes, "id long, part long, fresh boolean, code binary")


def _met(rows: DataFrame, threshold: float, dimensions: int) -> DataFrame:
    """Pairs (a, b, sure), a fresh, of (id, part, fresh, embedding) of a part whose unit vectors may reach the threshold; all of them.

    Parts are cut into pieces, and each two pieces of a part meet in a task as bytes. Only pairs leave it whose product reaches the
    threshold but for what the bytes are off, and they are sure where it does so in spite of that. A row is sent to each piece of
    its part, so what is shuffled grows with the rows and the pieces; the products are those of all pairs of a part.
    """
    spark = rows.sparkSession
    n = F.col("n").cast("double")
    sizes = stash(rows.groupBy("part").agg(F.count("*").alias("n")), "sizes")
    alike = sizes.agg(F.sum(n * n)).first()[0] or 0.0
    piece = min(PIECE, max(256, PIECE * 64 // dimensions), max(WHOLE, math.ceil(math.sqrt(alike / (2 * spark.sparkContext.defaultParallelism)))))
    full = sizes.where(F.col("n") > piece).select("part", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))  # a row for so many members
    n_cells = full.agg(F.sum(F.col("pieces").cast("long") * (F.col("pieces") + 1) / 2)).first()[0] or 0
    cut = _coded(rows).join(F.broadcast(full), "part", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cells = cut.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "fresh", "code")

    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in parts:
            if not b.num_rows:
                continue
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
            starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(starts, starts[1:]):
                if cell != tuple(at[:, lo]):
                    yield from _near(held, cell, threshold)
                    cell, held = tuple(at[:, lo]), []
                held.append(b.slice(lo, hi - lo))
        yield from _near(held, cell, threshold)

    dealt = min(MOST_CELLS, max(2 * spark.sparkContext.defaultParallelism, int(n_cells)))
    return cells.repartition(dealt, "part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(pairs, "a long, b long, sure boolean")


def _near(held: list[pa.RecordBatch], cell: tuple[int, int, int] | None, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the members of a cell (two pieces of a part, or one piece alone) that may reach the threshold, and whether they do for sure."""
    n = sum(b.num_rows for b in held)
    if n < 2:
        return
    own, ids, fresh = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (3, 4, 5))
    raw = np.frombuffer(b"".join(x for b in held for x in b.column(6).to_pylist()), np.uint8).reshape(n, -1)
    order = np.lexsort((~fresh, own))  # of each piece the fresh ones first
    own, ids, fresh, raw = own[order], ids[order], fresh[order], raw[order]
    told = raw[:, -8:].copy().view(np.float32)
    v = raw[:, :-8].copy().view(np.int8).astype(np.float32) * told[:, :1]
    off = told[:, 1]
    least = threshold - 2 * (1 + off.max()) * off.max() - 1e-5
    alone = cell[1] == cell[2]
    begin = int((own == cell[1]).sum())
    for i in range(0, begin, 1024):
        x_end = min(i + 1024, begin)
        for j in range(i if alone else begin, n, 4096):
            if not (fresh[i] or fresh[j]):  # nor any after them
                break
            x, y = np.nonzero((s := v[i:x_end] @ v[j : j + 4096].T) >= least)
            s = s[x, y]
            x, y = x + i, y + j
            slack = off[x] + off[y] + off[x] * off[y] + np.float32(1e-5)
            ok = (y > x) & (fresh[x] | fresh[y]) & (ids[x] != ids[y]) & (s >= threshold - slack)
            x, y, sure = x[ok], y[ok], (s >= threshold + slack)[ok]
            if len(x):
                turned = ~fresh[x] | (fresh[y] & (ids[y] < ids[x]))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(turned, ids[y], ids[x])), pa.array(np.where(turned, ids[x], ids[y])), pa.array(sure)], ["a", "b", "sure"])


def _reach(met: DataFrame, a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of _met() whose vectors, of (a, va) and (b, vb), have a dot product of at least the threshold; only those that aren't sure are looked up."""
    met = stash(met, "met")
    told = met.where("NOT sure").join(a, "a").join(b, "b").where(dot("va", "vb") >= threshold)
    return met.where("sure").select("a", "b").unionByName(told.select("a", "b"))


def every_similar_pair(vectors: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """Pairs (a < b) within a block whose unit vectors (id, embedding) have a dot product of at least the threshold: all of them, those of copies too.

    Of n copies there are n (n - 1) / 2 pairs; similar_pairs() has the same groups with fewer.
    """
    d = vectors.where("embedding IS NOT NULL").dropna(subset=block).select(F.col("id").cast("long").alias("id"), F.xxhash64(*block).alias("part"), F.lit(True).alias("fresh"), "embedding")
    d = stash(d, "vectors")
    first = d.select(F.size("embedding").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    va, vb = (d.select(F.col("id").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab")
    return _reach(_met(d, threshold, first["n"]), va, vb, threshold)


def similar_pairs(vectors: DataFrame, threshold: float, block: list[str]) -> DataFrame:
    """Pairs (a < b) within a block whose unit vectors (id, embedding) have a dot product of at least the threshold.

    Equal vectors are one class: its members are paired with the smallest id, and only that one meets others, so that groups are
    those of all pairs (see every_similar_pair). All classes of a block meet; dot products decide.
    """
    vectors = vectors.where("embedding IS NOT NULL")
    classes = vectors.groupBy(*block, "embedding").agg(F.min("id").alias("id"))
    reps = stash(classes, "classes")
    members = vectors.join(reps.withColumnRenamed("id", "a"), [*block, "embedding"]).where("id <> a").select("a", F.col("id").alias("b"))
    first = reps.select(F.size("embedding").alias("n")).first()
    if first is None:
        return members
    met = _met(reps.dropna(subset=block).select(F.col("id").cast("long").alias("id"), F.xxhash64(*block).alias("part"), F.lit(True).alias("fresh"), "embedding"), threshold, first["n"])
    va, vb = (reps.select(F.col("id").alias(k), F.col("embedding").alias(f"v{k}")) for k in "ab")
    return _reach(met, va, vb, threshold).unionByName(members)


@dataclass
class Groups:
    """Groups of similar vectors that grow by batches: what has been added is kept below a path, by batch, and never read by pairs again.

    Vectors are written once; each batch meets all of them. Equal vectors are one: only the first of each is stored for others to meet. labels (id, label) has a version for each batch, in which groups that a batch has joined are one.
    """

    spark: SparkSession
    path: str
    threshold: float
    dimensions: int
    expected: int
    batches: int = 0

    @classmethod
    def start(cls, spark: SparkSession, path: str, threshold: float, dimensions: int, expected: int) -> Groups:
        """expected: rows that are to come in all, about; it doesn't bear on results."""
        return cls(spark, path, threshold, dimensions, expected)

    def _so_far(self, name: str, schema: str) -> DataFrame:
        made = [f"{self.path}/{name}/{k}" for k in range(self.batches)]
        return self.spark.read.schema(schema).parquet(*made) if made else self.spark.createDataFrame([], schema)

    def labels(self) -> DataFrame:
        """id and label, the smallest id of its group, after the batches so far."""
        schema = "id long, label long"
        return self.spark.read.schema(schema).parquet(f"{self.path}/labels/{self.batches - 1}") if self.batches else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        at = f"{self.path}/{name}/{self.batches}"
        rows.write.mode("overwrite").parquet(at)  # a batch that is repeated after a failure takes its own place
        return self.spark.read.schema(rows.schema).parquet(at)

    def add(self, batch: DataFrame) -> DataFrame:
        """Take a batch of unit vectors (id, embedding), ids that aren't there yet; the labels after it."""
        old_vectors, old_labels = self._so_far("vectors", "id long, embedding array<double>, h long"), self.labels()
        rows = batch.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("h", F.xxhash64("embedding"))
        firsts = rows.groupBy("h", "embedding").agg(F.min("id").alias("id"))
        known = old_vectors.select(F.col("id").alias("there"), "h", F.col("embedding").alias("e"))
        found = stash(firsts.join(known, (firsts["h"] == known["h"]) & (firsts["embedding"] == known["e"]), "left").select("id", "embedding", firsts["h"], "there"), "firsts")
        rep = found.select("h", "embedding", F.coalesce("there", "id").alias("rep"))
        equal = rows.join(rep, ["h", "embedding"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        new = self._write(found.where("there IS NULL").select("id", "embedding", "h"), "vectors")
        every = old_vectors.unionByName(new)
        flagged = old_vectors.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))).withColumn("part", F.lit(0).cast("long"))
        met = _met(flagged.select("id", "part", "fresh", "embedding"), self.threshold, self.dimensions)
        va, vb = new.select(F.col("id").alias("a"), F.col("embedding").alias("va")), every.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
        near = _reach(met, va, vb, self.threshold).unionByName(equal)
        # groups that the batch joins: only their labels, and the batch's ids, are in the graph
        ends = near.join(old_labels.toDF("b", "l"), "b", "left").select("a", F.coalesce("l", "b").alias("b"))
        nodes = rows.select(F.col("id").alias("node")).union(ends.select("b")).distinct()
        joined = stash(G.components(nodes, stash(ends, "ends"), lambda d: stash(d, "labels")), "joined").toDF("old", "to")
        moved = old_labels.join(joined, old_labels["label"] == joined["old"], "left").select("id", F.coalesce("to", "label").alias("label"))
        out = self._write(moved.unionByName(rows.select("id").join(joined, F.col("id") == joined["old"]).select("id", F.col("to").alias("label"))), "labels")
        self.batches += 1
        return out


def clusters(nodes: DataFrame, pairs: DataFrame, least: int = 1) -> DataFrame:
    """id and cluster (the smallest id linked to it) of nodes (id) in clusters of at least ``least``."""
    labels = G.components(nodes.select(F.col("id").alias("node")), stash(pairs, "pairs"), lambda d: stash(d, "labels"))
    if least > 1:
        big = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("label")
        labels = labels.join(big, "label")
    return labels.select(F.col("node").alias("id"), F.col("label").alias("cluster"))


def merge_duplicates(memories: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories as they are after duplicates are merged, and the versions that this makes.

    A duplicate's newest content takes the place of the first memory's, chains are resolved to their
    first memory, and tags are united. Versions hold what the first memory was: memory_id, content, reason.
    """
    label = clusters(memories.select("id"), pairs)
    d = memories.join(label, "id")
    newest = F.struct("created_at", "id")
    united = d.select("cluster", F.explode_outer("tags").alias("tag")).groupBy("cluster").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    merged = d.groupBy("cluster").agg(F.count("*").alias("merged"), F.max_by("content", newest).alias("content"), F.max_by(F.struct("memory_type", "staleness"), newest).alias("x"))
    rest = memories.drop("content", "tags", "memory_type", "staleness")
    now = rest.join(merged.withColumnRenamed("cluster", "id"), "id").join(united.withColumnRenamed("cluster", "id"), "id")
    now = now.select(*rest.columns, "content", F.col("x.memory_type").alias("memory_type"), F.col("x.staleness").alias("staleness"), "tags", "merged")
    before = memories.join(merged.where("merged > 1").select(F.col("cluster").alias("id")), "id", "left_semi")
    return now, before.select(F.col("id").alias("memory_id"), "content", F.lit("dedup_merge").alias("reason"))


def _first_seen(rows: DataFrame, key: str, value: str, order: list[str], most: int) -> DataFrame:
    """key and an array of the first ``most`` distinct values in an order (columns, the first one descending)."""
    best = F.struct((-F.col(order[0])).alias("o0"), *[F.col(c) for c in order[1:]])
    firsts = rows.groupBy(key, value).agg(F.min(best).alias("o"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("o"))).where(F.col("r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(value))


def consolidate(memories: DataFrame, pairs: DataFrame, least: int = K.CONSOLIDATE_MEMBERS) -> tuple[DataFrame, DataFrame]:
    """A summary for each cluster of similar memories, and what it supersedes (id, superseded_by).

    memories: id, namespace, tags, priority, l3, l2. A summary has the five first abstracts and ten first facts that differ,
    by falling priority, the tags of all and "consolidated", and the largest priority.
    """
    label = clusters(memories.select("id"), pairs, least)
    d = memories.join(label, "id")
    abstracts = _first_seen(d.select("cluster", "l3", "priority", "id"), "cluster", "l3", ["priority", "id"], 5)
    facts = _first_seen(d.select("cluster", "priority", "id", F.posexplode("l2").alias("pos", "fact")), "cluster", "fact", ["priority", "id", "pos"], 10)
    tags = d.select("cluster", F.explode("tags").alias("tag")).groupBy("cluster").agg(F.collect_set("tag").alias("tags"))
    whole = d.groupBy("cluster").agg(F.count("*").alias("n"), F.max("priority").alias("priority"), F.min_by("namespace", "id").alias("namespace"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    s = whole.join(abstracts, "cluster").join(facts, "cluster", "left").join(tags, "cluster", "left")
    told = F.concat_ws("\n", F.concat(F.lit("Consolidated from "), F.col("n").cast("string"), F.lit(" memories:")), listed(F.col("l3")), F.when(F.size("fact") > 0, F.concat(F.lit("\nKey facts:\n"), listed(F.col("fact")))))
    ident = F.concat(F.lit("consolidated-"), F.col("cluster").cast("string"))
    every = F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("consolidated"))))
    out = s.select(ident.alias("id"), told.alias("content"), every.alias("tags"), F.lit("consolidation").alias("source"), "priority", "namespace", "n")
    return out, label.select("id", F.concat(F.lit("consolidated-"), F.col("cluster").cast("string")).alias("superseded_by"))


def _clashing(rows: pa.Table, overlap: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each fact of side 1 its row, the rows of side 0 (marked facts) that contradict it, and how many key terms each shares with it."""
    s = O.Sets(rows)
    neg, opp, foe = (rows[c].to_numpy() for c in ("neg", "opp", "foe"))
    left = np.flatnonzero(s.side == 0)
    postings = s.postings(left, s.n)
    for d in np.flatnonzero(s.side == 1):
        k = O.counted(postings, s.flat[s.at[d] : s.at[d + 1]], len(left))
        against = ((neg[left] != neg[d]) & (k >= 3)) | ((foe[left] & opp[d]) != 0)
        found = against & (k >= overlap) & (s.ids[left] != s.ids[d])
        yield d, left[found], k[found]


def _said(facts: DataFrame, extra: DataFrame) -> DataFrame:
    """What contradictions are found by, of facts (id, text) with any key terms: id, terms, said, neg, opp (opposites in it), foe (their opposites) and the columns of extra."""
    some = list(dict.fromkeys(x for p in K.OPPOSITES for x in p))
    has = F.array_intersect(T.blank_words(F.col("text")), F.array(*[F.lit(x) for x in some]))
    d = stash(facts.select(F.col("id").cast("long").alias("id"), F.xxhash64(F.trim("text")).alias("said"), T.key_terms(F.col("text")).alias("terms"), T.has_negation(F.col("text")).alias("neg"), has.alias("has")), "facts")
    bits = lambda pairs: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.array_contains("has", w), F.lit(1 << some.index(to))).otherwise(F.lit(0)).cast("long") for w, to in pairs])
    told = d.select("id", "said", "neg", bits([(w, w) for w in some]).alias("opp"), bits([t for x, y in K.OPPOSITES for t in ((x, y), (y, x))]).alias("foe"))
    return stash(O.numbered(d.select("id", "terms")).join(told, "id").join(extra, "id"), "facts")


#: Facts that are marked: they have a negation or a word of opposites. Others can only contradict one of those.
_MARKED = "neg OR opp <> 0"


def _against(left: DataFrame, right: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What work gives for cells of facts of _said(): those of the left table as side 0, of the right one as side 1."""
    spark, size = left.sparkSession, F.sum(F.size("terms").cast("long")).alias("n")
    of_left, of_right = (d.agg(size).first()["n"] or 0 for d in (left, right))
    if not of_left or not of_right:
        return spark.createDataFrame([], schema)
    m, n = O.pieces(of_left), O.pieces(of_right, spark.sparkContext.defaultParallelism)
    x, y = (O.packed(d.withColumn("piece", O.dealt(k)), k) for d, k in ((left, m), (right, n)))
    return O.meet(x, m, y, n, work, schema)


def contradiction_pairs(facts: DataFrame, overlap: int = 2, vectors: DataFrame | None = None) -> DataFrame:
    """Pairs (a < b) of (id, text) with at least ``overlap`` key terms in common of which one denies the other; shared, negated, opposed, same.

    That is: only one has a negation and they share three terms, or one has a word and the other its opposite. With unit
    vectors (id, embedding) also the score, their dot product. There can be as many pairs as all facts make; none but those leave a task.
    """
    scored = vectors is not None

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, said, neg, opp, foe = (rows[c].to_numpy() for c in ("id", "said", "neg", "opp", "foe"))
        marked, side = neg | (opp != 0), rows["side"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        v = pc.list_flatten(rows["embedding"]).to_numpy().reshape(len(ids), -1) if scored else None
        w = v[left].astype(np.float64).T if scored else None

        def found() -> Iterator[list[np.ndarray]]:
            for i, (d, c, k) in enumerate(_clashing(rows, overlap)):
                if scored and i % 128 == 0:
                    scores = v[right[i : i + 128]].astype(np.float64) @ w
                once = (ids[c] < ids[d]) | ~marked[d]  # two marked facts meet twice
                c, k = c[once], k[once]
                out = [np.minimum(ids[c], ids[d]), np.maximum(ids[c], ids[d]), k.astype(np.int64), (neg[c] != neg[d]) & (k >= 3), (foe[c] & opp[d]) != 0, said[c] == said[d]]
                yield [*out, scores[i % 128][np.searchsorted(left, c)]] if scored else out

        yield from O.given(found(), ["a", "b", "shared", "negated", "opposed", "same", *(["score"] if scored else [])])

    schema = "a long, b long, shared long, negated boolean, opposed boolean, same boolean" + (", score double" if scored else "")
    every = _said(facts, vectors.select(F.col("id").cast("long").alias("id"), "embedding") if scored else facts.select(F.col("id").cast("long").alias("id")))
    return _against(every.where(_MARKED), every, pairs, schema)


#: Newest facts with and without a negation that all others are held against before those that are left meet all.
NEWEST = (256, 4_096)


def outdated(facts: DataFrame, overlap: int = 2) -> DataFrame:
    """id of the facts (id, text, at) that are the older one of some pair that contradicts each other (see contradiction_pairs);
    of two of a time the one with the larger id. No pair leaves a task.

    One newer fact is enough to be outdated, so facts meet the newest ones first, and only those that are left meet all.
    """

    def older(side: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """Facts of a side that one of the other side is newer than."""
            ids, at = rows["id"].to_numpy(), rows["at"].to_numpy()
            gone = np.zeros(len(ids), bool)
            for d, c, _ in _clashing(rows, overlap):
                first = ids[c] < ids[d]
                later = np.where(first, at[c] >= at[d], at[d] >= at[c])  # the one with the smaller id is not older
                if side:
                    gone[d] = bool((later == first).any())
                else:
                    gone[c[later != first]] = True
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[gone]))], ["id"])

        return found

    every = _said(facts.select("id", "text"), facts.select(F.col("id").cast("long").alias("id"), "at"))
    left, n = every, every.count()
    for k in NEWEST:
        if n <= 4 * k:
            continue
        of = every.select("id", "neg", "at")
        newest = reduce(DataFrame.unionByName, [of.where(F.col("neg") == neg).orderBy(F.desc("at"), "id").limit(k) for neg in (True, False)]).select("id")
        gone = _against(every.join(F.broadcast(newest), "id", "left_semi"), left, older(1), "id long").distinct()
        left = stash(left.join(gone, "id", "left_anti"), "left")
        n = left.count()
    marked, plain = left.where(_MARKED), left.where(f"NOT ({_MARKED})")
    last = _against(marked, every, older(0), "id long").unionByName(_against(plain, every.where(_MARKED), older(0), "id long"))
    gone = last.distinct()
    return gone if left is every else every.select("id").join(left.select("id"), "id", "left_anti").unionByName(gone)


def pair_confidence(score: Column) -> Column:
    """Confidence of a row of contradiction_pairs() whose texts have a similarity; null below 0.3. As T.contradiction() gives it."""
    c = F.when(F.col("negated"), 0.4).otherwise(0.0) + F.when(F.col("opposed"), 0.5).otherwise(0.0) + F.when((score > 0.85) & ~F.col("same"), 0.3).otherwise(0.0)
    return F.when(c >= 0.3, F.least(c, F.lit(1.0)))


def contradicted(new: DataFrame, old: DataFrame, candidates: DataFrame) -> DataFrame:
    """new_id, old_id and confidence of contradictions among candidates (new_id, old_id, score), from (id, content) of both sides."""
    a, b = new.select(F.col("id").alias("new_id"), F.col("content").alias("text_a")), old.select(F.col("id").alias("old_id"), F.col("content").alias("text_b"))
    c = candidates.join(a, "new_id").join(b, "old_id")
    return c.select("new_id", "old_id", T.contradiction(F.col("text_a"), F.col("text_b"), F.col("score")).alias("confidence")).where("confidence IS NOT NULL")


def _told(lines: DataFrame, digests: bool) -> DataFrame:
    """id and text: the texts of (id, place, text) in their order, joined by "; ", or the MD5 of that, for which nothing but its state is held."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ident, held, md5 = None, [], None
        given = lambda: pa.RecordBatch.from_arrays([pa.array([ident]), pa.array([md5.hexdigest() if digests else "; ".join(held)])], ["id", "text"])
        for b in parts:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != ident:
                    if ident is not None:
                        yield given()
                    ident, held, md5 = i, [], hashlib.md5()
                elif digests:
                    md5.update(b"; ")
                if digests:
                    md5.update(text.encode())
                else:
                    held.append(text)
        if ident is not None:
            yield given()

    return lines.repartition("id").sortWithinPartitions("id", "place").select("id", "text").mapInArrow(run, "id string, text string")


def reflect(facts: DataFrame, duplicates: DataFrame, related: DataFrame | Callable[[DataFrame], DataFrame] | None = None, least: int = 3, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """States of facts (id, text, at): id, cluster, state, merged_into; and the summaries that this makes: id, n, text.

    Duplicates (pairs a, b) are superseded by the newest of their group; of what is left, the older one of two facts that
    contradict each other; of what is left then, groups of ``least`` or more related ones (pairs, or what gives the pairs of the ids
    that are left) are merged: a summary has their distinct texts in the order of ids (the first ``most``; n counts all facts), and
    each says which one it went into. States: duplicate, contradicted, merged, kept.
    """
    label = clusters(facts.select("id"), duplicates)
    newest = label.join(facts.select("id", "at"), "id").groupBy("cluster").agg(F.max(F.struct("at", "id"))["id"].alias("newest"))
    d = stash(facts.join(label, "id").join(newest, "cluster").withColumn("duplicate", F.col("newest") != F.col("id")).drop("newest"), "reflected")
    left = d.where("NOT duplicate").select("id", "text", "at")
    older = stash(outdated(left), "older")
    active = stash(left.join(older, "id", "left_anti").select("id", F.trim("text").alias("text")), "active")
    related = related(active.select("id")) if callable(related) else related
    both = facts.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0) if related is None else related.join(active.select(F.col("id").alias("a")), "a").join(active.select(F.col("id").alias("b")), "b").select("a", "b")
    groups = stash(clusters(active.select("id"), both, least).select("id", F.concat(F.lit("summary-"), F.col("cluster").cast("string")).alias("merged_into")), "merged")
    told = active.join(groups, "id")
    lines = told.where("text IS NOT NULL").groupBy(F.col("merged_into").alias("id"), "text").agg(F.min("id").alias("place"))
    summaries_ = told.groupBy(F.col("merged_into").alias("id")).agg(F.count("*").alias("n")).join(_told(lines, digests), "id", "left").select("id", "n", "text")
    states = d.join(older.withColumn("older", F.lit(True)), "id", "left").join(groups, "id", "left")
    state = F.when(F.col("duplicate"), "duplicate").when(F.col("older"), "contradicted").when(F.col("merged_into").isNotNull(), "merged").otherwise("kept")
    return states.select("id", "cluster", state.alias("state"), "merged_into"), summaries_


def since(facts: DataFrame, cursor: int, order: str = "id") -> tuple[DataFrame, Callable[[], int]]:
    """Facts after a cursor, and a function that gives the cursor to go on from once they are dealt with."""
    new = facts.where(F.col(order) > cursor)
    return new, lambda: new.agg(F.max(order)).first()[0] or cursor


def classified(incoming: DataFrame, privacy: str = "strip", redact: bool = False) -> DataFrame:
    """What a new memory (id, content, tags, source, priority, namespace) becomes before it meets others.

    Texts beyond the size limit go; sensitive data is masked with ``redact``; private spans stay in the content but
    not in the public text, from which topics, type, staleness, abstract, facts and the embedding come.
    """
    d = incoming.where(F.octet_length("content") <= 1_000_000)
    d = d.withColumn("content", T.redact_sensitive(F.col("content"))) if redact else d
    d = d.withColumn("public", T.strip_private(F.col("content"), "" if privacy == "strip" else "[PRIVATE]"))
    d = d.withColumn("tags", F.array_union("tags", T.topic_tags(F.col("content"), F.col("tags"))))
    d = d.withColumn("memory_type", T.memory_type(F.col("content"))).withColumn("staleness", T.staleness_class(F.col("content")))
    return d.withColumn("content_tokens", T.estimate_tokens(F.col("content")))


def ingest(existing: DataFrame, incoming: DataFrame, now: datetime, n_docs: int = 0, frequency: dict[int, int] | None = None, redact: bool = False) -> dict[str, DataFrame]:
    """The whole path of writing a batch: memories (all, after it), versions, events and audit rows.

    existing and incoming: id, content, tags, source, priority, namespace, created_at (incoming ids are larger). Memories whose
    embeddings are similar enough to one that is there, or to an earlier one of the batch, are merged into it; those that
    contradict a similar one with enough confidence supersede it. Audit rows tell which were stored and which merged.
    """
    old = existing.withColumn("incoming", F.lit(False))
    new = incoming.withColumn("incoming", F.lit(True))
    d = stash(classified(old.unionByName(new), redact=redact), "classified")
    vectors = stash(E.embed(d.select("id", F.col("public").alias("text")), n_docs, frequency).join(d.select("id", "namespace", "incoming"), "id"), "vectors")
    some = vectors.where(F.exists("embedding", lambda x: x != 0))
    same = stash(every_similar_pair(some.select("id", "embedding", F.lit(0).alias("every")), K.DUPLICATE_AT, ["every"]), "same")
    fresh = d.where("incoming").select("id")
    same = same.join(fresh, same["b"] == fresh["id"], "left_semi")  # what is there already stays apart
    merged, versions = merge_duplicates(d, same)
    merged = classified(merged)
    near = every_similar_pair(some.select("id", "embedding", F.lit(0).alias("every")), K.CONTRADICTION_AT, ["every"])
    near = near.join(fresh, near["b"] == fresh["id"], "left_semi")
    scored = near.join(some.select(F.col("id").alias("a"), F.col("embedding").alias("va")), "a").join(some.select(F.col("id").alias("b"), F.col("embedding").alias("vb")), "b").select(F.col("b").alias("new_id"), F.col("a").alias("old_id"), dot("va", "vb").alias("score"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("score"), "old_id"))).where("r <= 5").drop("r")
    against = contradicted(d.select("id", "content"), d.select("id", "content"), best).where(F.col("confidence") > K.SUPERSEDE_ABOVE)
    superseded = against.groupBy(F.col("old_id").alias("id")).agg(F.max("new_id").alias("superseded_by"))
    memories = stash(merged.join(superseded, "id", "left"), "memories")
    told = V.extract_events(memories.select("id", F.col("content").alias("text")), now.date())
    audit = d.where("incoming").select("id").join(memories.select("id", F.lit(True).alias("alone")), "id", "left").select("id", F.when(F.col("alone"), "store").otherwise("store_merge").alias("action"))
    made = summaries(memories.select("id", F.col("public").alias("text")))
    return {"memories": memories.join(made, "id"), "versions": versions, "events": told, "audit": audit}


def shared(memories: DataFrame, ids: list[int], namespace: str, new_id: Callable[[Column], Column]) -> DataFrame:
    """Copies of memories in another namespace, of general type and stable."""
    d = memories.where(F.col("id").isin(ids))
    return d.withColumn("id", new_id(F.col("id"))).withColumn("namespace", F.lit(namespace)).withColumn("memory_type", F.lit("general")).withColumn("staleness", F.lit("stable"))


def forgotten(memories: DataFrame, ids: DataFrame, **linked: DataFrame) -> dict[str, DataFrame]:
    """memories and tables with a memory_id (edges, events) without those of (id) ``ids``."""
    out = {"memories": memories.join(ids, "id", "left_anti")}
    gone = ids.select(F.col("id").alias("memory_id"))
    return out | {name: d.join(gone, "memory_id", "left_anti") for name, d in linked.items()}
