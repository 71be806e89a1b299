"""Near-duplicates by min-max hashing: minimum and maximum under each permutation make two values of a signature.

Links are confirmed on whole shingle sets, and no link is given up within a bucket. Its members
meet the smallest one first, its head. Where that leaves a bucket in several components, members of
different components meet: directly in a small bucket; in a large one those that share one of their rarest
shingles, without one of which no two sets are linked. Before texts are read, a bound on what two sets
can share (from counts of their shingles in bins) rejects pairs, never a link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import at_most, batches, record_batch, setup, stash, unstash

SHINGLE = 5
#: Permutations; a signature has twice as many values. BANDS x ROWS of them make buckets, unless link() is told others.
PERMUTATIONS, BANDS, ROWS = 65, 26, 5
#: Links need percent * union <= 100 * intersection; this is op5's.
PERCENT = 85
#: Bins in which shingles are counted, to tell pairs that can't be linked before their texts are read.
BINS = 512
#: Members of a bucket in which pairs are made directly.
SMALL = 32
#: Members with a rare shingle in common that are held against as many others in one go.
UNIT = 1024
#: Counters of how often shingles occur among the members of large torn buckets; shingles that share one seem more frequent.
COUNTERS = 1 << 18
#: Ids that are broadcast at most (8 bytes each); beyond that joins shuffle.
BROADCAST_IDS = 100_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BASE = 0x9FB21C651E98DF25
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": _powers(_BASE, 1 << 12), "down": _powers(_INVERSE, 1 << 12)}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << n.bit_length()
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[3]
    x = (x ^ (x >> np.uint64(29))) * _M[4]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> tuple[np.ndarray, bytes]:
    """Distinct 64-bit hashes of a text's five-word shingles, sorted, and its words joined by blanks.

    A-Z are lower-cased; words are what lies between the six ASCII blanks. Texts with one to four
    words have one shingle, texts without words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    if not words:
        return np.zeros(0, np.uint64), joined
    data = np.frombuffer(joined + b" ", np.uint8)
    up, down = _grown(len(data) + 1)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)  # of a polynomial, so any word's hash is a difference
    ends = np.flatnonzero(data == 32)
    starts = np.r_[0, ends[:-1] + 1]
    before = np.where(starts > 0, sums[np.maximum(starts, 1) - 1], np.uint64(0))
    word = _mixed((sums[ends] - before) * down[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = (h ^ (h >> np.uint64(31))) * _M[2] + word[i : i + n] * _M[i % 3]
    return np.unique(_mixed(h)), joined


def _permutations(n: int = PERMUTATIONS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


_A, _B = _permutations()


def signature(h: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation in turn, 32 bits each."""
    lo = np.full(PERMUTATIONS, np.uint64((1 << 64) - 1))
    hi = np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(h), 2048):
        x = h[i : i + 2048, None] * _A + _B
        lo = np.minimum(lo, x.min(0))
        hi = np.maximum(hi, x.max(0))
    return (_mixed(np.stack([lo, hi], 1).reshape(-1)) >> np.uint64(32)).astype(np.uint32)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    x = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _M[0]
    for i in range(rows):
        h = _mixed(h + x[:, i] * _M[i % 3])
    return h.view(np.int64)


def histogram(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """How many of a text's shingles fall into each of BINS (empty where one holds more than a byte tells), and a bit for each bin that has any."""
    n = np.bincount((h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b"", np.packbits(n > 0).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, n_shingles, k1 and k2 (a digest of the word sequence; null without words), bands, bins, marks."""

    def run(stream):
        schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bins", pa.binary()), ("marks", pa.list_(pa.int64()))])
        for b in batches(stream):
            cols: dict = {f.name: [] for f in schema if f.name != "id"}
            for t in b.column(1).to_pylist():
                h, joined = shingles(t)
                cols["n_shingles"].append(len(h))
                if not len(h):
                    for c in ("k1", "k2", "bands", "bins", "marks"):
                        cols[c].append(None)
                    continue
                d = hashlib.blake2b(joined, digest_size=16).digest()
                cols["k1"].append(int.from_bytes(d[:8], "big", signed=True))
                cols["k2"].append(int.from_bytes(d[8:], "big", signed=True))
                cols["bands"].append(band_hashes(signature(h), bands, rows))
                counts, marks = histogram(h)
                cols["bins"].append(counts)
                cols["marks"].append(marks)
            yield record_batch(schema, {"id": b.column(0)} | cols)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col]).mapInArrow(run, "id long, n_shingles long, k1 long, k2 long, bands array<long>, bins binary, marks array<long>")


def _alike_in_size(n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m shingles can have the wanted similarity: the smaller over the larger is the most there can be."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _possible(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can be linked: sets share no more than the sum of the lesser counts of each bin. No link is lost."""
    p = pairs.join(bins.select(F.col("id").alias("a"), F.col("bins").alias("bins_a")), "a").join(bins.select(F.col("id").alias("b"), F.col("bins").alias("bins_b")), "b")

    def run(stream):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for r in batches(stream):
            full = [bool(x) and bool(y) for x, y in zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True)]
            keep = np.ones(r.num_rows, bool)
            if any(full):
                told = r.filter(pa.array(full))
                x, y = (np.frombuffer(b"".join(told.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
                most = np.minimum(x, y).sum(1, dtype=np.int64)
                keep[np.array(full)] = 100 * most >= percent * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64) - most)
            yield record_batch(schema, {"a": r.column(0), "b": r.column(1)}).filter(pa.array(keep))

    return p.select("a", "b", "bins_a", "bins_b").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked by their whole sets; texts: id, text, one row for each id."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("i")).distinct(), "ids", narrow=True)
    few = at_most(ids, BROADCAST_IDS)
    wanted = texts.join(F.broadcast(ids) if few else ids, texts["id"] == ids["i"], "left_semi")
    p = pairs.join(wanted.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(wanted.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(stream):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        last, one = None, None
        for r in batches(stream):
            keep = []
            for text_a, text_b in zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True):
                if text_a != last or one is None:
                    last, one = text_a, shingles(text_a)[0]
                other = shingles(text_b)[0]
                shared = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(other) - shared) and shared > 0)
            yield record_batch(schema, {"a": r.column(0), "b": r.column(1)}).filter(pa.array(keep))

    return p.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of edges (a, b).

    Labels fall to the least among the neighbours' and then to their own label's label, until none
    changes; each round is written to the shared folder, and only the number of changes is looked at.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").where("a <> b").distinct(), "edges", narrow=True)
    labels = stash(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", narrow=True)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stash(lower.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels", narrow=True)
        changed = after.where("label <> old").limit(1).count()
        unstash(labels)
        labels = after.drop("old")
        labels._stash_path = after._stash_path
        if not changed:
            return labels


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """n_shingles, component_id and kept for each row: id, n_shingles long, component_id, kept boolean.

    Documents with a Jaccard similarity of ``percent`` hundredths or more between their distinct
    five-word shingles are linked; component_id is the smallest id reachable. Rows of one id count
    as one document for reaching others; each of them is returned. Rows with a null id are linked with
    nothing: component_id null, kept true. Empty and null texts have no shingles and no links.
    A lower ``percent`` needs ``bands`` of fewer ``rows``; they have to fit in a signature. Of the
    pairs that share a bucket no link is lost: what rejects a pair unread is a bound, not an estimate.
    """
    if not 0 < bands * rows <= 2 * PERMUTATIONS:
        raise ValueError(f"{bands} bands of {rows} don't fit in a signature of {2 * PERMUTATIONS} values")
    setup(docs.sparkSession)
    signed = stash(sign(docs, id_col, text_col, bands, rows), "signed")
    named = signed.where("id IS NOT NULL AND k1 IS NOT NULL")
    # equal word sequences are one class, represented by its smallest id
    classes = stash(named.groupBy("k1", "k2").agg(F.min("id").alias("rep")), "classes")
    owned = named.join(classes, ["k1", "k2"])
    members = stash(owned.where("id <> rep").select(F.col("id").alias("b"), F.col("rep").alias("a")).distinct(), "members", narrow=True)
    # members of a class go where its representative goes; only an id of several classes joins them
    several = owned.select("id", "rep").distinct().groupBy("id").agg(F.count("*").alias("classes")).where("classes > 1").select(F.col("id").alias("b"))
    bridges = stash(members.join(several, "b", "left_semi").select("a", "b"), "bridges", narrow=True)
    # an id that represents several classes keeps one row for each; all of them are compared
    reps = stash(owned.where("id = rep").dropDuplicates(["id", "k1", "k2"]).select("id", F.col("n_shingles").alias("n"), "bands", "bins", "marks"), "reps")
    unstash(classes)
    buckets = stash(reps.select(F.explode("bands").alias("bucket"), "id", "n").distinct(), "buckets")
    heads = buckets.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("x"), F.count("*").alias("rows")).where("rows > 1")
    shared = stash(buckets.join(heads.select("bucket", F.col("x.id").alias("head"), F.col("x.n").alias("head_n")), "bucket"), "shared")
    unstash(buckets)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    bins = reps.select("id", "bins")
    met = shared.where((F.col("id") != F.col("head")) & _alike_in_size("n", "head_n", percent)).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    parts = components(_linked(met, bins, texts, percent).unionByName(bridges))
    torn = _torn(shared, parts)
    parts = _joined(parts, _linked(_small_rest(torn, reps.select("id", "marks"), percent), bins, texts, percent))
    rest = _torn(torn.select("bucket", "id", "n"), parts).where(F.col("rows") > SMALL).select("id", "c").distinct()
    rest = stash(rest, "rest", narrow=True)
    if rest.limit(1).count():
        parts = _joined(parts, _linked(_large_rest(rest, bins, texts, percent), None, texts, percent))
    alone = members.join(bridges.select("b").distinct(), "b", "left_anti")
    parts = parts.unionByName(alone.join(parts, alone["a"] == parts["node"], "left").select(F.col("b").alias("node"), F.coalesce("label", "a").alias("label")))
    out = signed.select("id", "n_shingles").join(parts, signed["id"] == parts["node"], "left")
    component = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("id"))).alias("kept"))


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, label) after more links: only the components that these join are looked at."""
    ends = links.join(parts.toDF("a", "la"), "a", "left").join(parts.toDF("b", "lb"), "b", "left")
    joins = stash(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct(), "joins", narrow=True)
    if not joins.limit(1).count():
        return parts
    up = components(joins)
    moved = parts.join(up.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stash(moved.unionByName(up.join(parts.select("node"), "node", "left_anti").select("node", "label")), "labels", narrow=True)


def _linked(pairs: DataFrame, bins: DataFrame | None, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, as a written table; without bins they are known to be possible."""
    possible = stash(_possible(pairs, bins, percent) if bins else pairs, "possible", narrow=True)
    out = stash(_confirmed(possible, texts, percent).distinct(), "links", narrow=True)
    unstash(possible)
    return out


def _torn(shared: DataFrame, parts: DataFrame) -> DataFrame:
    """bucket, id, n, c (component), rows and main (its largest component) for buckets in several components."""
    placed = stash(shared.select("bucket", "id", "n").join(parts, shared["id"] == parts["node"], "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("c")), "placed")
    counts = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    torn = counts.groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("rows"), F.count("*").alias("parts")).where("parts > 1")
    return stash(placed.join(torn.drop("parts"), "bucket"), "torn", narrow=True)


def _small_rest(torn: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of small buckets in different components that can be linked; one is outside the largest component.

    At most SMALL for each member meet. Each bin that only one of two sets has anything in is a difference between them, and linked
    sets differ in at most (100 - percent) / (100 + percent) of their sizes' sum.
    """
    words = BINS // 64
    few = torn.where(F.col("rows") <= SMALL).select("bucket", "id", "n", "c", "main").join(marks, "id")
    few = few.select("bucket", "id", "n", "c", "main", *[F.col("marks")[i].alias(f"x{i}") for i in range(words)])
    outside = few.where("c <> main").select("bucket", F.col("id").alias("o"), F.col("c").alias("oc"), F.col("n").alias("m"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(words)])
    differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(words)), F.lit(0))
    possible = (F.col("c") != F.col("oc")) & _alike_in_size("n", "m", percent) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m")))
    return few.join(outside, "bucket").where(possible).select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often the shingles that fall to each of COUNTERS occur in (id, h); a shingle occurs at most that often."""

    def add(stream, arrays: bool):
        n = np.zeros(COUNTERS, np.int64)
        for b in stream:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            if arrays:
                n += flat.reshape(-1, COUNTERS).sum(0)
            elif len(flat):
                n += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    partial = stash(sets.select("h").mapInArrow(lambda stream: add(stream, False), "n array<long>"), "counters")  # a row a task
    few = partial.repartition(8).mapInArrow(lambda stream: add(stream, True), "n array<long>").collect()
    return np.sum([np.zeros(COUNTERS, np.int64), *[np.array(r["n"]) for r in few]], axis=0)


def _rare(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """id, token: the rarest shingles of each text of the ids in ``rest``, as many as two linked sets can't do without sharing one.

    A set of n has percent * n / 100 shingles in common with any that it is linked with, so of its n less so many, and one more,
    the two share at least one, if both take theirs in the same order; any order will do, and rare ones first
    leaves few to meet. A shingle that no other text has is left out.
    """
    ids = rest.select("id").distinct()
    wanted = texts.join(F.broadcast(ids) if at_most(ids, BROADCAST_IDS) else ids, "id", "left_semi")

    def cut(stream):
        for b in batches(stream):
            found = [shingles(t)[0].view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "h"])

    sets = stash(wanted.mapInArrow(cut, "id long, h array<long>"), "sets")
    often = rest.sparkSession.sparkContext.broadcast(_frequencies(sets).astype(np.int32))  # COUNTERS numbers

    def first(stream):
        for b in batches(stream):
            out = []
            for h in b.column(1):
                h = h.values.to_numpy(zero_copy_only=False)
                n = often.value[h & (COUNTERS - 1)]
                order = np.lexsort((h, n))[: len(h) - -(-percent * len(h) // 100) + 1]
                out.append(h[order][n[order] > 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["id", "tokens"])

    made = sets.mapInArrow(first, "id long, tokens array<long>").select("id", F.explode("tokens").alias("token")).distinct()
    return stash(made, "rare", narrow=True)


def _large_rest(rest: DataFrame, bins: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of large torn buckets in different components that can be linked, for (id, c).

    Members that share one of their rarest shingles meet, those outside the largest component of such a
    group the members of the others, by the bound of _possible(). That is done for pieces of both sides of
    about UNIT rows, so that a task has bounded work and only pairs that pass are written.
    """
    named = _rare(rest, texts, percent).join(rest, "id")
    counts = named.groupBy("token", "c").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("rows"), F.max("k").alias("most")).where("rows > most")
    sizes = stash(sizes.select("token", "main", F.ceil(F.col("rows") / UNIT).cast("int").alias("pieces"), F.ceil((F.col("rows") - F.col("most")) / UNIT).cast("int").alias("blocks")), "sizes", narrow=True)
    placed = named.join(F.broadcast(sizes) if at_most(sizes, BROADCAST_IDS) else sizes, "token").join(bins, "id")
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    inner = placed.select("token", own(F.col("pieces"), "piece").alias("piece"), every(F.col("blocks")).alias("block"), F.lit(False).alias("outer"), "id", "c", "bins")
    outer = placed.where("c <> main").select("token", every(F.col("pieces")).alias("piece"), own(F.col("blocks"), "block").alias("block"), F.lit(True).alias("outer"), "id", "c", "bins")

    def meet(unit: pd.DataFrame) -> pd.DataFrame:
        a, b = unit[unit["outer"]], unit[~unit["outer"]]
        if a.empty or b.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        known = np.array([bool(x) for x in b["bins"]])  # without bins there is no bound
        y = np.frombuffer(b"".join(b["bins"][known]), np.uint8).reshape(-1, BINS)
        m = y.sum(1, dtype=np.int64)
        ids, parts = b["id"].to_numpy(), b["c"].to_numpy()
        found = []
        for i, c, x in zip(a["id"], a["c"], a["bins"], strict=True):
            ok = parts != c
            if x:
                x = np.frombuffer(x, np.uint8)
                n = int(x.sum(dtype=np.int64))
                fit = np.flatnonzero(ok[known] & (100 * np.minimum(m, n) >= percent * np.maximum(m, n)))
                most = np.minimum(y[fit], x).sum(1, dtype=np.int64)
                possible = np.zeros(len(m), bool)
                possible[fit] = 100 * most >= percent * (m[fit] + n - most)
                ok[known] &= possible
            found.append(np.stack([np.minimum(ids[ok], i), np.maximum(ids[ok], i)], 1))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    return inner.unionByName(outer).groupBy("token", "piece", "block").applyInPandas(meet, "a long, b long").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows of ``docs`` that represent their near-duplicate component, with all columns.

    Of rows with one id all stay or all go. Rows with a null id stay.
    """
    gone = link(docs, id_col, text_col, percent, bands, rows).where("NOT kept").select(F.col(id_col).alias("gone_id")).distinct()
    gone = stash(gone, "gone")
    return docs.join(F.broadcast(gone) if at_most(gone, BROADCAST_IDS) else gone, docs[id_col].cast("long") == gone["gone_id"], "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, in plain SQL; too slow on large tables but the same rows.
OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' '))) END AS s FROM w
),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
shared AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.doc_id
"""
