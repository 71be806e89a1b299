"""Entities, relationships and walks over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.operators.overlaps import similar_sets
from keepstone.operators.store import stash


def _u(p: str) -> str:
    return f"(?U){p}"


def _loops_kept(pattern: str) -> str:
    """A pattern of an entity whose repeated group isn't tried anew, so that its length takes no stack; it finds the same.

    After a piece of a path comes a slash or its end, and after a name of several words white space or the end of a word, so
    fewer repetitions than all can only match where the last one doesn't end with its word; that is asked of each.
    """
    if pattern.endswith("{2,}"):
        return pattern + "+"
    return re.sub(r"\)\+\)\\b$", lambda _: r"\b)++)", pattern)


def _found(text: Column) -> Column:
    """o, t and n of all that the patterns of entities find in a text, but for names made of stop words."""
    stop = F.array(*[F.lit(w) for w in K.STOP_ENTITIES])
    parts = [F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(?<=[^.!?\n])\b([A-Z][a-z]{2,})\b"), F.lit(1)), lambda n: F.struct(F.lit(0).alias("o"), F.lit("concept").alias("t"), n.alias("n")))]
    for o, (kind, pattern, group) in enumerate(K.ENTITY_PATTERNS, 1):
        found = F.regexp_extract_all(text, F.lit(_u(_loops_kept(pattern))), F.lit(group))
        if kind == "concept":
            found = F.filter(F.transform(found, lambda n: F.trim(n)), lambda n: F.length(n) >= 2)
        parts.append(_tagged(found, o, kind))
    all_stop = lambda n: F.forall(F.split(n, r"\s+"), lambda w: F.array_contains(stop, w))
    return F.filter(F.concat(*parts), lambda e: ~(e["o"].isin(0, 6) & all_stop(e["n"])))


def extract_entities(texts: DataFrame) -> DataFrame:
    """id, name and type of the distinct entities of (id, text). A name found by several patterns has the type of the last;
    single capitalised words inside a sentence are concepts unless another pattern found them."""
    rows = texts.select("id", F.explode_outer(_found(F.col("text"))).alias("e")).where("e IS NOT NULL").select("id", "e.o", "e.t", "e.n")  # an explode is asked for its size first, and so finds all twice
    return rows.groupBy("id", F.col("n").alias("name")).agg(F.max_by("t", "o").alias("type"))


def _tagged(found: Column, order: int, kind: str) -> Column:
    return F.transform(found, lambda n: F.struct(F.lit(order).alias("o"), F.lit(kind).alias("t"), n.alias("n")))


def extract_relationships(texts: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """id, source, target and relation: entities in one sentence (names in alphabetical order), and verbs between two of them.

    Without ``entities`` they are those of extract_entities(), found where the text is (an id once), so only relations are shuffled.
    """
    if entities is None:
        d = texts.select("id", "text", F.array_sort(F.array_distinct(F.transform(_found(F.col("text")), lambda e: e["n"]))).alias("names"))
    else:
        d = texts.join(entities.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("names")), "id")  # of one text
    s = d.select("id", "names", F.explode_outer(F.when(F.size("names") > 0, F.split("text", r"[.!?\n]+"))).alias("s"))
    present = s.select("id", F.filter("names", lambda n: F.contains(F.col("s"), n)).alias("p"), "s")
    one = lambda x, y, relation: F.struct(x.alias("source"), y.alias("target"), F.lit(relation).alias("relation"))
    co = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: one(x, y, "co_occurs"))))
    verbs = []
    for relation, p in K.VERB_PATTERNS:
        verb = re.sub(r"^\(\?i\)\(\\S\+\)\\s\+|\\s\+(\(\?:a\\s\+\)\?)?\(\\S\+\)$", "", p)
        x, y = F.regexp_extract("s", p, 1), F.regexp_extract("s", p, 2)
        told = F.when(F.array_contains("p", x) & F.array_contains("p", y), one(x, y, relation))  # a name that a verb has stands in the sentence
        verbs.append(F.when(F.col("s").rlike(rf"(?i)\s{verb}\s"), told))
    rel = F.when(F.size("p") > 0, F.concat(co, F.array_compact(F.array(*verbs))))
    return present.select("id", F.explode_outer(rel).alias("r")).where("r IS NOT NULL").select("id", "r.source", "r.target", "r.relation").distinct()


def temporal_markers(text: Column) -> dict[str, Column]:
    """valid_from, ended and date_hint of a text."""
    first = F.regexp_extract(text, _u(K.MARK_DATE), 1)
    hint = F.when(first != "", first)
    ended = text.rlike(_u(K.MARK_ENDED))
    return {"valid_from": F.when(ended | text.rlike(_u(K.MARK_CURRENT)), hint), "ended": ended, "date_hint": hint}


def active(edges: DataFrame) -> DataFrame:
    return edges.where("valid_until IS NULL AND superseded_by IS NULL")


def valid_at(edges: DataFrame, at: Column) -> DataFrame:
    return edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def supersede(edges: DataFrame) -> DataFrame:
    """Close each edge when a newer one of the same ends and relation appears; co_occurs edges stay open."""
    w = Window.partitionBy("source", "target", "relation").orderBy("created_at", "edge_id")
    closes = F.col("relation") != "co_occurs"
    return edges.withColumn("superseded_by", F.when(closes, F.lead("edge_id").over(w))).withColumn("valid_until", F.when(closes, F.lead("created_at").over(w)))


def close(edges: DataFrame, which: Column, at: Column) -> DataFrame:
    """Edges with those that are open and meant closed at a time, by hand: no other edge takes their place."""
    return edges.withColumn("valid_until", F.when(which & F.col("valid_until").isNull(), at).otherwise(F.col("valid_until")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: node, other and the other columns."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *rest).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *rest))


def walk(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """memory_id and score of memories on edges within ``hops`` of the seeds (node, boost).

    Score is weight x boost / (1 + hop), the boost halved at each hop; nodes are entered at their
    least distance with the largest boost. One join for each hop; the frontier is aggregated before the next.
    """
    e = both_ways(active(edges))
    frontier = seeds.groupBy("node").agg(F.max("boost").alias("boost"))
    seen, out = frontier.select("node"), None
    for hop in range(hops + 1):
        reached = frontier.join(e, "node")
        scored = reached.select("memory_id", (F.col("weight") * F.col("boost") / (1 + hop)).alias("score"))
        out = scored if out is None else out.unionByName(scored)
        if hop < hops:
            frontier = reached.groupBy(F.col("other").alias("node")).agg((F.max("boost") * 0.5).alias("boost")).join(seen, "node", "left_anti")
            seen = seen.unionByName(frontier.select("node")).distinct()
    return out.groupBy("memory_id").agg(F.max("score").alias("score"))


def related(edges: DataFrame, name: str, depth: int = 1, limit: int = 20) -> DataFrame:
    """Neighbours of an entity, and with a depth over 1 theirs, nearest first."""
    e = both_ways(edges).select("node", "other").distinct()
    one = e.where(F.col("node") == name).select(F.col("other").alias("name"), F.lit(1).alias("hop"))
    if depth > 1:
        two = one.select(F.col("name").alias("node")).join(e, "node").select(F.col("other").alias("name"), F.lit(2).alias("hop"))
        one = one.unionByName(two)
    return one.where(F.col("name") != name).groupBy("name").agg(F.min("hop").alias("hop")).orderBy("hop", "name").limit(limit)


def statistics(edges: DataFrame, top: int = 10) -> DataFrame:
    """Entities with most mentions, and the numbers of entities and edges."""
    m = both_ways(edges).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("mentions"))
    totals = m.agg(F.count("*").alias("entities")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return m.orderBy(F.desc("mentions"), "name").limit(top).crossJoin(F.broadcast(totals))


def components(nodes: DataFrame, edges: DataFrame, stash) -> DataFrame:
    """node and the least node of its component, for nodes (node) and edges (a, b). ``stash`` writes and rereads a table each round."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    labels = stash(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("l", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stash(step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def jaccard_pairs(terms: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of (id, terms) with a Jaccard similarity of at least the threshold.

    Equal sets are one class: its members are paired with the smallest id, and only that one meets others (see similar_sets).
    """
    kept = stash(terms.select("id", F.array_sort("terms").alias("terms")).withColumn("k", F.md5(F.array_join("terms", " "))), "terms")
    reps = stash(kept.groupBy("k").agg(F.min("id").alias("a"), F.min_by("terms", "id").alias("terms")), "classes")
    members = kept.where("size(terms) > 0").select("id", "k").join(reps.select("k", "a"), "k").where("id <> a").select("a", F.col("id").alias("b"))
    return similar_sets(reps.select(F.col("a").alias("id"), "terms"), threshold).unionByName(members)
