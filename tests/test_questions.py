"""Many questions in one plan against one at a time, retrieval as of a time against snapshots, spans against points."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstone.operators import intervals
from keepstone.operators import questions as A
from keepstone.operators import search as Q
from keepstone.operators.segments import Segments

NOW = datetime(2024, 6, 12, 10, 0)
START = datetime(2024, 1, 1)
WORDS = [f"word{i}" for i in range(40)]


def _memories(spark, n=80):
    r = random.Random(5)
    rows = []
    for i in range(n):
        told = " ".join(r.choice(WORDS) for _ in range(r.randint(3, 30))) + (" on 2024-03-05" if i % 20 == 3 else "") + (" Alice Jones spoke" if i % 9 == 0 else "")
        at = START + timedelta(hours=37 * i)
        rows.append((i, told, "ab"[i % 2], [f"t{i % 3}"], (i % 10) / 10, at, at, i % 4, at + timedelta(days=1) if i % 3 else None, ["stable", "volatile"][i % 2], i + 1 if i % 13 == 0 else None))
    kinds = "id long, content string, namespace string, tags array<string>, priority double, created_at timestamp_ntz, updated_at timestamp_ntz, access_count int, last_accessed timestamp_ntz, staleness string, superseded_by long"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="module")
def library(spark):
    m = _memories(spark)
    entities = spark.createDataFrame([("Alice Jones", 7), ("Bob Lee", 1)], "name string, mentions long")
    edges = spark.createDataFrame([(9, "Alice Jones", "Bob Lee", 1.0), (30, "Bob Lee", "Carol", 0.5), (31, "Carol", "Dan", 0.5), (40, "Alice Jones", "Carol", 0.25)], "memory_id long, source string, target string, weight double")
    edges = edges.withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
    return A.index_for(spark, m, Q.build_postings(m.select("id", F.col("content").alias("text"))), entities, edges)


ASKED = [
    (1, "word1 word2 word3", None, None, None, None),
    (2, "word4 of Alice Jones in January 2024", None, ["a"], None, None),
    (3, "word5 word6 yesterday", ["t0", "t1"], None, 0.0005, 40),
    (4, "nothing known", [], [], None, None),
    (5, "what did Alice Jones and Bob Lee say about word7 in 2024", None, None, None, 25),
    (6, "word8 word8", ["t9"], None, None, None),
]


def _asked(spark):
    return spark.createDataFrame([(i, q, NOW, t, n, s, b) for i, q, t, n, s, b in ASKED] + [(7, None, NOW, None, None, None, None), (8, "", NOW, None, None, None, None)], "qid long, question string, now timestamp_ntz, tags array<string>, namespaces array<string>, min_score double, token_budget int")


def _rows(d):
    return [(x["id"], round(x["score"], 9), x["rank"], x["warning"]) for x in sorted(d.collect(), key=lambda x: x["rank"])]


@pytest.mark.parametrize("parts", ["all", "text", "vectors"])
def test_many_questions_equal_one_at_a_time(spark, library, parts):
    lib = {"all": library, "text": replace(library, vectors=None, edges=None, entities=None), "vectors": replace(library, postings=None, edges=None)}[parts]
    got = {}
    for x in A.answers(lib, _asked(spark), 6, graph_weight=0.2).collect():
        got.setdefault(x["qid"], []).append((x["id"], round(x["score"], 9), x["rank"], x["warning"]))
    for qid, question, tags, namespaces, least, budget in ASKED:
        one = Q.answer(lib, question, NOW, 6, tags=tags, namespaces=namespaces, min_score=least or 0.0, token_budget=budget, graph_weight=0.2)
        assert sorted(got.get(qid, []), key=lambda x: x[2]) == _rows(one), question
    assert 6 not in got and 7 not in got and got[1]
    if parts == "text":
        assert 4 not in got and 8 not in got


def test_postings_are_joined_in_pieces(spark, library, monkeypatch):
    """More terms than are broadcast: the rows of frequent ones are dealt over several tasks."""
    want = sorted((x["qid"], x["id"], round(x["score"], 9)) for x in A.text_scores(_asked(spark), library.postings).collect())
    monkeypatch.setattr(A, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(A, "SALTED", 3)
    assert sorted((x["qid"], x["id"], round(x["score"], 9)) for x in A.text_scores(_asked(spark), library.postings).collect()) == want and want


def test_choices_and_modes(spark, library):
    m = spark.createDataFrame([(1, "The boat is red and fast."), (2, "Harbour lights at night.")], "id long, content string")
    q = spark.createDataFrame(
        [
            (1, "what colour is the boat", "boat red", ["blue", "red", "green"], 1),
            (2, "what colour is the boat", "boat red", ["red", "blue"], 1),
            (3, "what colour is the boat", "boat yellow train", ["yellow", "Not answerable"], 1),
            (4, "where", "unknown words entirely", ["x", "y"], 0),
            (5, "where is it", "harbour lights boat missing", ["harbour", "missing"], 0),
            (6, "nothing found", "boat", ["a b", "c"], 0),
        ],
        "qid long, question string, answer string, choices array<string>, correct int",
    )
    found = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1), (5, 2, 2)], "qid long, id long, rank int")
    got = {x["qid"]: x for x in A.diagnosed(q, found, m).collect()}
    assert {i: (x["predicted"], x["mode"], x["hits"]) for i, x in got.items()} == {
        1: (1, "OK", 1), 2: (0, "SCORING_FAIL", 1), 3: (1, "RETRIEVAL_FAIL", 1), 4: (0, "RETRIEVAL_FAIL", 0), 5: (0, "PARTIAL_RETRIEVAL", 2), 6: (0, "RETRIEVAL_FAIL", 0),
    }
    assert got[5]["coverage"] == 0.75 and got[5]["best_coverage"] == 0.5
    right = A.accuracy(A.diagnosed(q, found, m).join(q.select("qid", "correct"), "qid"), "mode").collect()
    assert {x["mode"]: (x["n"], x["right"]) for x in right}["RETRIEVAL_FAIL"] == (3, 3)


# ---- as of a time


def test_scores_as_of_equal_those_of_snapshots(spark):
    r = random.Random(8)
    rows = []
    for i in range(60):
        at = START + timedelta(hours=r.randint(0, 400))
        for _ in range(r.randint(1, 3)):
            until = at + timedelta(hours=r.choice([0, 5, 30, 200]))
            last = r.random() < 0.4
            rows.append((i, " ".join(r.choice(WORDS[:8]) for _ in range(r.randint(0, 6))) or None, at, None if last else until))
            if last:
                break
            at = until
    versions = spark.createDataFrame(rows, "id long, text string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    history = A.build_history(versions)
    edges = sorted({x[2] for x in rows} | {x[3] for x in rows if x[3]})
    times = [START - timedelta(days=1), edges[0], edges[7], edges[7] - timedelta(seconds=1), START + timedelta(hours=200), START + timedelta(days=400)]
    asked = [(10 * j + k, q, t) for j, t in enumerate(times) for k, q in enumerate(("word1 word2", "word3", "unknown"))] + [(999, "word1", None)]
    got = {}
    for x in A.scores_as_of(spark.createDataFrame(asked, "qid long, question string, at timestamp_ntz"), history).collect():
        got.setdefault(x["qid"], {})[x["id"]] = round(x["score"], 9)
    for qid, question, t in asked[:-1]:
        live = [(i, text) for i, text, a, b in rows if a <= t and (b is None or t < b)]
        if not live:
            assert qid not in got
            continue
        index = Q.build_postings(spark.createDataFrame(live, "id long, text string"))
        assert got.get(qid, {}) == {x["id"]: round(x["score"], 9) for x in Q.bm25_scores(spark, index, question.split()).collect()}, (qid, t)
    assert 999 not in got and len(got) > 6


def test_answers_as_of_are_the_best_of_all_scores(spark, monkeypatch):
    """In small blocks of questions and texts, with equal texts and more than the limit; no postings are written for it."""
    monkeypatch.setattr(A, "BLOCK_TERMS", 7)
    monkeypatch.setattr(A, "TOGETHER", 2)
    monkeypatch.setattr(A, "TEXTS", 9)
    r = random.Random(5)
    rows = []
    for i in range(80):
        at, until = START + timedelta(hours=r.randint(0, 40)), START + timedelta(hours=r.randint(40, 200))
        text = " ".join(r.choice(WORDS[:6]) for _ in range(r.randint(0, 4)))
        rows += [(i, text, at, until), (i, None if i % 9 == 0 else text + " word1", until, None if i % 4 else until + timedelta(hours=3)), (i, "word1", at, at)]
    history = A.build_history(spark.createDataFrame(rows, "id long, text string, valid_from timestamp_ntz, valid_until timestamp_ntz"))
    times = [START - timedelta(days=1), START + timedelta(hours=30), START + timedelta(hours=90), START + timedelta(days=400)]
    asked = [(10 * j + k, q, t) for j, t in enumerate(times) for k, q in enumerate(("word1 word2", "word3", "unknown", "", None, "word1 word4 word5 unknown"))] + [(999, "word1", None)]
    q = spark.createDataFrame(asked, "qid long, question string, at timestamp_ntz")
    got = sorted((x["qid"], x["rank"], x["id"], round(x["score"], 9)) for x in A.answers_as_of(q, history, 5).collect())
    assert not {"postings", "frequencies"} & {*vars(history)}
    every = {}
    for x in A.scores_as_of(q, history).collect():
        every.setdefault(x["qid"], []).append((-round(x["score"], 9), x["id"]))
    want = sorted((qid, n, i, -s) for qid, found in every.items() for n, (s, i) in enumerate(sorted(found)[:5], 1))
    assert got == want and len(got) == 45
    assert A.answers_as_of(q.limit(0), history, 5).collect() == []
    none = A.build_history(spark.createDataFrame([], "id long, text string, valid_from timestamp_ntz, valid_until timestamp_ntz"))
    assert A.answers_as_of(q, none, 5).collect() == []


def test_followed_index_equals_a_fresh_one(spark, tmp_path):
    """Adds, updates, deletions, ids that come back, deletions of what isn't there, and merges, one after the other."""
    r = random.Random(12)
    index, held = Segments(spark, str(tmp_path / "s")), {}
    asked = spark.createDataFrame([(1, w) for w in WORDS[:3]] + [(2, "word5"), (3, "unknown")], "qid long, term string")
    for step in range(11):
        if step % 4 == 3:
            ids = r.sample(range(60), 9)
            index.delete(spark.createDataFrame([(i,) for i in ids], "id long"))
            held = {i: t for i, t in held.items() if i not in ids}
        else:
            new = {i: " ".join(r.choice(WORDS[:8]) for _ in range(r.randint(0, 6))) or None for i in r.sample(range(60), r.choice([2, 20]))}
            index.put(spark.createDataFrame(list(new.items()), "id long, text string"))
            held |= new
        assert index.total == len(held) and index.words == sum(len((t or "").split()) for t in held.values())
        if step in (0, 5, 10):
            fresh = Q.build_postings(spark.createDataFrame(list(held.items()), "id long, text string"))
            got = {}
            for x in index.scores(asked).collect():
                got.setdefault(x["qid"], {})[x["id"]] = round(x["score"], 9)
            for qid, words in ((1, WORDS[:3]), (2, ["word5"])):
                assert got.get(qid, {}) == {x["id"]: round(x["score"], 9) for x in Q.bm25_scores(spark, fresh, words).collect()}
    assert len(index.parts) < 8 and Segments(spark, str(tmp_path / "none")).scores(asked).collect() == []


# ---- spans and points


@pytest.mark.parametrize("kind", ["timestamp_ntz", "double", "date"])
@pytest.mark.parametrize("end_open", [False, True])
def test_spans_meet_the_points_within(spark, kind, end_open, monkeypatch):
    monkeypatch.setattr(intervals, "SALTED", 7)
    r = random.Random(3)
    make = {"timestamp_ntz": lambda: START + timedelta(minutes=r.choice([r.randint(0, 100_000), 5000])), "double": lambda: r.choice([r.uniform(-50, 50), 0.0, 7.5]), "date": lambda: (START + timedelta(days=r.randint(0, 60))).date()}[kind]
    points = [(i, r.choice("xyz"), make() if i % 19 else None) for i in range(150)]
    spans = []
    for j in range(80):
        a, b = sorted((make(), make()))
        spans.append((j, r.choice("xyz"), None if j % 11 == 0 else a, None if j % 7 == 0 else a if j % 5 == 0 else b))
    spans += [(80, "x", make(), make()), (81, None, None, None)]
    p = spark.createDataFrame(points, f"i long, g string, at {kind}").repartition(3)
    s = spark.createDataFrame(spans, f"j long, g string, lo {kind}, hi {kind}")
    holds = lambda t, a, b: t is not None and (a is None or a <= t) and (b is None or (t < b if end_open else t <= b))
    got = sorted((x["i"], x["j"]) for x in intervals.within(p, s, "at", "lo", "hi", ("g",), end_open).collect())
    assert got == sorted((i, j) for i, g, t in points for j, h, a, b in spans if g == h and holds(t, a, b)) and got
    free = intervals.within(p, s.withColumnRenamed("g", "h"), "at", "lo", "hi", end_open=end_open)
    assert sorted((x["i"], x["j"]) for x in free.collect()) == sorted((i, j) for i, _, t in points for j, _, a, b in spans if holds(t, a, b))
    assert intervals.within(p.where("i < 0"), s, "at", "lo", "hi", ("g",)).collect() == intervals.within(p, s.where("j < 0"), "at", "lo", "hi", ("g",)).collect() == []


def test_long_spans_take_few_bins(spark):
    """A span of a million times the least takes as many bins as a short one."""
    p = spark.range(2000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("at"))
    s = spark.createDataFrame([(0, 0.0, 1999.0), (1, 3.0, 3.0), (2, 5.0, 1000.0), (3, -1e12, 1e12)], "j long, lo double, hi double")
    d = intervals.within(p, s, "at", "lo", "hi")
    assert {x["j"]: x["count"] for x in d.groupBy("j").count().collect()} == {0: 2000, 1: 1, 2: 996, 3: 2000}


def test_spans_are_never_broadcast(spark):
    """Bins and pieces make many rows of each span, which the size of the spans' files doesn't tell."""
    p = spark.range(2000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("at"))
    s = spark.createDataFrame([(0, 0.0, 1999.0), (1, 3.0, 3.0)], "j long, lo double, hi double")
    d = intervals.within(p, s, "at", "lo", "hi")
    assert len(d.collect()) == 2001
    plan = d._jdf.queryExecution().executedPlan().toString()  # as it was run
    assert "SortMergeJoin" in [x for x in plan.splitlines() if "Join" in x][0]


def test_best_texts_and_walks_are_those_of_all_scores(spark, library):
    q = _asked(spark).where("question IS NOT NULL").cache()
    for k in (1, 4, 50):
        ranks = lambda d: sorted((x["qid"], x["rank"], x["id"]) for x in A.best(d, "s", k).collect())  # noqa: B023, E731
        assert ranks(A.text_top(q, library.postings, k)) == ranks(A.text_scores(q, library.postings)) != []
        r = random.Random(k)
        names = ["Alice", "Bob", *[f"N{i}" for i in range(5)]]
        rows = [(r.randrange(60), r.choice(names), r.choice(names), r.choice([0.5, 0.25, 0.25 + 1e-10, r.random()])) for _ in range(400)]
        e = spark.createDataFrame(rows, "memory_id long, source string, target string, weight double").withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
        lib = replace(library, edges=e, entities=spark.createDataFrame([("Alice", 7), ("Bob", 1)], "name string, mentions long"))
        assert ranks(A.walk_scores(q, lib, k=k)) == ranks(A.walk_scores(q, lib)) != []
        assert A.walk_scores(q, lib, k=1).count() < A.walk_scores(q, lib).count()
    assert "text_top" in A.signals.__code__.co_names


def test_parts_are_counted_without_a_shuffle(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(Segments, "_batch", lambda self, postings, texts, gone: plans.append(postings._jdf.queryExecution().toString()))
    Segments(spark, str(tmp_path)).put(spark.createDataFrame([(1, "word1 word2 word1"), (2, None)], "id long, text string"))
    assert plans and "Exchange" not in plans[0]


def test_walks_of_many_nodes_keep_the_best_and_equal_questions_take_one(spark, library, monkeypatch):
    """A hub with 60 neighbours of four memories each, with ties: the k best are those of all scores, far fewer rows are scored, and each set of entities is walked from once."""
    rng = np.random.default_rng(8)
    rows = [(m, "Alice", f"n{m % 60}", round(float(rng.integers(1, 9)) / 10, 1)) for m in range(120)] + [(200 + m, f"n{m % 60}", f"n{(m * 7) % 60}", round(float(rng.integers(-2, 12)) / 10, 1)) for m in range(240)]
    e = spark.createDataFrame(rows, "memory_id long, source string, target string, weight double")
    e = e.withColumn("valid_until", F.lit(None).cast("timestamp_ntz")).withColumn("superseded_by", F.lit(None).cast("long"))
    lib = replace(library, edges=e, entities=spark.createDataFrame([("Alice", 7), ("Bob", 1)], "name string, mentions long"))
    q = spark.createDataFrame([(1, 'what of "Alice"'), (2, 'and "Alice" then'), (3, 'is "Bob" here'), (4, 'both "Bob" and "Alice"')], "qid long, question string")
    rows_of, inner = {}, A.stash
    monkeypatch.setattr(A, "stash", lambda d, name: rows_of.setdefault(name, []).append(inner(d, name)) or rows_of[name][-1])
    every = A.walk_scores(q, lib)
    top = A.walk_scores(q, lib, k=5)
    ranks = [sorted((r["qid"], r["id"], r["rank"]) for r in A.best(d, "graph", 5).collect()) for d in (every, top)]
    assert ranks[0] == ranks[1] and {r[0] for r in ranks[0]} == {1, 2, 4}
    assert top.count() < every.count() / 4
    assert {r["walk"] for r in rows_of["frontier"][0].collect()} <= {1, 3, 4}
