"""Questions, their signals and parts, stems, and what is asked of a calendar, against written-out cases and plain Python."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstone.functions.decompose import sub_queries
from keepstone.functions.stem import stem
from keepstone.operators import calendar as C
from keepstone.operators import events as V
from keepstone.operators import retrieval as R
from keepstone.operators import rotation as R2
from keepstone.operators import search as Q

NOW = datetime(2024, 6, 1)


@pytest.mark.parametrize(
    ("query", "parts"),
    [
        ("pizza", []),
        ("who baked the bread and also who sold it", ["who baked the bread", "who sold it"]),
        ("we painted the fence and they mowed the lawn", ["we painted the fence", "they mowed the lawn"]),
        ("what did the team ship before the big launch?", ["what did the team ship", "the big launch"]),
        ("bread and butter", []),
        ("compare tea with coffee", ["tea", "coffee"]),
        ("difference between green tea and black coffee", ["green tea", "black coffee"]),
        ("sailing vs rowing", ["sailing", "rowing"]),
        ("Tell Alice Jones of Bob Lee", ["Tell Alice Jones", "Bob Lee"]),
    ],
)
def test_parts_of_questions(query, parts):
    assert sub_queries(query) == [query, *parts]


def test_parts_are_three_at_most_and_differ():
    assert sub_queries("go home and also go home") == ["go home and also go home", "go home"]
    assert len(sub_queries("first do this and then do that and then do more of it")) == 3


# From the published description of the algorithm.
STEMS = "caresses caress|ponies poni|ties ti|cats cat|feed feed|agreed agre|plastered plaster|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|hopping hop|falling fall|hissing hiss|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|valenci valenc|digitizer digit|operator oper|feudalism feudal|hopefulness hope|formaliti formal|triplicate triplic|formative form|electrical electr|goodness good|revival reviv|allowance allow|inference infer|airliner airlin|adjustable adjust|replacement replac|adoption adopt|homologou homolog|effective effect|probate probat|rate rate|cease ceas|controll control|roll roll"


def test_stems():
    for pair in STEMS.split("|"):
        word, want = pair.split()
        assert stem(word) == want, word
    assert stem("by") == "by" and stem("") == ""


def plain_bm25(texts, terms):
    n = {i: len(t) for i, t in texts.items()}
    mean = sum(n.values()) / len(n)
    out = {}
    for w in set(terms):
        df = sum(w in t for t in texts.values())
        for i, t in texts.items():
            f = t.count(w)
            if f:
                out[i] = out.get(i, 0) + max(math.log((len(n) - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n[i] / mean))
    return out


def test_stored_postings_give_bm25(spark):
    texts = {1: "running runners ran home", 2: "home sweet home", 3: "", 4: "cats running fast home cats", 5: "nothing alike"}
    d = spark.createDataFrame(list(texts.items()), "id long, text string")
    plain = Q.build_postings(d)
    got = {r["id"]: r["score"] for r in Q.bm25_scores(spark, plain, ["home", "running", "zzz"]).collect()}
    want = plain_bm25({i: t.split() for i, t in texts.items()}, ["home", "running"])
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    stems = Q.build_postings(d, stems=True)
    got = {r["id"]: r["score"] for r in Q.bm25_scores(spark, stems, ["run", "cat"]).collect()}
    want = plain_bm25({i: [stem(w) for w in t.split()] for i, t in texts.items()}, ["run", "cat"])
    assert got.keys() == want.keys() == {1, 4} and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    empty = Q.build_postings(d.limit(0))
    assert Q.bm25_scores(spark, empty, ["home"]).count() == 0


def test_vector_search_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8))
    x[17] = x[3]  # a tie
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 200, 10)] + [(777, x[3].tolist())], "qid long, q array<double>")
    for block in (2048, 3):
        got = {}
        for r in R.vector_top_by(v, q, 4, block=block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        for qid, ids in got.items():
            s = x @ x[3 if qid == 777 else qid]
            assert ids == sorted(range(200), key=lambda i: (-round(s[i], 9), i))[:4]
        assert len(got) == 21


def test_coverage_of_items(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta"), (3, ""), (4, "beta alpha")], "id long, text string").repartition(3)
    items = spark.createDataFrame([(10, "alpha beta delta"), (11, "gamma"), (12, "zeta"), (13, "")], "item long, text string")
    got = {(r["item"], r["rank"]): (r["id"], round(r["coverage"], 6)) for r in R.coverage(R.postings(texts), texts, items, 2).collect()}
    assert got == {(10, 1): (1, 0.666667), (10, 2): (2, 0.666667), (11, 1): (1, 1.0), (11, 2): (2, 0.0), (12, 1): (1, 0.0), (12, 2): (2, 0.0), (13, 1): (1, 0.0), (13, 2): (2, 0.0)}


def small_library(spark):
    rows = [
        (1, "I bought a red bicycle in 2020. Alice Jones helped.", "a", ["x"], 0.5, "2020-03-01"),
        (2, "The garden needs water and light.", "a", ["y"], 0.9, "2024-05-20"),
        (3, "Bicycles rust near water.", "b", ["x"], 0.1, "2024-05-21"),
        (4, "On March 3, 2020 the fair was held.", "a", [], 0.5, "2023-01-01"),
    ]
    m = spark.createDataFrame(rows, "id long, content string, namespace string, tags array<string>, priority double, day string")
    at = F.col("day").cast("timestamp_ntz")
    m = m.select("id", "content", "namespace", "tags", "priority", at.alias("created_at"), at.alias("updated_at"), F.lit(0).alias("access_count"), F.lit(None).cast("timestamp_ntz").alias("last_accessed"), F.lit("stable").alias("staleness"), F.lit(None).cast("long").alias("superseded_by"))
    t = m.select("id", F.col("content").alias("text"))
    entities = spark.createDataFrame([("Alice Jones", 5), ("Bob Lee", 1)], "name string, mentions long")
    edges = spark.createDataFrame([(1, "Alice Jones", "Bob Lee", 1.0), (3, "Bob Lee", "Carol", 1.0)], "memory_id long, source string, target string, weight double").withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
    return Q.Library(m, Q.build_postings(t, stems=True), None, entities, edges, V.extract_events(t, NOW.date()))


def test_all_signals_of_a_question(spark):
    lib = small_library(spark)
    found, weights = Q.signals_of(lib, "what did Alice Jones do with the bicycle in 2020?", NOW, 20, graph_weight=0.2, events_weight=0.1)
    by = {}
    for r in found.collect():
        by.setdefault(r["signal"], {})[r["id"]] = r["rank"]
    assert by["text"].keys() >= {1, 3} and by["graph"] == {1: 1, 3: 2} and by["temporal"].keys() == {1, 4} and by["temporal"][1] == 1 and by["events"] == {1: 1}
    assert weights.keys() == {"graph", "temporal", "events", "vector", "text"} and abs(sum(weights.values()) - 1) < 1e-9
    top = Q.answer(lib, "what did Alice Jones do with the bicycle in 2020?", NOW, limit=2, graph_weight=0.2).orderBy("rank").collect()
    assert [r["id"] for r in top][0] == 1 and len(top) == 2
    assert [r["id"] for r in Q.answer(lib, "bicycle", NOW, namespaces=["b"]).collect()] == [3]
    both = Q.answer(lib, "who bought the bicycle and also who needs water", NOW, limit=3, decompose=True).orderBy("rank").collect()
    assert {1, 2} <= {r["id"] for r in both}
    again = Q.answer(lib, "garden water", NOW, scorer=R.overlap_scorer("garden water")).orderBy("rank").collect()
    assert again[0]["id"] == 2


def test_accesses_are_a_log(spark):
    lib = small_library(spark)
    log = spark.createDataFrame([(1, "2024-05-30"), (1, "2024-05-31"), (9, "2024-05-31")], "id long, day string").select("id", F.col("day").cast("timestamp_ntz").alias("at"))
    got = {r["id"]: (r["access_count"], r["last_accessed"]) for r in Q.touched(lib.memories, log).collect()}
    assert got[1] == (2, datetime(2024, 5, 31)) and got[2] == (0, None) and len(got) == 4


@pytest.mark.parametrize(
    ("sentence", "day", "words"),
    [
        ("we met on May 5th at the pier", "2024-05-05", "on May 5th"),
        ("it began in 2019 or so", "2019-06-15", "in 2019"),
        ("I ran yesterday", "2024-05-14", "yesterday"),
        ("that was 3 weeks ago", "2024-04-24", "3 weeks ago"),
        ("we went last week", "2024-05-08", "last week"),
        ("I slept this past weekend", "2024-05-11", "this past weekend"),
        ("the show last Saturday", "2024-05-11", "last saturday"),
        ("dinner last Wednesday", "2024-05-08", "last wednesday"),
        ("see you this Friday", "2024-05-17", "this friday"),
        ("at Thanksgiving we ate", "2024-11-28", "Thanksgiving"),
        ("on Halloween night", "2024-10-31", "Halloween"),
        ("nothing at all", None, ""),
    ],
)
def test_days_that_sentences_name(sentence, day, words):
    found, said = C.named_day(sentence, datetime(2024, 5, 15))
    assert (found.strftime("%Y-%m-%d") if found else None, said) == (day, words)


@pytest.fixture(scope="module")
def events(spark):
    turns = [
        (0, 0, "user", "I visited the modern museum in Berlin yesterday. Sure, that was it.", "2024-01-10"),
        (1, 0, "user", "I visited the railway museum in Munich today.", "2024-02-20"),
        (2, 0, "assistant", "The museum in Vienna is closed for repairs now.", "2024-03-01"),
        (3, 0, "user", "I work at Globex since the winter.", "2024-03-02"),
        (4, 0, "user", "I work at Initech these days.", "2024-04-02"),
    ]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, day string").withColumn("session_date", F.col("day").cast("timestamp_ntz")).drop("day")
    return C.build(d)


def test_calendar_answers(events):
    assert events.count() == 5  # without the filler
    asked = datetime(2024, 3, 5)
    between = C.answer(events, "how many days between the museum in Berlin and the museum in Munich?", asked)
    assert between.startswith("CALENDAR ANSWER: 42 days between 'I visited the modern museum in Berlin yesterday.' (2024/01/09) and 'I visited the railway museum in Munich today.' (2024/02/20)")
    weeks = C.answer(events, "how many weeks between the museum trips in Berlin and Munich?", asked)
    assert "42 days (6.0 weeks)" in weeks
    ago = C.answer(events, "how many days ago was the museum in Munich?", asked)
    assert "CALENDAR ANSWER: 14 days ago (~2.0 weeks) — 'I visited the railway museum in Munich today.' was on 2024/02/20, question date is 2024/03/05" in ago
    first = C.answer(events, "when did i first go to a museum in Berlin or Munich", asked)
    assert "First occurrence on 2024/01/09" in first and "(Session 1)" in first
    order = C.answer(events, "which museum came first, Berlin or Munich?", asked)
    assert order.splitlines()[0] == "CALENDAR ANSWER: Chronological order:" and '[expr: "yesterday"]' in order and "  LAST: I visited the railway museum" in order
    assert "Most recent occurrence on 2024/02/20" in C.answer(events, "my most recent museum in Munich or Berlin", asked)
    assert C.answer(events, "dinosaurs?", asked) == ""
    timeline = C.answer(events, "museum", asked)
    assert timeline.startswith("CALENDAR TIMELINE (chronological):\n  Question date: 2024/03/05\n  2024/01/09 — I visited the modern museum in Berlin yesterday. [user] (Session 1) [56 days before question date]")
    change = C.answer(events, "where do i work", asked)
    assert "SUPERSEDED (2024/03/02): I work at Globex since the winter." in change and "CURRENT (2024/04/02): I work at Initech these days." in change


@pytest.mark.parametrize(
    ("question", "window"),
    [
        ("in May 2023", ("2023-05-01", "2023-05-31")),
        ("what about february 2024", ("2024-02-01", "2024-02-29")),
        ("in May", ("2024-05-01", "2024-05-31")),
        ("3 weeks ago", ("2024-05-04", "2024-05-18")),
        ("2 days ago", ("2024-05-23", "2024-05-31")),
        ("last month", ("2024-05-01", "2024-05-31")),
        ("recently", ("2024-04-17", "2024-06-01")),
        ("in 2023", ("2023-01-01", "2023-12-31")),
        ("at noon", None),
    ],
)
def test_windows_of_questions(question, window):
    got = C.time_window(question, NOW)
    assert (tuple(x.strftime("%Y-%m-%d") for x in got) if got else None) == window


def test_sign_index_finds_what_is_near(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 32))[rng.integers(0, 200, 6000)] + 0.35 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, embedding array<double>")
    index = Q.build_sign_index(v, rows_in_bucket=64)
    hits = 0
    for q in range(0, 6000, 600):
        got = {r["id"] for r in index.nearest(x[q].tolist(), 10).collect()}
        hits += len(got & set(np.argsort(-(x @ x[q]))[:10].tolist()))
    assert hits >= 95
    assert Q.build_sign_index(v.limit(0)).nearest([0.0], 3).count() == 0


def test_archives_are_searched_one_by_one(spark, tmp_path):
    rows = [(1, "apple pie", "2024-01-05"), (2, "apple", "2024-02-05"), (3, "pear", "2024-02-06"), (4, "plum", "2023-01-01")]
    m = spark.createDataFrame(rows, "id long, content string, day string").select("id", "content", F.col("day").cast("timestamp_ntz").alias("created_at"))
    R2.archive(m, f"{tmp_path}/a")
    R2.archive(m.where("id = 2"), f"{tmp_path}/a")  # replaces one month
    assert {r["month"]: r["n"] for r in R2.archives(spark, f"{tmp_path}/a").collect()} == {"2023_01": 1, "2024_01": 1, "2024_02": 1}
    assert [(r["archive"], r["id"]) for r in R2.search(spark, f"{tmp_path}/a", ["apple"]).collect()] == [("2024_01", 1), ("2024_02", 2)] or len(R2.search(spark, f"{tmp_path}/a", ["apple"]).collect()) == 2
    states = {r["id"]: (r["state"], r["content"] is None, r["packed"] is None) for r in R2.aged(m, datetime(2024, 5, 1).date(), pack_after=4, keep=12).collect()}
    assert states == {1: ("packed", True, False), 2: ("fresh", False, True), 3: ("fresh", False, True), 4: ("pruned", True, True)}
    assert R2.age_in_months("2023_11", datetime(2024, 2, 1).date()) == 3


def test_scores_are_added_in_the_order_of_the_question(spark):
    """Sums to the last bit: the order in which rows come from files and shuffles bears on none of them."""
    rng = np.random.default_rng(2)
    words = ["omega", "beta", "zeta", "alpha", "kappa"]
    d = spark.createDataFrame([(i, " ".join(rng.choice([*words, "x", "y"], 40))) for i in range(200)], "id long, text string")
    index = Q.build_postings(d)
    alone = {w: {r["id"]: r["score"] for r in Q.bm25_scores(spark, index, [w]).collect()} for w in words}
    got = {r["id"]: r["score"] for r in Q.bm25_scores(spark, index, words).collect()}
    want = {}
    for w in words:
        for i, s in alone[w].items():
            want[i] = want.get(i, 0.0) + s
    assert got == want


def test_archives_are_searched_in_one_plan(spark, tmp_path, monkeypatch):
    """One pass for all months, whose number grows with the memories; each has its own frequencies."""
    d = spark.sql("SELECT id, IF(id % 3 = 0, 'home alone', 'home sweet home far away') AS content, timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(cast(id * 9 AS INT)) AS created_at FROM range(60)")
    R2.archive(d, str(tmp_path / "a"))
    want, rows = [], d.selectExpr("date_format(created_at, 'yyyy_MM') AS m", "id", "content AS text").collect()
    for m in {r["m"] for r in rows}:
        own = {r["id"]: r["text"].split() for r in rows if r["m"] == m}
        want += [(m, i, s) for i, s in plain_bm25(own, ["home", "alone"]).items()]
    asked, inner = [], R2.R.bm25
    monkeypatch.setattr(R2.R, "bm25", lambda *a, **k: asked.append(1) or inner(*a, **k))
    got = [tuple(r) for r in R2.search(spark, str(tmp_path / "a"), ["home", "alone"], 40).collect()]
    want.sort(key=lambda x: (-round(x[2], 12), x[0], x[1]))
    assert [x[:2] for x in got] == [x[:2] for x in want[:40]] and len({m for m, _, _ in got}) > 8
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want)) and len(asked) == 1


def test_postings_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(Q, "RUN_WORDS", 50)
    d = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40))) for i in range(300)] + [(300, None), (301, "")], "id long, text string")
    made = Q.counted(Q.words_of(d))
    assert "Exchange" not in made._jdf.queryExecution().toString()
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, R.postings(d).select("term", "id", "tf", "length").collect()))


def test_nearest_rows_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(1)
    q, v = r.standard_normal((400, 8)), r.standard_normal((10_000, 8))
    shared = type("Shared", (), {"value": (np.arange(400), q)})
    b = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.ListArray.from_arrays(np.arange(0, 80_001, 8, dtype=np.int32), pa.array(v.reshape(-1)))], ["id", "v"])
    tracemalloc.start()
    got = next(R._nearest(shared, 3)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got.column(1).to_numpy().reshape(400, 3), np.argsort(-(q @ v.T), axis=1, kind="stable")[:, :3])
    assert peak < 30e6  # 400 x 10,000 numbers are 32 MB
