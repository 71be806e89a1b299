"""Functions and operators against plain Python on small inputs."""

import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepstone.functions import dates, embed, scoring
from keepstone.functions import text as T
from keepstone.functions.context import prefix, with_context
from keepstone.operators import graph, memories, patterns, retrieval, timeline
from keepstone.operators.summaries import summaries

NOW = datetime(2024, 6, 12, 10, 0)  # a Wednesday


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_murmur3_known_values():
    assert embed.murmur3(b"") == 0 and embed.murmur3(b"", 1) == 0x514E28B7
    assert embed.murmur3(b"hello") == 613153351 and embed.murmur3(b"abc") == 3017643002
    assert embed.murmur3(b"test", 0) == 3127628307


def test_murmur3_of_many_pieces():
    pieces = [b"", b"a", b"ab", b"abc", b"abcd", "größe_über".encode(), b"hello", b"test", b"x" * 33]
    data = np.frombuffer(b"".join(pieces) + b" ", np.uint8)
    sizes = np.array([len(p) for p in pieces])
    for seed in (0, 1):
        assert embed.murmur3_all(data, np.cumsum(sizes) - sizes, sizes, seed).tolist() == [embed.murmur3(p, seed) for p in pieces]


def test_embedding_by_definition(spark):
    """Against the definition, term by term: signed counts, damped, weighted by ln(1 + N / (1 + df)), of length 1."""
    texts = ["Alpha beta alpha gamma", "beta gamma delta beta beta", "", "the", "Alpha"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    terms = []
    for t in texts:
        w = [x for x in t.lower().split() if x != "the"]
        terms.append(w + [f"{a}_{b}" for a, b in zip(w, w[1:], strict=False)])
    df = {}
    for t in terms:
        for b in {embed.murmur3(x.encode()) % 256 for x in t}:
            df[b] = df.get(b, 0) + 1
    assert {r["bucket"]: r["n"] for r in embed.document_frequency(d).collect()} == df
    got = {r["id"]: r["embedding"] for r in embed.embed(d, len(texts), df).collect()}
    for i, t in enumerate(terms):
        v = np.zeros(256)
        for x in t:
            v[embed.murmur3(x.encode()) % 256] += 1 if embed.murmur3(x.encode(), 1) < 1 << 31 else -1
        for b in np.flatnonzero(v):
            v[b] = np.sign(v[b]) * (1 + np.log(abs(v[b]))) * np.log(1 + len(texts) / (1 + df[b]))
        n = np.linalg.norm(v)
        assert np.allclose(got[i], v / n if n else v, atol=1e-6)


def test_embedding_is_a_unit_vector_or_zero(spark):
    rows = spark.createDataFrame([(1, "solar panels make power"), (2, ""), (3, "the of and")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed.embed(rows).collect()}
    assert abs(math.fsum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[2]) and not any(got[3]) and len(got[1]) == 256


@pytest.mark.parametrize(
    "query, dates_, ranges",
    [
        ("what happened yesterday", [datetime(2024, 6, 11, 12)], []),
        ("3 days ago", [datetime(2024, 6, 9, 10)], []),
        ("on 2023-05-30", [datetime(2023, 5, 30)], []),
        ("in March 2024", [], [(datetime(2024, 3, 1), datetime(2024, 3, 31, 23, 59, 59))]),
        ("in september", [], [(datetime(2023, 9, 1), datetime(2023, 9, 30, 23, 59, 59))]),
        ("last month", [], [(datetime(2024, 5, 1), datetime(2024, 5, 31, 23, 59, 59))]),
        ("2 weeks ago", [], [(datetime(2024, 5, 27), datetime(2024, 6, 2, 23, 59, 59))]),
        ("14 months ago", [], [(datetime(2023, 4, 1), datetime(2023, 4, 30, 23, 59, 59))]),
        ("in the winter", [], [(datetime(2024, 12, 1), datetime(2025, 2, 28, 23, 59, 59))]),
        ("last summer", [], [(datetime(2023, 6, 1), datetime(2023, 8, 31, 23, 59, 59))]),
        ("last wednesday", [datetime(2024, 6, 5, 12)], []),
        ("on tuesday", [datetime(2024, 6, 11, 12)], []),
        ("before christmas", [], [(datetime(2023, 1, 1), datetime(2023, 12, 25))]),
        ("on 2023/02/30 or so", [], []),
        ("tell me about python", [], []),
    ],
)
def test_query_dates(query, dates_, ranges):
    assert dates.parse_query(query, NOW) == {"dates": dates_, "ranges": ranges}


def test_relative_dates():
    assert dates.parse_relative("2 hours ago", NOW) == datetime(2024, 6, 12, 8)
    assert dates.parse_relative("2 months ago", NOW) == datetime(2024, 4, 13, 10)
    assert dates.parse_relative("2026-03-01", NOW) == datetime(2026, 3, 1)
    with pytest.raises(ValueError):
        dates.parse_relative("some day", NOW)


def test_dates_in_texts(spark):
    text = "On 2023-05-30 and 2023/6/1, then May 30, 2023; January 2024 and in 2019; 2023-13-45 never"
    got = one(spark, dates.content_dates(F.col("t")), t=text)
    assert {(str(x["date"]), x["kind"]) for x in got} == {("2023-05-30", "exact"), ("2023-06-01", "exact"), ("2024-01-01", "month"), ("2019-01-01", "year")} | {("2023-05-30", "exact")}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab ,.!?é_9\n", max_size=40))
def test_full_text_terms_never_have_operators(q):
    assert not any(c in w for w in T.full_text_terms(q + '"*(x)') for c in '*^{}():"')


def test_sentences_and_types(spark):
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.memory_type(F.col("t")), t="We decided to go. It is version 2") == "decision"
    assert one(spark, T.staleness_class(F.col("t")), t="latest price today") == "volatile"
    assert one(spark, T.topic_tags(F.col("t")), t="pytest on docker with git") == ["python", "docker", "git", "testing"]
    assert one(spark, T.redact_sensitive(F.col("t")), t="a@b.io 123-45-6789") == "[EMAIL_REDACTED] [SSN_REDACTED]"
    assert one(spark, T.strip_private(F.col("t")), t="a <private>x\ny</private>b ") == "a b"


def test_contradictions(spark):
    pair = lambda a, b, s: one(spark, T.contradiction(F.col("a"), F.col("b"), F.col("s")), a=a, b=b, s=s)
    assert pair("always use tabs in python files", "never use tabs in python files", 0.7) == pytest.approx(0.9)
    assert pair("apples are red", "bananas grow far away", 0.9) is None


def test_retention_policy(spark):
    p = scoring.parse_retention("default:90, type:code:30,tag:temp:7,ns:scratch:14,junk")
    ttl = lambda tags, ns, kind: one(spark, scoring.retention_days(p, F.col("t"), F.col("n"), F.col("k")), t=tags, n=ns, k=kind)
    assert (ttl(["temp", "x"], "scratch", "code"), ttl(["x"], "scratch", "code"), ttl(["x"], "a", "code"), ttl(["x"], "a", "fact")) == (7, 14, 30, 90)


def test_summaries_of_short_and_empty_texts(spark):
    d = spark.createDataFrame([(1, ""), (2, "Only one sentence"), (3, "A cat sat. A cat ran. Dogs bark. The cat cat cat."), (4, None)], "id long, text string")
    got = {r["id"]: r for r in summaries(d).collect()}
    assert got[1]["l3"] == "" and got[1]["l2"] == [] and got[2]["l2"] == ["Only one sentence"] and got[3]["l3"] == "The cat cat cat." and got[4]["l3"] == ""


def test_bm25_prefers_rare_terms(spark):
    d = spark.createDataFrame([(i, "common words here") for i in range(20)] + [(99, "common zebra here")], "id long, text string")
    got = retrieval.bm25(d, ["common", "zebra"]).orderBy(F.desc("score")).collect()
    assert got[0]["id"] == 99 and len(got) == 21
    assert retrieval.bm25(d.limit(0), ["zebra"]).count() == 0


def test_weights_leave_room_for_other_signals():
    w = retrieval.signal_weights(graph=0.2, temporal=0.1)
    assert w["vector"] == pytest.approx(0.42) and w["text"] == pytest.approx(0.28)


def test_budgets(spark):
    d = spark.createDataFrame([(1, 50), (2, 60), (3, 10)], "rank int, tokens long")
    assert [r["rank"] for r in memories.budget_prefix(d, 100).collect()] == [1]
    assert [r["rank"] for r in memories.budget_prefix(d, 10, admit_first=True).collect()] == [1]
    assert memories.budget_skip(d.withColumn("k", F.lit(0)), 100, "k").first()["kept"] == [1, 3]


def test_walk_takes_least_distance(spark):
    e = spark.createDataFrame([("a", "b", 1, 1.0), ("b", "c", 2, 1.0), ("c", "d", 3, 1.0), ("a", "c", 4, 0.5)], "source string, target string, memory_id long, weight double")
    e = e.withColumn("valid_until", F.lit(None).cast("timestamp")).withColumn("superseded_by", F.lit(None).cast("long"))
    s = {r["memory_id"]: r["score"] for r in graph.walk(e, spark.createDataFrame([("a", 2.0)], "node string, boost double"), 1).collect()}
    assert s == {1: 2.0, 4: 1.0, 2: 0.5, 3: 0.5}


def test_fact_supersession(spark):
    f = spark.createDataFrame([("Ann", "city", "Rome", 1, 1), ("ann", "city", "ROME", 2, 2), ("Ann", "City", "Oslo", 3, 3), ("Bo", "city", "Bonn", 1, 4)], "entity string, attribute string, value string, at long, seq long")
    got = {r["seq"]: r["valid_until"] for r in timeline.supersede(f).collect()}
    assert got == {1: 3, 2: 3, 3: None, 4: None}


def test_trends_and_switches(spark):
    rows = spark.createDataFrame([(i, datetime(2024, 1, 1 + i), "react" if i < 4 else "vue") for i in range(8)], "id long, ts timestamp, text string")
    m = patterns.mentions(rows)
    got = {r["keyword"]: r["shift"] for r in patterns.trends(m, patterns.halves(rows)).collect()}
    assert got == {"react": -1.0, "vue": 1.0} and patterns.switches(m).count() == 0


@pytest.mark.parametrize(
    ("text", "session", "want"),
    [
        ("The harbour has boats. The harbour boats need paint, said Alice Jones.", None, "Discussion about harbour, boats, paint involving Alice Jones, Alice, Jones. The harbour has boats. The harbour boats need paint, said Alice Jones."),
        ("[user]: bread and yeast [assistant]: flour", None, "Discussion about bread, yeast. [user]: bread and yeast [assistant]: flour"),
        ("the of and", None, "the of and"),
        ("is it Bo", None, "Mentions Bo. is it Bo"),
        ("", None, ""),
        (None, "a session", None),
        ("he met Ann in Rome", "boats boats harbour", "This is part of a conversation about boats, harbour. The user discussed met, ann, rome, Ann. he met Ann in Rome"),
        ("of the", "it is", "This is part of a conversation about various topics. of the"),
        ("is it Bo", "", "Mentions Bo. is it Bo"),
    ],
)
def test_context_before_a_text(spark, text, session, want):
    d = spark.createDataFrame([(text, session)], "t string, s string")
    assert d.select(with_context("t", "s").alias("x")).first()["x"] == want
    if session is None:
        assert d.select(with_context("t").alias("x")).first()["x"] == want


def test_context_of_a_long_text(spark):
    text = " ".join(f"word{i % 5000} Name{chr(97 + i % 26)}" for i in range(40_000))
    got = spark.createDataFrame([(text,)], "t string").select(prefix(F.col("t")).alias("x")).first()["x"]
    assert got.startswith("Discussion about namea, nameb, namec involving Namea, Nameb, Namec.")


def test_embeddings_of_one_pass_are_those_of_two(spark):
    texts = spark.createDataFrame([(1, "harbour office in Lisbon opens"), (2, "office hours: opens opens late"), (3, ""), (4, None), (5, "ünï x harbour")], "id long, text string")
    rows = embed.hashed(texts).cache()
    told = {r["bucket"]: r["n"] for r in embed.document_frequency(texts).collect()}
    assert {r["bucket"]: r["n"] for r in embed.frequencies(rows).collect()} == told and max(told.values()) > 1
    assert sorted(map(tuple, embed.embedded(rows, 5, told).collect())) == sorted(map(tuple, embed.embed(texts, 5, told).collect()))
    one = embed.vector("office hours opens opens late office_hours hours_opens opens_opens opens_late".split(), 5, told)
    assert [r["embedding"] for r in embed.embedded(rows, 5, told).where("id = 2").collect()] == [pytest.approx(one.tolist(), abs=1e-6)]
