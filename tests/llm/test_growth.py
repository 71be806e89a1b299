"""What must not grow with the square of a group, or stop at a number of classes."""

import random

import numpy as np
from pyspark.sql import functions as F

from keepstone.llm import language, minhash


def test_minhash_members_with_their_own_changes_do_not_meet(spark):
    """600 texts with two thirds in common and a third of their own share no rare shingle; two of them that are linked do."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(120)]
    texts = {i: [*shared, *[word() for _ in range(60)]] for i in range(600)}
    texts[600] = [*texts[17][:-2], "changed", "end"]
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    rest = spark.createDataFrame([(i, i) for i in texts], "id long, c long")
    rare = minhash._rare(rest, d, 85)
    met = rare.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").count()
    assert 1 <= met <= 60 and rare.groupBy("token").count().agg(F.max("count")).first()[0] == 2
    bins = spark.createDataFrame([(i, bytearray(minhash.histogram(minhash.shingles(" ".join(t))[0])[0])) for i, t in texts.items()], "id long, bins binary")
    assert [tuple(x) for x in minhash._large_rest(rest, bins, d, 85).collect()] == [(17, 600)]


def test_minhash_linked_sets_share_a_rare_shingle(spark):
    """Whatever the order, sets at the threshold share one of as many as are taken."""
    r = random.Random(6)
    texts, pairs = {}, []
    for k in range(60):
        n = r.randint(20, 200)
        base = [f"w{k}x{i}" for i in range(n)]
        cut = r.randint(0, max(1, n // 7))
        texts[2 * k], texts[2 * k + 1] = base, base[: n - cut]
        x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, base[: n - cut]))
        if 100 * len(x & y) >= 85 * len(x | y):
            pairs.append((2 * k, 2 * k + 1))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "id long, text string")
    rare = {}
    for x in minhash._rare(d.select("id", F.col("id").alias("c")), d, 85).collect():
        rare.setdefault(x["id"], set()).add(x["token"])
    assert len(pairs) > 20 and all(rare[a] & rare[b] for a, b in pairs)


def test_all_of_many_languages_are_learned(spark):
    """300 languages of invented words, 12 labelled rows each: none is left out of the model."""
    r = random.Random(9)
    letters = [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(300):
        own = ["".join(r.choice(letters) for _ in range(6)) for _ in range(12)]
        rows += [(len(rows) + j, " ".join(r.choice(own) for _ in range(60)), f"l{k:03}", "s", 1) for j in range(16)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_model(d)
    assert model.languages == [f"l{k:03}" for k in range(300)]
    assert np.bincount(model.owner).min() >= 1
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(d, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang, _, _ in rows]) > 0.99
