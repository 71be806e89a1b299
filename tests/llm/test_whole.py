"""What a review found missing."""

import random

import corpus_pipeline
from keepstone.llm import minhash, pii, quality


def _word(r):
    return "".join(r.choice("abcdefghijkl") for _ in range(6))


def _changed(r, words, places):
    out = list(words)
    for p in places:
        out[p] = _word(r) + "z"
    return out


def test_pipeline_links_copies_from_080_on(spark):
    """A changed word inside a text replaces five shingles: of 90, two leave 80 of 100, and of 100 they leave 90 of 110, three 85 of 115."""
    r = random.Random(3)
    rows, pairs = [], []
    for g in range(36):
        words = [_word(r) for _ in range(94 if g % 3 == 0 else 104)]
        pairs.append((len(rows), len(rows) + 1, g % 3 < 2))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(_changed(r, words, (20, 50) if g % 3 < 2 else (20, 50, 80))))]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.dedup_documents(spark, d, "").collect()}
    assert kept == {i for a, b, near in pairs for i in ([a] if near else [a, b])}
    assert minhash.keep_one(d).count() == len(rows)  # none of them is at 0.85


def test_quality_learns_from_rare_poor_texts(spark):
    """2 % poor, on a feature that is 0 for all others, and 1 % on another one's upper end."""
    r = random.Random(8)
    rows = []
    for i in range(2000):
        rare = i % 50 == 0
        high = i % 100 == 7
        row = {f: 0.0 for f in quality.FEATURES} | {"words": float(r.randint(30, 300)), "mean_word": r.uniform(4, 6), "distinct_rate": r.uniform(0.5, 1)}
        row |= {"symbol_rate": r.uniform(0.3, 0.5)} if rare else {"mean_word": r.uniform(9, 10)} if high else {}
        rows.append((*[row[f] for f in quality.FEATURES], rare or high, i % 3 != 0))
    d = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in quality.FEATURES) + ", poor boolean, grow boolean")
    rules = quality.learn(d)
    assert d.where(rules.number() > 0).where("poor").count() == 60 and d.where(rules.number() > 0).where("NOT poor").count() == 0


def test_pii_field_sees_addresses_without_digits():
    field = pii.default_field()
    for t in ("write to jane (at) example (dot) com", "contact jane [at] example [dot] org today"):
        long = "some plain words " * 20 + t + " and more of them" * 20
        for x in (t, long):
            assert [k for _, _, k in pii.all_spans(x, field)[1]] == ["email"], x


def test_pii_regions_equal_whole_texts():
    """On texts without a fixed pattern the field finds the same with regions as on the whole text."""
    field = pii.default_field()
    held = pii.made_up_sentences(300, seed=98)
    r = random.Random(1)
    for i in range(0, 300, 3):
        t = (" " + " ".join(_word(r) for _ in range(30)) + " ").join(x for x, _ in held[i : i + 3])
        if not pii.base_spans(t):
            assert pii.all_spans(t, field)[1] == field.decode(t, 0, len(t), []), t
    assert list(pii._regions("x" * 300 + "7")) == [(0, 301)]
