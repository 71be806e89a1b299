"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keepstone.llm import ann, bpe, language, lines, minhash, mixing, pii, quality, substrings, warc

sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# ---- vectors


def test_ann_hit_rate_with_a_short_list_of_few_rows(spark):
    """12,000 vectors around 300 centres; the 200 that are ranked again are 1.7 % of them."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 24))[rng.integers(0, 300, 12_000)] + 0.5 * rng.standard_normal((12_000, 24))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(e, e.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5].tolist()) & found.keys())
        assert len(found) == 5 and all(abs(s[i] - v) < 1e-9 for i, v in found.items())
    assert len(got) == 120 and hits >= 0.95 * 600


def test_ann_hit_rate_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 24))
    x[700:760] = x[10]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (None, x[0].tolist()), (5003, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = {}
    for r in ann.search(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1200, 50))  # the others take no part
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len(set(best) & {i for i, _ in found})
        assert len(found) == 5 and all(abs(u[q] @ u[i] - t) < 1e-9 for i, t in found)
    assert hits >= 0.95 * 5 * len(got)
    assert [i for i, _ in got[700]] == [10, 701, 702, 703, 704]


def test_ann_misses_none_of_the_nearest(spark):
    """Rows that codes can't tell apart: dense groups of hundreds, vectors around one far point, and many dimensions."""
    rng = np.random.default_rng(8)
    dense = rng.standard_normal((3, 32))[rng.integers(0, 3, 3000)] + 1e-3 * rng.standard_normal((3000, 32))
    far = 50 + rng.standard_normal((2000, 16))
    wide = rng.standard_normal((2000, 256))
    for x in (dense, far, wide):
        e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = {}
        for r in ann.search(e, e.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        for q in range(0, len(x), 50):
            s = u @ u[q]
            s[q] = -2
            assert got[q] == np.argsort(-s)[:5].tolist()


def test_ann_few_candidates_and_empty(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(v, v).orderBy("query_id").collect()] == [(0, 50), (50, 0)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


# ---- mixing


def test_mix_edges(edge, none):
    out = mixing.mix(edge, budget=200).collect()
    assert {r["source"] for r in out} >= {None, "s1"}
    by = {}
    for r in out:
        by.setdefault((r["doc_id"], r["source"]), []).append(r)
    for rows in by.values():
        rows_of_one = len({r["n_copies"] for r in rows})
        assert rows_of_one == 1
    assert sorted(r["copy"] for r in by[(1, "s1")]) == list(range(by[(1, "s1")][0]["n_copies"]))
    assert mixing.mix(none).count() == 0


def test_mix_means_and_large_rates(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "big").otherwise("small").alias("source"), F.lit("t").alias("text"))
    n = {r["source"]: r["n"] for r in mixing.mix(d, weights={"big": 1, "small": 3}, budget=40_000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["big"] - 10_000) < 500 and abs(n["small"] - 30_000) < 900
    again = mixing.mix(d, weights={"small": 1}).select("source").distinct().collect()
    assert [r["source"] for r in again] == ["small"]


# ---- quality


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def expected_statistics(t):
    t = t or ""
    w = words_of(t)
    ls = [x for x in t.split("\n") if words_of(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(covered)


def test_quality_statistics(spark, edge, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    r = random.Random(1)
    texts = [r["text"] for r in edge.collect()] + ["".join(r.choice(["ab ", "c ", "\n", "#|", "é ", " ", "ab c ab c ab c ab c "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in quality.text_statistics(d).collect():
        assert tuple(row[n] for n in names) == expected_statistics(texts[row["doc_id"]]), row["doc_id"]
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    out, rules = quality.apply_rules(edge, labels)
    assert out.count() == edge.count() and not rules.rules
    assert quality.apply_rules(none, labels.limit(0))[0].count() == 0


def test_quality_learns_a_rule(spark):
    clean = "a plain text of quite some words that says something new at each place " * 1
    rows = [(i, (clean + " ".join(f"w{i}x{j}" for j in range(30))) if i % 4 else " ".join(f"w{i}y{j}#$" for j in range(40))) for i in range(200)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(150)]
    out, rules = quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert rules.rules and all(r["kept"] == (r["doc_id"] % 4 != 0) for r in out.collect())


# ---- personal data


def brute_spans(t):
    t = t or ""
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(re.sub("[^0-9]", "", m.group()))]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.BASE_KINDS.index(x[2])))


def test_pii_patterns_equal_brute_force():
    r = random.Random(5)
    for _ in range(5000):
        t = "".join(r.choice("0123459.@+- ()aZ_%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_pii_field_on_held_out_sentences():
    field = pii.default_field()
    held = pii.made_up_sentences(200, seed=99)
    assert sum(field.decode(t, 0, len(t), []) == gold for t, gold in held) >= 0.85 * len(held)
    assert "secret" in {k for _, _, k in pii.all_spans('token = "' + "3f" * 20 + '"', field)[1]}


def test_pii_edges(edge, none):
    out = {(r["doc_id"]): r for r in pii.find_personal_data(edge).collect()}
    for row in edge.collect():
        r, want = out[row["doc_id"]], brute_spans(row["text"])
        assert r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for s, e, k in want))
        assert set(f"{k}:{s}:{e}" for s, e, k in want) <= set(r["spans"].split(","))
    assert (out[9]["n_email"], out[9]["n_ip"], out[9]["n_card"], out[9]["n_phone"]) == (1, 1, 1, 1)
    assert pii.find_personal_data(none).count() == 0


# ---- near-duplicates


def shingle_set(t):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words_of(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            x, y = sorted((find(i), find(j)))
            label[y] = x
    return {i: find(i) for i in label}


def near_rows():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    rows = []
    for g in range(6):
        base = [word() for _ in range(r.randint(8, 160))]
        for _ in range(40 if g == 0 else 8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w)))
    return rows


def test_minhash_equals_brute_force(spark):
    rows = near_rows()
    got = {r["doc_id"]: r for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_components(rows)
    for i, t in rows:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(shingle_set(t)), want[i], want[i] == i)


def exact_components(texts, percent):
    """Components of texts of one group by a matrix of which shingles they have."""
    sets = [shingle_set(t) for t in texts]
    number = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[x] for x in s]] = 1
    both = np.rint(has @ has.T)
    n = has.sum(1)
    near = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    label = np.arange(len(sets))
    while True:
        least = np.where(near, label[None, :], len(sets)).min(1)
        if (least == label).all():
            return label
        label = least


def test_minhash_large_torn_group(spark):
    """2,000 copies of two related texts at all distances around the threshold, in buckets that fall into hundreds of components."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(90)]
    kin = base[:60] + [word() for _ in range(30)]
    few = [word() for _ in range(40)]
    rows = []
    for i in range(2000):
        w = list(base if i % 3 else kin)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            at = r.randrange(len(w))
            w[at] = r.choice(few) if i % 2 else word()
        if i % 17 == 0:
            del w[r.randrange(40) : r.randrange(41, 60)]
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent, kw in ((85, {}), (80, {"bands": 32, "rows": 4})):
        want = exact_components([t for _, t in rows], percent)
        assert len(set(want.tolist())) > 100
        got = {x["doc_id"]: x["component_id"] for x in minhash.link(d, percent=percent, **kw).collect()}
        assert [got[i] for i in range(2000)] == want.tolist()


def test_minhash_large_buckets_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "UNIT", 5)
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_minhash_ids_of_several_texts_join_their_groups(spark):
    """Rows of one id count as one document: copies of one of its texts and near copies of another are one component."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    near = y.replace("y59", "z")
    rows = [(5, x), (7, x), (7, y), (9, near), (11, y), (20, "other words"), (21, "other words"), (7, None)]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.link(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(5, 5), (7, 5), (7, 5), (7, 5), (9, 5), (11, 5), (20, 20), (21, 20)]


def test_minhash_bound_rejects_no_link():
    r = random.Random(4)
    for _ in range(200):
        x = {r.getrandbits(64) for _ in range(r.choice([1, 5, 100, 3000]))}
        y = set(r.sample(sorted(x), r.randint(0, len(x)))) | {r.getrandbits(64) for _ in range(r.choice([1, 5, 100]))}
        (a, p), (b, q) = (minhash.histogram(np.array(sorted(z), np.uint64)) for z in (x, y))
        a, b = (np.frombuffer(c, np.uint8).astype(int) for c in (a, b))
        assert np.minimum(a, b).sum() >= len(x & y)
        assert sum(int(v).bit_count() for v in (p ^ q).view(np.uint64)) <= len(x ^ y)
    assert minhash.histogram(np.zeros(300, np.uint64))[0] == b""  # more in a bin than a byte tells: no bound


def test_minhash_edges(edge, none):
    got = sorted(minhash.link(edge).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == edge.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[3]["component_id"] == 3 and by[3]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert {r["doc_id"] for r in minhash.keep_one(edge).collect()} == {1, 3, 4, 5, 6, 7, 8, 9, None}
    assert minhash.link(none).count() == 0


# ---- WARC


def test_warc_finds_every_damage(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/p", f"<p>page {i}</p>" if i % 7 else None) for i in range(700)] + [(5, "http://h2/p", "<p>page 5</p>"), (None, None, "x")], "page_id long, url string, html string").withColumn("digest", F.lit(1))
    other = pages.where("coalesce(page_id, 0) <> 333").withColumn("html", F.when(F.col("page_id") == 77, "<p>pagE 77</p>").otherwise(F.col("html")))
    other = other.unionByName(spark.createDataFrame([(9000, "http://new", "n", 1)], "page_id long, url string, html string, digest int"))
    got = {(r["page_id"], r["url"]): r for r in warc.audit(pages, other).collect()}
    bad = {k[0]: r["status"] for k, r in got.items() if r["status"] != "intact"}
    # 77 is divisible by 7, so its body was null and now isn't
    assert bad == {333: "missing", 77: "corrupt", 9000: "extra"}
    assert got[(5, "http://h2/p")]["n_copies"] == 2
    assert all(r["status"] == "intact" for r in warc.audit(pages, pages).collect())
    assert warc.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_warc_equal_inner_copies(spark):
    """Copies of one key that two different bodies stand in for in pairs: sums tell them apart, as exclusive ors would not."""
    page = lambda bodies: spark.createDataFrame([(1, "u", b) for b in bodies] + [(2, "v", "x")], "page_id long, url string, html string")
    got = {r["page_id"]: r["status"] for r in warc.audit(page("ABBC"), page("ADDC")).collect()}
    assert got == {1: "corrupt", 2: "intact"}
    assert {r["status"] for r in warc.audit(page("ABBC"), page("CBAB")).collect()} == {"intact"}
    assert {r["page_id"]: r["status"] for r in warc.audit(page("ABB"), page("AB")).collect()} == {1: "corrupt", 2: "intact"}


def test_warc_offsets_equal_brute_force(spark):
    """3,000 records in leaves of two levels, one of them very long, against a plain walk through the archive."""
    rows = [(i if i % 50 else None, f"http://h/{i}", "x" * (i % 37) if i != 7 else "long " * 400_000) for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    depth = warc.depth_for(3000)
    got = {r["url"]: r for r in warc.audit(pages, warc.damaged_replica(pages)).collect()}
    at = 0
    for i, u, h in sorted(rows, key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}|{r[1]}".encode()).hexdigest()):
        ident = hashlib.md5(f"{'' if i is None else i}|{u}".encode()).hexdigest()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(h)}"
        n = len(f"{head}\r\n\r\n{h}\r\n\r\n")
        mark = hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:2]
        want = {"00": "corrupt", "02": "missing"}.get(mark, "corrupt" if mark == "01" and h else "intact")
        assert (got[u]["rec_offset"], got[u]["n_bytes"], got[u]["leaf"], got[u]["status"]) == (at, n, int(ident[:depth], 16), want), u
        at += n


def test_warc_equal_replicas_join_no_records(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", str(i)) for i in range(5000)], "page_id long, url string, html string")
    one, other = (warc.stash(warc.manifest(pages), "manifest") for _ in range(2))
    looked = []
    kept = warc.stash
    monkeypatch.setattr(warc, "stash", lambda df, name, narrow=False: looked.append(name) or kept(df, name, narrow))
    trees = warc.build_tree(one, 2), warc.build_tree(other, 2)
    assert warc.differing_leaves(*trees) is None and looked.count("differing") == 1  # the roots only
    out = warc.audit(pages, pages.repartition(3))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and out.where("status = 'intact'").count() == 5000


def test_warc_empty_replica(spark):
    pages = spark.createDataFrame([(1, "u", "h"), (2, "u", "h")], "page_id long, url string, html string")
    assert {r["status"] for r in warc.audit(pages, pages.limit(0)).collect()} == {"missing"}


# ---- lines


def test_lines_edges(edge, none):
    out = {r["doc_id"]: r for r in lines.remove_boilerplate(edge, min_sites=4).collect()}
    assert out[1]["text"].endswith("Shared line of many sites here") and out[1]["n_removed"] == 0
    for i in (2, 7, 9, None):
        assert "Shared line" not in out[i]["text"] and out[i]["n_removed"] == 1
    assert out[4]["text"] is None and out[4]["n_lines"] == 0 and out[3]["text"] == "" and out[5]["text"] == "   \n\t "
    assert lines.remove_boilerplate(edge, min_sites=9).where("n_removed > 0").count() == 0
    assert lines.remove_boilerplate(none).count() == 0


def test_lines_equal_brute_force(spark):
    r = random.Random(8)
    pool = [f"line {i}" for i in range(12)] + ["", "  ", " line 3 "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9))), f"s{r.randrange(9)}") for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=5).collect()}
    sites, first = {}, {}
    for i, t, s in rows:
        for x in t.split("\n"):
            if x.strip():
                sites.setdefault(x.strip(), set()).add(s)
                first.setdefault(x.strip(), i)
    for i, t, _ in rows:
        seen, kept = set(), []
        for x in t.split("\n"):
            k = x.strip()
            if not k or len(sites[k]) < 5 or (first[k] == i and k not in seen):
                kept.append(x)
            seen.add(k)
        assert got[i] == "\n".join(kept)


# ---- substrings


def brute_removed(rows):
    start = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                start[b[k : k + 50]] = min(start.get(b[k : k + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and start[b[k : k + 50]] < i:
                m[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(b), sum(m), spans, sha(bytes(x for x, y in zip(b, m, strict=True) if not y))))
    return out


def substring_rows():
    r = random.Random(2)
    passages = ["".join(r.choice("abc é\n") for _ in range(r.randint(49, 140))) for _ in range(8)]
    rows = [(i, "".join(r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 90))) for _ in range(r.randint(0, 5)))) for i in range(120)]
    return rows + [(50, rows[3][1]), (None, rows[4][1]), (200, "ab" * 400), (201, "ab" * 300), (202, None)]


@pytest.mark.parametrize("hot", [substrings.HOT, 3])
def test_substrings_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "BLOCK", 4000)
    rows = substring_rows()
    got = sorted((tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), with_text=False).collect()), key=repr)
    assert got == sorted(brute_removed(rows), key=repr)


def test_substrings_edges(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] != 6]
    d = edge.where("doc_id IS NULL OR doc_id <> 6")
    got = sorted((tuple(r)[:5] for r in substrings.remove_repeats(d).collect()), key=repr)
    assert got == sorted(brute_removed(rows), key=repr)
    assert substrings.remove_repeats(edge.where("doc_id = 6"), with_text=False).first()["n_removed"] == 0
    assert substrings.remove_repeats(none).count() == 0


def test_common_windows():
    r = random.Random(6)
    strings = list({bytes(r.choice(b"ab") for _ in range(r.randint(5, 30))) for _ in range(40)})
    low = np.arange(100, 100 + len(strings))
    who, place, best = substrings.common_windows(strings, low, 5)
    at = {}
    for i, s in enumerate(strings):
        for k in range(len(s) - 4):
            at.setdefault(s[k : k + 5], []).append((i, k))
    want = {(i, k): min(low[j] for j, _ in v) for v in at.values() if len(v) > 1 for i, k in v}
    assert dict(zip(zip(who.tolist(), place.tolist(), strict=True), best.tolist(), strict=True)) == want


# ---- language


def plain_predict(model, text):
    """The nearest centroid by cosine, in plain Python."""
    n = language.gram_counts(text)
    v = [math.log1p(n[b]) * float(model.idf[b]) for b in range(language.BUCKETS)]
    norm = math.sqrt(sum(a * a for a in v))
    cos = [sum(a * float(b) for a, b in zip(v, c, strict=True) if a) / norm for c in model.centroids]
    best = max(range(len(cos)), key=lambda i: (round(cos[i], 6), -i))
    return model.languages[model.owner[best]], cos[best]


def test_language_is_judged_on_held_out_rows(spark):
    """Learned only from rows whose crc32 modulo 4 isn't 2 and that have a language; the others, and texts that fool a cut, are predicted as well."""
    r = random.Random(31)
    lex = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "en", "ung", "ei"], "zz": ["ção", "lh", "ar", "os"]}
    made = lambda k, n: " ".join("".join(r.choice(lex[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, made(k, r.randint(8, 80)), k) for i in range(400) for k in [r.choice(list(lex))]]
    # held-out rows carry a wrong language: whoever learned from them would fail
    wrong = {"xx": "yy", "yy": "zz", "zz": "xx"}
    is_held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    told = [(i, t, wrong[k] if is_held(i) else k) for i, t, k in rows]
    # long texts whose language shows after 9,000 characters only
    told += [(1000 + i, ". " * 5000 + made("yy", 400), "yy") for i in range(3)] + [(None, "ka ro mi", "xx"), (2000, "ka ro", None)]
    d = spark.createDataFrame(told, "doc_id long, text string, lang string")
    model = language.fit_model(d)
    got = {x["doc_id"]: x for x in language.identify(d, model).collect()}
    held = [(i, k) for i, _, k in rows if is_held(i)]
    assert len(held) > 60 and sum(got[i]["lang_pred"] == k for i, k in held) >= 0.98 * len(held)
    assert all(got[1000 + i]["lang_pred"] == "yy" for i in range(3))
    for i, t, _ in rows[:12]:
        lang, score = plain_predict(model, t)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-5
    # one centroid of the model is the mean of the unit vectors that are nearest to it
    fitted = [(t, k) for i, t, k in told if i is not None and k is not None and not is_held(i)]
    x = {k: np.stack([language.weighted(language.gram_counts(t), model.idf) for t, c in fitted if c == k]) for k in lex}
    for i, k in enumerate(model.languages):
        own = model.centroids[model.owner == i]
        near = (x[k] @ own.T).argmax(1)
        for j in range(len(own)):
            if (near == j).any():
                c = x[k][near == j].sum(0)
                assert own[j] @ c / np.linalg.norm(c) > 0.98


def test_language_query_never_leaves_held_out_null(spark, tmp_path):
    rows = [(1, "ka ro mi", "xx"), (None, "ka ro", "xx"), (None, None, None), (4, "", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op9_language(spark, str(tmp_path)).collect()
    assert len(out) == 4 and all(x["held_out"] is not None for x in out)
    assert {x["lang_pred"] for x in out if x["doc_id"] == 4} == {"und"}


def test_language_accuracy_and_edges(spark, edge, none):
    r = random.Random(3)
    lex = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "en", "ung", "ei"], "zz": ["ção", "lh", "ar", "os"]}
    rows = [(i, " ".join("".join(r.choice(lex[k]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(8, 80))), k, "s", 1) for i in range(300) for k in [r.choice(list(lex))]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = language.fit_model(d)
    got = {x["doc_id"]: x for x in language.identify(d, model).collect()}
    held = [x for x in rows if got[x[0]]]
    assert sum(got[x[0]]["lang_pred"] == x[2] for x in held) >= 0.98 * len(held) and all(0 <= g["score"] <= 1 for g in got.values())
    out = {x["doc_id"]: x for x in language.identify(edge, model, keep=("doc_id", "text", "source")).collect()}
    for i in (3, 4, 5):
        assert out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0
    assert language.identify(none, language.fit_model(none)).count() == 0
    assert {x["lang_pred"] for x in language.identify(edge, language.fit_model(none)).collect()} == {"und"}


# ---- BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = bpe.default_tokenizer()
    with open(path, encoding="utf-8") as f:
        model = bpe.WordBPE(f.read())
    lib = Tokenizer.from_file(path)
    r = random.Random(3)
    alphabet = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x600), *range(0x900, 0xA00), *range(0x1E00, 0x2100), 0x1F600, 0x130, 0x3A3, 0x85, 0x2028, 0x300, 0x301, 0xA7CB]] + ["  ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|", "42", "the", "ing"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["", "aaaaaaaa" * 50, "İΣΣ"]
    for t, (n, ids, decoded) in zip(texts, model.encode(texts), strict=True):
        e = lib.encode(t, add_special_tokens=False)
        assert [n, ids, decoded] == [len(e.ids), " ".join(map(str, e.ids)), lib.decode(e.ids, skip_special_tokens=False)], t
        assert model.decode(e.ids) == decoded


def test_bpe_edges(edge, none):
    out = {r["doc_id"]: r for r in bpe.encode_documents(edge, bpe.default_tokenizer()).collect()}
    assert out[4]["n_tokens"] == 0 and out[4]["ids_sha256"] == sha("") and out[3]["decoded"] == "" and out[3]["ids"] == []
    assert out[6]["n_tokens"] == len(out[6]["ids"]) > 40_000
    assert bpe.encode_documents(none, bpe.default_tokenizer()).count() == 0


# ---- pipeline


def test_pipeline_stages(spark, edge, none, tmp_path):
    rows = [(i, f"alpha beta gamma delta number{i} of the small story with words that differ{i * 7} " * 3, "en", f"s{i % 6}", 9) for i in range(60)]
    d = edge.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(0).alias(c) for c in edge.columns[5:]]))
    for start in (d, none):
        docs = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, "")
            if i < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        n = docs.count()
        assert (n > 0) == (start is d)


def test_pipeline_against_plain_python(spark, tmp_path):
    """Lines, near-duplicates, mixture and tokens of a small corpus, followed by hand."""
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("abcdefghijkl") for _ in range(4)) for _ in range(30)) for _ in range(20)]
    rows = [(i, texts[i % 20] + "\ncommon footer line", "en", f"s{i % 7}", 1) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    after_lines = corpus_pipeline.dedup_lines(spark, d, "")
    assert {x["doc_id"]: x["text"] for x in after_lines.collect()} == {i: t if i == 0 else t.removesuffix("\ncommon footer line") for i, t, *_ in rows}
    after = corpus_pipeline.dedup_documents(spark, after_lines, "")
    kept = {x["doc_id"] for x in after.collect()}
    assert kept == set(brute_components([(x["doc_id"], x["text"]) for x in after_lines.collect()]).values())
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} and {x["doc_id"] for x in out.collect()} <= kept


def test_lines_of_a_long_text(spark):
    """Six texts of 4,000 shared lines, of which some come twice in a text: all but the first place of each goes."""
    many = [f"line {i} of many" for i in range(4000)]
    rows = [(k, "\n".join([f"own {k}", *many, *many[::40]]), f"s{k}") for k in range(6)]
    got = {x["doc_id"]: (x["text"], x["n_removed"]) for x in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: ("\n".join(["own 0", *many]), 100)} | {k: (f"own {k}", 4100) for k in range(1, 6)}
