"""Writing, reflection, cards, profiles, workspaces and files, against written-out cases and plain Python."""

import hashlib
import json
import zlib
from datetime import datetime
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepstone.functions import text as T
from keepstone.operators import cards as K
from keepstone.operators import graph as G
from keepstone.operators import overlaps as O
from keepstone.operators import profile as P
from keepstone.operators import workspace as S
from keepstone.operators import writing as W
from keepstone.sources import exports, imports


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:30] + 0.4 * rng.standard_normal((30, 16)), base[:10], base[:3]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, embedding array<double>, ns int")
    first = {}
    for i, v in enumerate(x):
        first.setdefault((v.tobytes(), i % 2), i)
    want = {(a, b) for a, b in combinations(sorted(first.values()), 2) if a % 2 == b % 2 and x[a] @ x[b] >= 0.8} | {(first[(v.tobytes(), i % 2)], i) for i, v in enumerate(x) if first[(v.tobytes(), i % 2)] != i}
    assert {(r["a"], r["b"]) for r in W.similar_pairs(d, 0.8, ["ns"]).collect()} == want and len(want) > 20
    assert W.similar_pairs(d.limit(0), 0.8, ["ns"]).count() == 0


def test_jaccard_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    sets = [sorted({f"w{k}" for k in rng.integers(0, 25, rng.integers(0, 14))}) for _ in range(150)] + [["w1", "w2"]] * 5
    d = spark.createDataFrame(list(enumerate(sets)), "id long, terms array<string>")
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(a, b) for a, b in combinations(sorted(first.values()), 2) if sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) >= 0.6 * len({*sets[a]} | {*sets[b]})}
    want |= {(first[tuple(s)], i) for i, s in enumerate(sets) if s and first[tuple(s)] != i}
    assert {(r["a"], r["b"]) for r in G.jaccard_pairs(d, 0.6).collect()} == want


@pytest.mark.parametrize("threshold", [0.15, 0.6, 0.99])
def test_similar_sets_in_small_blocks_equal_brute_force(spark, monkeypatch, threshold):
    """Sets of all sizes, in classes that are cut into blocks; only pairs that are similar leave a task."""
    monkeypatch.setattr(O, "BLOCK", 700)
    rng = np.random.default_rng(2)
    sets = [sorted({f"w{k}" for k in rng.zipf(1.3, rng.integers(1, 90)) % 400}) for _ in range(120)]
    sets += [sorted({*s[: len(s) - 1 - i % 3], "new"}) for i, s in enumerate(sets[:40])] + sets[50:60] + [[]]
    d = spark.createDataFrame(list(enumerate(sets)), "id long, terms array<string>")
    want = {(a, b) for a, b in combinations(range(170), 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= threshold}
    got = [(r["a"], r["b"]) for r in O.similar_sets(d, threshold).collect()]
    assert sorted(got) == sorted(want) and len(want) > 5
    assert O.similar_sets(d.where("size(terms) = 0"), threshold).count() == 0


def memory_rows(spark, rows):
    d = spark.createDataFrame(rows, "id long, content string, tags array<string>, day int")
    return d.select("id", "content", "tags", F.lit("t").alias("source"), F.lit(0.5).alias("priority"), F.lit("default").alias("namespace"), F.date_add(F.lit("2024-01-01").cast("date"), "day").cast("timestamp_ntz").alias("created_at"))


def test_merged_chains_end_at_the_first(spark):
    m = memory_rows(spark, [(1, "a", ["x"], 1), (2, "b", ["y"], 2), (3, "c", ["x", "z"], 3), (4, "d", None, 4)]).withColumn("memory_type", F.lit("fact")).withColumn("staleness", F.lit("stable"))
    now, before = W.merge_duplicates(m, spark.createDataFrame([(2, 3), (1, 2)], "a long, b long"))
    got = {r["id"]: (r["content"], r["tags"], r["merged"]) for r in now.collect()}
    assert got == {1: ("c", ["x", "y", "z"], 3), 4: ("d", [], 1)}
    assert [(r["memory_id"], r["content"], r["reason"]) for r in before.collect()] == [(1, "a", "dedup_merge")]


def test_contradictions_and_reflection(spark):
    rows = [
        (1, "The cache flag must always stay enabled here", 1),
        (2, "The cache flag must never stay enabled here", 2),
        (3, "Bread needs warm water and yeast", 3),
        (4, "Bread needs warm water and yeast", 5),
        (5, "Completely other words stand there", 4),
    ]
    d = spark.createDataFrame(rows, "id long, text string, at int")
    assert {(r["a"], r["b"]) for r in W.contradiction_pairs(d).collect()} == {(1, 2)}
    got = {r["id"]: r["state"] for r in W.reflect(d, spark.createDataFrame([(3, 4)], "a long, b long"))[0].collect()}
    assert got == {1: "contradicted", 2: "kept", 3: "duplicate", 4: "kept", 5: "kept"}
    new, after = W.since(d, 3)
    assert sorted(r["id"] for r in new.collect()) == [4, 5] and after() == 5
    assert W.since(d, 9)[1]() == 9


def test_contradictions_in_small_blocks_equal_pairs_of_texts(spark, monkeypatch):
    """Many facts that deny each other meet in blocks: pairs once each, with their scores, and the older ones without any pair."""
    monkeypatch.setattr(O, "BLOCK", 60)
    rng = np.random.default_rng(6)
    words = "alpha beta gamma delta epsilon zeta always never no use avoid yes best worst".split()
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 8))), int(rng.integers(0, 30)), [float(i % 3 == 0), float(i % 3 != 0)]) for i in range(80)] + [(80, None, 3, [0.0, 1.0])]
    d = spark.createDataFrame(rows, "id long, text string, at int, embedding array<float>")
    p, q = d.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("at").alias("at_a")), d.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("at").alias("at_b"))
    both = p.join(q, F.col("a") < F.col("b")).withColumn("c", T.contradiction(F.col("ta"), F.col("tb"), F.lit(0.0))).where("c IS NOT NULL").collect()
    want = {(r["a"], r["b"]) for r in both}
    got = W.contradiction_pairs(d, vectors=d).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want) and len(want) > 50
    assert all(r["score"] == float((r["a"] % 3 == 0) == (r["b"] % 3 == 0)) for r in got)
    old = [r["id"] for r in W.outdated(d.select("id", "text", "at")).collect()]
    assert sorted(old) == sorted({r["b"] if r["at_a"] >= r["at_b"] else r["a"] for r in both})


def test_whole_path_of_writing(spark):
    old = memory_rows(spark, [(1, "The harbour office in Lisbon opens at nine", ["p"], 1)])
    new = memory_rows(spark, [(2, "The harbour office in Lisbon opens at nine", ["q"], 2), (3, "We decided to use postgres <private>pin</private> today", [], 2), (4, "x" * 1_000_001, [], 2)])
    out = W.ingest(old, new, datetime(2024, 6, 1))
    m = {r["id"]: r for r in out["memories"].collect()}
    assert m.keys() == {1, 3} and m[1]["merged"] == 2 and set(m[1]["tags"]) == {"p", "q"}
    assert m[3]["memory_type"] == "decision" and "database" in m[3]["tags"] and "pin" not in m[3]["public"] and "pin" in m[3]["content"] and m[3]["l3"]
    assert {r["id"]: r["action"] for r in out["audit"].collect()} == {2: "store_merge", 3: "store"}
    assert [r["memory_id"] for r in out["versions"].collect()] == [1]
    assert [(r["id"], r["verb"]) for r in out["events"].collect()] == [(3, "decided")]
    kept = W.forgotten(out["memories"], spark.createDataFrame([(3,)], "id long"), events=out["events"].withColumnRenamed("id", "memory_id"))
    assert [r["id"] for r in kept["memories"].select("id").collect()] == [1] and kept["events"].count() == 0


def test_fact_cards(spark):
    rows = [
        (1, "[user]: I prefer dark roast, always. My bike color is deep red.", "2024-01-01"),
        (2, "I prefer dark roast, always. My bike color is green!", "2024-02-01"),
        (3, "User has tried 120 soups. I own it.", "2024-03-01"),
    ]
    d = spark.createDataFrame(rows, "id long, text string, day string").select("id", "text", F.col("day").cast("timestamp_ntz").alias("at"))
    c = K.with_history(K.extract(d)).cache()
    got = {(r["id"], r["kind"], r["attribute"], r["value"], r["valid_until"] is None) for r in c.collect()}
    assert (1, "preference", "dark_roast", "dark roast", True) in got
    assert (1, "fact", "bike_color", "deep red", False) in got and any(g[:3] == (2, "fact", "bike_color") and g[4] for g in got)
    assert (3, "fact", "soups", "120", True) in got and not any(g[3] == "it" for g in got)
    assert K.lookup(c, "bike color").first()["value"].startswith("green")
    assert K.lookup(c, "what roast do I like").first()["value"] == "dark roast"
    assert K.lookup(c, "zebra").count() == 0
    assert {r["attribute"] for r in K.all_current(c, attribute="bike").collect()} == {"bike_color"}
    assert [r["id"] for r in K.history(c, "bike").collect()] == [1, 2]


CODE = {
    1: 'import os\nimport re\n\nfrom typing import Any\n\nimport zlib\n\ndef load_file(path: str) -> str:\n    """Read.\n\n    Args:\n        path: where.\n    """\n    try:\n        return my_name\n    except OSError:\n        raise LoadError\n',
    2: "const maxSize = 3\nfunction getName(userName) { return userName }\nlet innerValue = getName(maxSize)",
    3: "plain words without code",
    4: "class MyError(Exception): pass\nassert total_sum\nassert other_sum\npip install left-pad\nnpm install @scope/pkg\nnumpy>=1.2",
}


def test_styles_of_code(spark):
    got = {r["id"]: r for r in P.styles(spark.createDataFrame(list(CODE.items()), "id long, text string")).collect()}
    assert [got[i]["naming"] for i in (1, 2, 3)] == ["PascalCase", "camelCase", "unknown"]
    assert got[1]["imports"] == "grouped, absolute" and got[2]["imports"] == "none"
    assert got[1]["errors"] == "try/except with custom exceptions" and got[4]["errors"] == "assertions with custom exceptions" and got[3]["errors"] == "unknown"
    assert got[1]["hints"] == "heavy" and got[2]["hints"] == "none" and got[1]["docstrings"] == "google" and got[4]["docstrings"] == "none"
    assert got[1]["libraries"] == ["os", "re", "typing", "any", "zlib"] or got[1]["libraries"][:3] == ["os", "re", "typing"]
    assert {"left_pad", "@scope/pkg", "numpy"} <= set(got[4]["libraries"])


def test_profile_sections(spark):
    rows = [(i, t, "code" if i != 3 else "observation", ["review"] if i == 3 else [], "") for i, t in CODE.items()]
    rows += [(5, "We avoid global state at all cost. GraphQL is nice. GraphQL again.", "general", [], ""), (6, "Missing tests were noted; no tests at all.", "observation", ["mistake"], "Forgot to test")]
    m = spark.createDataFrame(rows, "id long, content string, memory_type string, tags array<string>, l3 string")
    got = {r["section"]: json.loads(r["value"]) for r in P.build(m).collect()}
    assert got["architecture_patterns"] == ["GraphQL"] and got["review_feedback"] == ["missing tests"]
    assert got["anti_patterns"] == ["Forgot to test", "We avoid global state at all cost"] and got["confidence"] == round(0.6 * 3 / 6 + 0.4 * 6 / 50, 2)
    assert got["code_style"]["docstring_style"] == "google" and got["naming_conventions"]["dominant"] == "camelCase"
    assert P.build(m.limit(3)).count() == 0


def test_tasks_are_unblocked(spark):
    t = spark.createDataFrame([(1, "open", []), (2, "blocked", [1]), (3, "blocked", [1, 4]), (4, "open", []), (5, "blocked", [9])], "id long, status string, blocked_by array<long>")
    got = {r["id"]: (r["status"], r["blocked_by"]) for r in S.complete(t, spark.createDataFrame([(1,), (1,)], "id long")).collect()}
    assert got == {1: ("done", []), 2: ("open", []), 3: ("blocked", [4]), 4: ("open", []), 5: ("blocked", [9])}
    claims = spark.createDataFrame([(4, 2, "bob"), (4, 1, "alice"), (2, 1, "bob")], "task_id long, seq long, agent string")
    got = {r["id"]: (r["status"], r["assigned_to"]) for r in S.decide(t, claims).collect()}
    assert got[4] == ("claimed", "alice") and got[2] == ("blocked", None) and got[1] == ("open", None)


def test_catch_up_keeps_to_the_budget(spark):
    members = spark.createDataFrame([("alice",), ("bob",)], "agent string")
    tasks = spark.createDataFrame([(1, "dig", "open", None), (2, "fill", "done", "bob")], "id long, title string, status string, assigned_to string")
    decisions = spark.createDataFrame([(i, f"d{i}", "because", "bob") for i in range(30)], "seq long, title string, rationale string, decided_by string")
    handoffs = spark.createDataFrame([(i, "bob", "word " * 40, ["why"], [i, i + 1]) for i in range(12)], "seq long, from_agent string, summary string, open_questions array<string>, memory_ids array<long>")
    full = S.catch_up("w", "g", members, tasks, decisions, handoffs, 4000)
    assert len(full["overview"]["decision_titles"]) == 20 and full["overview"]["task_summary"]["open"] == 1 and len(full["details"]["handoffs"]) == 10 and full["memory_ids"] == list(range(13))
    small = S.catch_up("w", "g", members, tasks, decisions, handoffs, 500)
    assert "decisions" not in small["details"] and len(small["details"]["handoffs"]) == 5
    assert S.catch_up("w", "g", members, tasks, decisions, handoffs, 100)["details"] is None


def test_json_array_and_backups(spark, tmp_path):
    m = spark.createDataFrame([(i, f"text {i} \"quoted\"\nline") for i in (3, 1, 2)], "id long, content string").repartition(3)
    exports.json_array(m, f"{tmp_path}/a")
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert [x["id"] for x in json.loads(whole)] == [1, 2, 3]
    exports.backup({"m": m}, f"{tmp_path}/b")
    assert [r["name"] for r in exports.backups(spark, f"{tmp_path}/b").collect()] == ["m"]
    m.where("id = 1").write.parquet(f"{tmp_path}/live/m")
    assert exports.restore(spark, f"{tmp_path}/b", f"{tmp_path}/live", ["m"], f"{tmp_path}/safe")["m"].count() == 3
    assert spark.read.parquet(f"{tmp_path}/safe/m").count() == 1


def made_pdf(pages):
    out = b"%PDF-1.4\n"
    n = 1
    for i, text in enumerate(pages):
        body = zlib.compress(b"BT /F1 12 Tf 72 720 Td (" + text.replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj 0 -14 Td [(sec) -20 (ond line)] TJ ET") if i % 2 == 0 else b"BT (" + text.encode("latin-1") + b") Tj ET"
        head = b"/Filter /FlateDecode " if i % 2 == 0 else b""
        out += b"%d 0 obj <</Type /Page /Contents %d 0 R>> endobj\n%d 0 obj <<%s/Length %d>> stream\n%s\nendstream endobj\n" % (n, n + 1, n + 1, head, len(body), body)
        n += 2
    return out


def test_pdf_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made_pdf(["First page (really) here", "Second page, plain stream", "short"]))
    got = imports.read_pdf(spark, str(tmp_path), ["t"]).orderBy("content").collect()
    assert [(r["content"], r["tags"]) for r in got] == [("First page (really) here\nsecond line", ["t", "page:1"]), ("Second page, plain stream", ["t", "page:2"]), ("short\nsecond line", ["t", "page:3"])]


def test_notion_archives(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("p.md", "# My page\nTags: a, b\nText that is long enough to stay [here]().\n" + "0" * 32 + "\nend")
        z.writestr("d.csv", "Name,Tags,Note\nRow one,c,some longer note here\n,,x\n")
    got = {r["l3"]: r for r in imports.read_notion(spark, str(tmp_path)).collect()}
    assert got["My page"]["tags"] == ["notion", "a", "b"] and "here." in got["My page"]["content"] and "0000" not in got["My page"]["content"]
    assert got["Row one"]["content"] == "# Row one\n**Note**: some longer note here" and got["Row one"]["tags"] == ["notion", "c"] and len(got) == 2


@pytest.mark.parametrize(("command", "kept"), [("ls -la", False), ("/bin/ls -a -b", True), ("echo a > b", True), ("cat < b", True), ("git status", True), ("cd ..", False), ("x", False)])
def test_interesting_commands(spark, command, kept):
    assert spark.createDataFrame([(command,)], "c string").where(imports.interesting_command(F.col("c"))).count() == kept


def test_snapshot_and_changes_of_cards(spark):
    rows = [(1, "My bike color is deep red.", "2024-01-01"), (2, "My bike color is green!", "2024-02-01"), (3, "I prefer dark roast.", "2024-03-01")]
    d = spark.createDataFrame(rows, "id long, text string, day string").select("id", "text", F.col("day").cast("timestamp_ntz").alias("at"))
    c = K.with_history(K.extract(d))
    assert K.snapshot(c) == "## Current Knowledge\n\n### User\n- bike_color: green! [2024/02/01]\n- dark_roast: dark roast [2024/03/01]"
    assert K.change_history(c, "bike") == "## Knowledge Changes Detected\n- User.bike_color: OLD (2024/01/01): deep red → CURRENT (2024/02/01): green!"
    assert K.change_history(c, "zzz") == ""


def test_ordered_places_and_neighbours(spark):
    from keepstone.operators.ordered import nth_of_group, placed, previous

    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 3 > 0], int(v)) for i, v in enumerate(rng.permutation(500))]
    d = spark.createDataFrame(rows, "id long, g string, v long").repartition(7)
    order = sorted(rows, key=lambda r: r[2])
    p = previous(placed(d, ["v"]), ["v"])
    got = {r["id"]: (r["place"], r["last"]["v"] if r["last"] else None) for r in p.collect()}
    assert got == {r[0]: (i, order[i - 1][2] if i else None) for i, r in enumerate(order)}
    third = {r["g"]: r["v"] for r in nth_of_group(d, "g", ["v"], F.lit(2)).collect()}
    assert third == {g: sorted(r[2] for r in rows if r[1] == g)[2] for g in "ab"}
    assert placed(d.limit(0), ["v"]).count() == 0


def test_streams_of_repositories_and_caches(spark, tmp_path):
    from keepstone.streaming import activity as A

    polls = [
        ("r", "2024-01-01 00:00:01", "c1", "first", "main", "a.py | 1 +"),
        ("r", "2024-01-01 00:00:02", "c2", "second", "main", "a.py | 1 +\n b.py | 2 ++\n 2 files changed"),
        ("r", "2024-01-01 00:00:03", "c2", "second", "dev", ""),
        ("q", "2024-01-01 00:00:01", "x", "m", "main", None),
    ]
    schema = "repo string, ts timestamp, head string, message string, branch string, diff_stat string"
    spark.createDataFrame([(r, datetime.fromisoformat(t), *x) for r, t, *x in polls], schema).write.parquet(f"{tmp_path}/polls")
    out = []
    q = A.repository_changes(spark.readStream.schema(schema).parquet(f"{tmp_path}/polls")).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").foreachBatch(lambda b, _: out.extend(b.collect())).start()
    q.awaitTermination()
    assert sorted((r["repo"], r["type"], r["new"].split("\n")[0], r["changed_files"]) for r in out) == [("r", "git_branch", "dev", []), ("r", "git_commit", "second", []), ("r", "git_diff", "a.py | 1 +", ["a.py", "b.py"])]

    spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 5), 3), (1, datetime(2024, 1, 1, 0, 0, 1), 9), (2, datetime(2024, 1, 1, 0, 0, 2), 4)], "id long, ts timestamp, tokens long").write.parquet(f"{tmp_path}/results")
    seen = []
    q = A.cached_stream(spark.readStream.schema("id long, ts timestamp, tokens long").parquet(f"{tmp_path}/results")).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").foreachBatch(lambda b, _: seen.extend(b.collect())).start()
    q.awaitTermination()
    assert {(r["id"], r["tokens"], r["expired"]) for r in seen} == {(1, 3, False), (2, 4, False)}
    fresh = spark.createDataFrame([(1, 5, 60), (2, 4, 50), (3, 3, 10)], "id long, ts long, tokens long")
    assert [r["id"] for r in A.within_budget(fresh, 70).collect()] == [1] and [r["id"] for r in A.within_budget(fresh, 20).collect()] == [1]

    batches = []
    q = A.per_batch(spark.readStream.schema("id long, ts timestamp, tokens long").parquet(f"{tmp_path}/results"), lambda b, i: batches.append(b.count()), f"{tmp_path}/c3", every="1 second").start()
    q.processAllAvailable()
    q.stop()
    assert sum(batches) == 3


def test_related_facts_are_merged_into_summaries(spark):
    """A duplicate, two that contradict each other, three related ones of which two say the same, a pair too small to merge."""
    rows = [
        (1, "the cache is in redis", 1), (2, "the cache is in redis", 2), (3, "feature flags must always be enabled here", 3), (4, "feature flags must never be enabled here", 4),
        (5, "boats need paint", 5), (6, " boats need paint ", 6), (7, "boats need red paint", 7), (8, "gardens need water", 8), (9, "gardens like water", 9),
    ]
    d = spark.createDataFrame(rows, "id long, text string, at long")
    pairs = lambda p: spark.createDataFrame(p, "a long, b long")
    states, made = W.reflect(d, pairs([(1, 2)]), pairs([(5, 6), (6, 7), (8, 9), (1, 5), (3, 5)]))
    got = {x["id"]: (x["state"], x["merged_into"]) for x in states.collect()}
    assert got == {1: ("duplicate", None), 2: ("kept", None), 3: ("contradicted", None), 4: ("kept", None), 5: ("merged", "summary-5"), 6: ("merged", "summary-5"), 7: ("merged", "summary-5"), 8: ("kept", None), 9: ("kept", None)}
    assert [tuple(x) for x in made.collect()] == [("summary-5", 3, "boats need paint; boats need red paint")]
    assert W.reflect(d, pairs([(1, 2)]))[1].collect() == []


def test_only_facts_that_are_left_are_asked_for_related_ones(spark):
    """What gives the related pairs sees neither duplicates nor contradicted facts; the outcome is that of all pairs."""
    rows = [
        (1, "the cache is in redis", 1), (2, "the cache is in redis", 2), (3, "feature flags must always be enabled here", 3), (4, "feature flags must never be enabled here", 4),
        (5, "boats need paint", 5), (6, "boats need more paint", 6), (7, "boats need red paint", 7),
    ]
    d = spark.createDataFrame(rows, "id long, text string, at long")
    pairs = lambda p: spark.createDataFrame(p, "a long, b long")
    every, asked = [(5, 6), (6, 7), (1, 5), (3, 5)], []

    def related(left):
        asked.extend(sorted(x["id"] for x in left.collect()))
        return pairs([p for p in every if {*p} <= {*asked}])

    states, made = W.reflect(d, pairs([(1, 2)]), related)
    assert asked == [2, 4, 5, 6, 7]
    whole = W.reflect(d, pairs([(1, 2)]), pairs(every))
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, whole[0].collect())) and made.collect() == whole[1].collect()


def test_postings_are_two_arrays_whatever_the_number_of_terms():
    rows = pa.table({"id": [1, 2, 3], "side": [0, 0, 1], "terms": [[10, 20, 30], [20, 40], [20, 30, 50]]})
    s = O.Sets(rows)
    place, at = s.postings(np.array([0, 1]), s.n)
    assert place.tolist() == [0, 0, 1, 0, 1] and at.tolist() == [0, 1, 3, 4, 5, 5]
    assert O.counted((place, at), s.flat[s.at[2] : s.at[3]], 2).tolist() == [2, 1]
    assert O.counted((place, at), s.flat[:0], 2).tolist() == [0, 0]


def test_similar_pairs_leave_their_bucket_only_where_they_are_near(spark, monkeypatch):
    """3,000 vectors of which few are near: far fewer pairs leave the buckets than meet in them, also where buckets are cut."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 24))
    x[2900:] = x[:100] + 0.3 * rng.standard_normal((100, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "id long, embedding array<double>, ns int")
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.8, 1)))}
    met, inner = [], W._met
    monkeypatch.setattr(W, "_met", lambda *a: met.append(inner(*a)) or met[-1])
    assert {(r["a"], r["b"]) for r in W.similar_pairs(d, 0.8, ["ns"]).collect()} == want and len(want) > 50
    assert met[-1].count() < 2 * len(want) + 20
    monkeypatch.setattr(W, "PIECE", 16)
    assert {(r["a"], r["b"]) for r in W.similar_pairs(d, 0.8, ["ns"]).collect()} == want


def test_groups_by_batches_equal_one_pass(spark, tmp_path):
    """A batch that joins groups of earlier ones, copies within and between batches, a batch that is repeated, an empty one."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((40, 12))
    x = np.concatenate([base, base[:20] + 0.25 * rng.standard_normal((20, 12)), base[:20] + 0.25 * rng.standard_normal((20, 12)), base[:6]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.arange(len(x))
    near = x @ x.T >= 0.85
    while True:
        least = np.where(near, label[None, :], len(x)).min(1)
        if (least == label).all():
            break
        label = least
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    g = W.Groups.start(spark, str(tmp_path / "g"), 0.85, 12, len(x))
    for k in (2, 0, 3, 1):
        part = d.where(f"id % 4 = {k}")
        g.add(part)
        if k == 0:  # as after a failure before the batch was counted
            g.batches -= 1
            g.add(part)
    g.add(d.where("id < 0"))
    assert {r["id"]: r["label"] for r in g.labels().collect()} == dict(enumerate(label.tolist())) and len(set(label.tolist())) < 60
    assert W.Groups.start(spark, str(tmp_path / "h"), 0.85, 12, 1).labels().count() == 0


def test_styles_of_a_profile_are_found_in_one_pass(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(P, "stash", lambda d, name: passes.append(sorted(d.columns)) or d)
    m = spark.createDataFrame([(i, "def some_name(x):\n    return x", "code", ["code"], "") for i in range(6)], "id long, content string, memory_type string, tags array<string>, l3 string")
    assert P.build(m).count() == 8
    assert passes == [sorted(["snake_case", "camelCase", "PascalCase", "SCREAMING_CASE", "imports", "errors", "hints", "docstrings", "m"])]


def test_every_similar_pair_is_given_with_copies_at_the_threshold_and_in_small_pieces(spark, monkeypatch):
    """Copies meet each other and what their vector is similar to; of pairs at the very threshold none is left out; nulls pair with nothing."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(200):  # at the threshold, within 1e-3
        w = x[k + 200] - (x[k + 200] @ x[k]) * x[k]
        c = 0.7 + (k - 100) * 1e-5
        x[k + 200] = c * x[k] + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
    x = np.concatenate([x, x[:40], x[:40], x[200:220]])
    rows = [(i, v.tolist(), i % 20 % 3) for i, v in enumerate(x)]
    d = spark.createDataFrame([*rows, (900, None, 0), (901, x[0].tolist(), None), (902, x[0].tolist(), None)], "id long, embedding array<double>, ns int")
    ns = np.array([r[2] for r in rows])
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu((x @ x.T >= 0.7) & (ns[:, None] == ns[None, :]), 1)))}
    assert len(want) > 200
    for piece in (W.PIECE, 128):
        monkeypatch.setattr(W, "PIECE", piece)
        got = [(r["a"], r["b"]) for r in W.every_similar_pair(d, 0.7, ["ns"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert W.every_similar_pair(d.limit(0), 0.7, ["ns"]).count() == 0


def test_a_summary_has_all_texts_of_its_group(spark):
    """260 related facts, of which some say the same: all distinct texts are told in the order of ids, as a text and as its digest."""
    rows = [(i, f"boats need paint number {i if i % 9 else 0}", i) for i in range(260)] + [(300, None, 300)]
    d = spark.createDataFrame(rows, "id long, text string, at long")
    none, chain = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(i, i + 1) for i in range(259)], "a long, b long")
    want = "; ".join(dict.fromkeys(r[1] for r in rows[:260]))
    assert len(want.split("; ")) > 200
    assert [tuple(x) for x in W.reflect(d, none, chain)[1].collect()] == [("summary-0", 260, want)]
    assert [tuple(x) for x in W.reflect(d, none, chain, digests=True)[1].collect()] == [("summary-0", 260, hashlib.md5(want.encode()).hexdigest())]


def test_facts_that_meet_the_newest_first_are_outdated_as_by_all_pairs(spark, monkeypatch):
    """What the newest facts leave meets all others, also where there are ties of time and facts that nothing contradicts."""
    monkeypatch.setattr(O, "BLOCK", 300)
    rng = np.random.default_rng(16)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda always never no use avoid".split()
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 7))), int(rng.integers(0, 40))) for i in rng.permutation(150)]
    d = spark.createDataFrame(rows, "id long, text string, at long")
    at = {r[0]: r[2] for r in rows}
    pairs = W.contradiction_pairs(d.select("id", "text")).collect()
    want = sorted({r["b"] if at[r["a"]] >= at[r["b"]] else r["a"] for r in pairs})
    assert 20 < len(want) < 140
    met, inner = [], W._against
    monkeypatch.setattr(W, "_against", lambda left, right, *a: met.append((left.count(), right.count())) or inner(left, right, *a))
    for newest in ((4, 16), (3,), ()):
        met.clear()
        monkeypatch.setattr(W, "NEWEST", newest)
        assert sorted(r["id"] for r in W.outdated(d).collect()) == want
        if newest:
            assert met[0] == (2 * newest[0], 150) and met[-2][0] + met[-1][0] < 150  # what is left at last


def test_blocks_that_meet_are_shuffled_once(spark, monkeypatch, tmp_path):
    """Whatever the number of cells, a piece is packed once, and cells read it."""
    monkeypatch.setattr(O, "BLOCK", 40)
    packs, inner = [], O.packed
    monkeypatch.setattr(O, "packed", lambda rows, n: packs.append((rows.count(), n)) or inner(rows, n))
    d = spark.createDataFrame([(i, [f"w{(i + k) % 50}" for k in range(8)]) for i in range(60)], "id long, terms array<string>")
    assert O.similar_sets(d, 0.6).count() > 20
    assert [p[0] for p in packs] == [60] and packs[0][1] > 8


def test_names_of_any_length_are_found_and_relations_stay_with_their_text(spark):
    """A heading of 20,000 words and a path of as many parts take no stack; names end with a word; relations are those of entities found before."""
    rows = [
        (1, "start " + "Abc " * 20_000 + "end"), (2, "see " + "/ab" * 20_000), (3, "then Bob Lee Kim9 and Ann de Wit uses Tom Poe. Ann de Wit is a Tom Poe! Tom Poe built with Zed"),
        (4, "no names here. uses this"), (5, None), (6, 'Mix "Red Fox" depends on "Big Cat"; Red Fox requires Big Cat\nRed Fox uses Red Fox'), (7, "of The Who and The The"),
    ]
    d = spark.createDataFrame(rows, "id long, text string")
    names = {}
    for r in G.extract_entities(d).collect():
        names.setdefault(r["id"], set()).add(r["name"])
    assert ("Abc " * 20_000).strip() in names[1] and "/ab" * 20_000 in names[2]
    assert "Bob Lee" in names[3] and "Bob Lee Kim" not in names[3] and "Ann de Wit" in names[3]
    few = d.where("id > 2")
    got = sorted(map(tuple, G.extract_relationships(few).collect()))
    assert got == sorted(map(tuple, G.extract_relationships(few, G.extract_entities(few)).collect())) and len(got) == len(set(got))
    assert {(3, "Ann de Wit", "Tom Poe", "co_occurs"), (6, "Big Cat", "Red Fox", "co_occurs")} <= set(got)
