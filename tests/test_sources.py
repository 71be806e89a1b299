"""Spans of sensitive data, dense parts of pages, and syncs, against plain Python and written-out cases."""

import html as H
import itertools
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import spans as P
from keepstone.plans.data import SAMPLES
from keepstone.sources import exports, imports, sync

SF = "/root/testdata/sf0.001"


def _plain(text):
    return sorted((m.start(), m.end(), c, n) for c, n, p in K.SENSITIVE_PATTERNS for m in re.finditer(p, text))


TEXTS = [*SAMPLES, None, "", "no data", "é😀 a@b.io, é a@b.io", "sk-ant-" + "x" * 30, "password: secret123 password=hunter22222", "415-555-2671 " * 40, 'api_key="abcdefghijklmnopqrstuv" 123-45-6789', "a@b.io", "x 4111-1111-1111-1111"]


def test_spans_equal_a_scan(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {x["id"]: [tuple(s) for s in x["s"]] for x in d.select("id", P.sensitive_spans(F.col("text")).alias("s")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (_plain(t) if t else []), t
    assert sum(map(len, got.values())) > 50


def test_redaction_by_spans(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("s", P.sensitive_spans(F.col("text")))
    got = {x["id"]: x["r"] for x in d.select("id", P.redacted(F.col("text"), F.col("s")).alias("r")).collect()}
    for i, t in enumerate(TEXTS):
        want, at = "", 0
        for a, b, c, _ in _plain(t) if t else []:
            if a >= at:
                want, at = want + t[at:a] + f"[{c.upper()}_REDACTED]", b
        assert got[i] == (None if t is None else want + t[at:]), t


def test_spans_of_documents_equal_a_scan(spark):
    pytest.importorskip("pyarrow.parquet")
    d = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    for x in d.select("text", P.sensitive_spans(F.col("text")).alias("s")).collect():
        assert [tuple(s) for s in x["s"]] == _plain(x["text"] or "")


def _words(text):
    return set(re.findall(r"\w+", text.lower()))


def test_dense_blocks_are_the_article(spark):
    """Pages whose article isn't marked: of its words nearly all are found, and few others."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    bare = [(x["page_id"], re.sub(r"</?article>", "", x["html"])) for x in pages]
    got = {x["id"]: x["t"] for x in spark.createDataFrame(bare, "id long, html string").select("id", imports.main_text(F.col("html")).alias("t")).collect()}
    hit = kept = whole = 0
    for x in pages:
        truth = _words(H.unescape(re.sub(r"<[^>]*>", " ", re.search(r"(?s)<article>(.*)</article>", x["html"])[1])))
        told = _words(got[x["page_id"]])
        hit, kept, whole = hit + len(truth & told), kept + len(told), whole + len(truth)
    assert hit / whole > 0.95 and hit / kept > 0.9


PAGE = """<html><head><title>t</title></head><body><ul><li><a href="/a">Home page</a></li><li><a href="/b">About us</a></li></ul>
<div>Ad: buy now</div><h2>A story of the sea</h2><p>{0}</p><p>It was a short one &amp; true.</p><p>{0} See <a href="/x">this</a>.</p>
<ul><li><a href="/c">More stories like this one here</a></li><li><a href="/d">And another</a></li></ul><div>Terms</div></body></html>"""


def test_menus_and_lists_of_links_are_no_content(spark):
    long = " ".join(["waves", "rise", "and", "fall", "with", "the", "wind"] * 5)
    got = spark.createDataFrame([(PAGE.format(long),), ("<p>tiny</p>",), ("",), (None,)], "html string").select(imports.main_text(F.col("html")).alias("t")).collect()
    assert got[0]["t"].split("\n") == ["A story of the sea", long, "It was a short one & true.", f"{long} See this ."]
    assert [x["t"] for x in got[1:]] == ["tiny", "", None]  # nothing dense: all of it


OLD, NEW, NEWER = "old", "new", "newer"
WANT = {
    ("same", "same"): "none", ("same", "changed"): "export", ("same", "gone"): "delete_note",
    ("changed", "same"): "import", ("changed", "changed"): "conflict", ("changed", "gone"): "import",
    ("gone", "same"): "delete_memory", ("gone", "changed"): "export", ("gone", "gone"): "forget",
    ("new", "absent"): "import", ("absent", "new"): "export", ("new", "new"): "conflict",
}


def test_sync_of_every_combination(spark):
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    base, notes, memories, want = [], [], [], {}
    ident = itertools.count()
    for (a, b), action in WANT.items():
        for n, m, (t, u) in itertools.product((NEW, NEWER), (NEW, NEWER), ((early, late), (late, early), (early, early), (None, late))):
            i = f"i{next(ident)}"
            base += [(i, OLD)] * (a not in ("new", "absent") and b not in ("new", "absent"))
            notes += [(i, OLD if a == "same" else n, t)] * (a in ("same", "changed", "new"))
            memories += [(i, OLD if b == "same" else m, u)] * (b in ("same", "changed", "new"))
            if action == "conflict":
                want[i] = "agree" if n == m else "import" if t and t > u else "export"
            else:
                want[i] = action
    b = spark.createDataFrame(base, "id string, content string").withColumn("digest", sync.digest(F.col("content")))
    n = spark.createDataFrame(notes, "id string, content string, modified timestamp").withColumn("digest", sync.digest(F.col("content")))
    m = spark.createDataFrame(memories, "id string, content string, modified timestamp").withColumn("digest", sync.digest(F.col("content")))
    plan = sync.sync_plan(b.select("id", "digest"), n, m).cache()
    assert {x["id"]: x["action"] for x in plan.collect()} == want
    x, y = sync.apply(plan, n, m)
    x, y = ({r["id"]: r["content"] for r in d.collect()} for d in (x, y))
    assert x == y and x
    after = {r["id"]: r["digest"] for r in sync.synced(plan).collect()}
    told = spark.createDataFrame(list(x.items()), "id string, content string").select("id", sync.digest(F.col("content")).alias("d"))
    assert after == {r["id"]: r["d"] for r in told.collect()}
    both = spark.createDataFrame([(i, c, early) for i, c in x.items()], "id string, content string, modified timestamp").withColumn("digest", sync.digest(F.col("content")))
    again = sync.sync_plan(sync.synced(plan), both, both)
    assert {r["action"] for r in again.collect()} == {"none"}
    assert sync.sync_plan(b.where("id = ''").select("id", "digest"), n.where("id = ''"), m.where("id = ''")).collect() == []
    plan.unpersist()


def test_digests_ignore_blanks_around_a_content(spark):
    d = spark.createDataFrame([(" a b\n",), ("a b",), ("a  b",), (None,)], "c string").select(sync.digest(F.col("c")).alias("d")).collect()
    assert d[0]["d"] == d[1]["d"] != d[2]["d"] and d[3]["d"] is None


def test_context_tells_ages_in_whole_days_also_of_times_ahead(spark):
    d = spark.sql("SELECT id, 'x' AS content, array('t') AS tags, 0.5D AS priority, timestamp_ntz'2024-06-01 00:00:00' + make_dt_interval(0, h) AS created_at FROM VALUES (1, -30), (2, -2), (3, 2), (4, 50) AS t(id, h)")
    now = F.expr("timestamp_ntz'2024-06-01 00:00:00'")
    told = lambda **k: [r["text"] for r in exports.context(d, now, **k).where("section = 'recent'").orderBy("pos").collect()]
    assert told(aged=exports.age_in_days) == ["[-3d] x", "[-1d] x", "[0d] x", "[1d] x"]
    assert told() == ["[-3d] x", "[-1d] x", "[2h] x", "[1d] x"]
