"""The jobs on growing input: what is new is taken, nothing twice, and a run that failed is repeated with the same result."""

import glob
import hashlib
import json
import os
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import jobs.queries as Q
from jobs import intake, rollup
from tests.test_queries import duck, rows  # noqa: F401

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
supplied = pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")


@supplied
@pytest.mark.parametrize("name", ["job1_intake", "job2_rollup"])
def test_job_equals_its_sql(spark, duck, name):  # noqa: F811
    df = Q.queries()[name](spark, SF)
    told = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, told.fetchall())


# ---- intake

TEXT = "The deploy of service {} failed because the pipeline was broken. We fixed it. Call 415-555-2671 now."


def _documents(spark, path, items):
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in items], intake.DOCUMENTS).coalesce(1).write.mode("append").parquet(path)


def _took(spark, out):
    return sorted(((x["doc_id"], x["outcome"], x["memory_id"]) for x in intake.store(spark, out).collect()), key=str)


def _intake(spark, tmp_path, config=None):
    return intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at"), Q.shipped("intake") | (config or {}))


def test_intake_takes_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "in")
    _documents(spark, path, [(5, TEXT.format(1), "en"), (3, TEXT.format(1), "de"), (3, TEXT.format(1), "de"), (8, "  ", None), (9, None, "en"), (None, TEXT.format(2), "en"), (10, "<private>secret</private>abcd", "en"), (11, "x" * 1_000_001, "en")])
    first = _intake(spark, tmp_path)
    assert first == {"batches": 1, "memories": 1, "copies": 2, "rejected": 5}
    assert _took(spark, str(tmp_path / "out")) == sorted([(3, "stored", 3), (3, "copy", 3), (5, "copy", 3), (8, "short", None), (9, "short", None), (None, "no id", None), (10, "short", None), (11, "large", None)], key=str)
    assert _intake(spark, tmp_path) == {"batches": 0, "memories": 0, "copies": 0, "rejected": 0}
    _documents(spark, path, [(1, TEXT.format(1), "en"), (20, TEXT.format(20), None), (21, TEXT.format(20), "en")])
    assert _intake(spark, tmp_path) == {"batches": 1, "memories": 1, "copies": 2, "rejected": 0}
    later = {t for t in _took(spark, str(tmp_path / "out")) if t[0] in (1, 20, 21)}
    assert later == {(1, "copy", 3), (20, "stored", 20), (21, "copy", 20)}  # what was there first stays
    m = {x["memory_id"]: x for x in spark.read.parquet(str(tmp_path / "out/memories")).collect()}
    assert "415-555" not in m[3]["content"] and m[3]["n_marks"] == 1 and m[3]["namespace"] == "de" and m[20]["namespace"] is None
    assert m[3]["key"] == hashlib.sha256(TEXT.format(1).encode()).hexdigest() and m[3]["abstract"] and 1 <= len(m[3]["facts"]) <= 5
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "out/memories/batch=*"))) == ["batch=0", "batch=1"]


def test_intake_repeats_a_failed_batch(spark, tmp_path, monkeypatch):
    """The batch fails after its keys and memories are written; the next run does it again, once."""
    path = str(tmp_path / "in")
    _documents(spark, path, [(i, TEXT.format(i % 7), "en") for i in range(20)])
    whole, calls = intake.replace_partitions, []

    def failing(d, to, *by):
        calls.append(to)
        if to.endswith("copies"):
            raise OSError("lost")
        whole(d, to, *by)

    monkeypatch.setattr(intake, "replace_partitions", failing)
    with pytest.raises(Exception, match="lost"):
        _intake(spark, tmp_path)
    assert any(c.endswith("memories") for c in calls)
    monkeypatch.setattr(intake, "replace_partitions", whole)
    assert _intake(spark, tmp_path) == {"batches": 1, "memories": 7, "copies": 13, "rejected": 0}
    assert Counter(o for _, o, _ in _took(spark, str(tmp_path / "out"))) == {"stored": 7, "copy": 13}


def test_intake_in_small_batches_and_of_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    for k in range(3):
        _documents(spark, path, [(10 * k + i, TEXT.format(i), "en") for i in range(4)])
    done = _intake(spark, tmp_path, {"files_per_batch": 1, "redact": False})
    assert done == {"batches": 3, "memories": 4, "copies": 8, "rejected": 0}
    assert "415-555" in spark.read.parquet(str(tmp_path / "out/memories")).first()["content"]
    empty = tmp_path / "none"
    spark.createDataFrame([], intake.DOCUMENTS).write.parquet(str(empty / "in"))
    assert _intake(spark, empty)["memories"] == 0 and intake.store(spark, str(empty / "out")).count() == 0


# ---- rollup

START = datetime(2024, 3, 1)


def _events(spark, path, items, mode="append"):
    spark.createDataFrame([(i, t, u, k, v) for i, t, u, k, v in items], rollup.EVENTS).coalesce(1).write.mode(mode).parquet(path)


def _made(n, start=0, days=5):
    return [(start + i, START + timedelta(minutes=(i * 7919) % (1440 * days)), None if i % 41 == 0 else i % 9 if i % 3 else 1, f"k{i % 4}", float(i * 37 % 200)) for i in range(n)]


def _plain(items, config):
    """Digests and facts by a loop over the sorted events."""
    out, last_day, last = {}, {}, {}
    for i, t, u, k, v in sorted(items, key=lambda x: (x[1], x[0])):
        value, day = int(v // config["value_step"]), t.date()
        d = out.setdefault(("day", day, u, k), [0, 0, 0, None, t, t])
        f = out.setdefault(("fact", None, u, k), [0, 0, 0, None, t, t])
        before = last_day.get((day, u, k))
        new = before is None or t - before[0] > timedelta(minutes=config["session_minutes"])
        for x, prior in ((d, before and before[1]), (f, last.get((u, k)))):
            x[0] += 1
            x[1] += new
            x[2] += prior is not None and prior != value
            x[3], x[5] = value, t
        last_day[day, u, k], last[u, k] = (t, value), value
    return {k: tuple(v) for k, v in out.items()}


def _tables(spark, out):
    return {(x["kind"], x["day"], x["user_id"], x["attribute"]): (x["n"], x["sessions"], x["changes"], x["value"], x["first_at"], x["last_at"]) for x in rollup.tables(spark, out).collect()}


def test_rollup_follows_growing_events(spark, tmp_path):
    path, out, config = str(tmp_path / "in"), str(tmp_path / "out"), Q.shipped("rollup")
    first = _made(600)
    _events(spark, path, first)
    done = rollup.run(spark, path, out, config)
    assert done["read"] == 600 and _tables(spark, out) == _plain(first, config)
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/days/*/*/*.parquet")}
    assert rollup.run(spark, path, out, config) == {"read": 0, "skipped": 0, "days": 0, "facts": 0}
    late = [(900 + i, START + timedelta(hours=30, minutes=i * 11), i % 3, "k1", float(i)) for i in range(40)]  # on the second day
    _events(spark, path, late)
    done = rollup.run(spark, path, out, config)
    assert done["read"] == 40 and _tables(spark, out) == _plain(first + late, config)
    kept = {p for p, t in before.items() if os.path.exists(p) and os.path.getmtime(p) == t}
    assert kept and all("day=2024-03-02" not in p for p in kept) and len(kept) == sum("day=2024-03-02" not in p for p in before)  # other days weren't touched
    assert rollup.mark_of(spark, out) == 939


def test_rollup_repeats_a_failed_run(spark, tmp_path, monkeypatch):
    path, out, config = str(tmp_path / "in"), str(tmp_path / "out"), Q.shipped("rollup")
    items = _made(300)
    _events(spark, path, items)
    whole = rollup.replace_partitions

    def failing(d, to, *by):
        if to.endswith("facts"):
            raise OSError("lost")
        whole(d, to, *by)

    monkeypatch.setattr(rollup, "replace_partitions", failing)
    with pytest.raises(OSError):
        rollup.run(spark, path, out, config)
    assert rollup.mark_of(spark, out) is None
    monkeypatch.setattr(rollup, "replace_partitions", whole)
    assert rollup.run(spark, path, out, config)["read"] == 300 and _tables(spark, out) == _plain(items, config)


def test_rollup_skips_events_without_a_time(spark, tmp_path):
    path, out, config = str(tmp_path / "in"), str(tmp_path / "out"), Q.shipped("rollup")
    _events(spark, path, [(1, None, 1, "k", 2.0), (None, START, 1, "k", 2.0)])
    assert rollup.run(spark, path, out, config) == {"read": 1, "skipped": 1, "days": 0, "facts": 0}
    assert rollup.tables(spark, out).count() == 0 and rollup.run(spark, path, out, config)["read"] == 0


@supplied
def test_command_line(tmp_path):
    """The job as a process of its own, with a configuration file."""
    config = tmp_path / "c.json"
    config.write_text(json.dumps(Q.shipped("rollup")))
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.rollup", "--source", f"{SF}/events.parquet", "--out", str(tmp_path / "out"), "--config", str(config)], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 1000 new events" in done.stderr
    assert glob.glob(str(tmp_path / "out/facts/bucket=*/*.parquet"))


def test_intake_source_of_one_file(spark, tmp_path):
    """A path may be a file or a folder; a glob takes both."""
    _documents(spark, str(tmp_path / "t"), [(1, TEXT.format(1), "en")])
    (one,) = glob.glob(str(tmp_path / "t/part-*.parquet"))
    os.rename(one, tmp_path / "docs.parquet")
    done = intake.run(spark, str(tmp_path / "docs.parquet*"), str(tmp_path / "out"), str(tmp_path / "at"), Q.shipped("intake"))
    assert done["memories"] == 1 and spark.read.parquet(str(tmp_path / "out/memories")).where(F.col("batch") == 0).count() == 1
