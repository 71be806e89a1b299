"""Streams with state of several variables, on input that comes in parts and out of order."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keepstone.streaming import state as S

START = datetime(2024, 3, 1)


def _run(spark, tmp_path, parts, schema, make, each=1):
    """What make(stream) gives for parts that arrive as files one after the other: rows with the number of their batch."""
    path, out = str(tmp_path / "in"), []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        with S.state_store(spark):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).parquet(path)
            q = make(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
            q.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/{i}"))).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).withColumn("batch", F.regexp_extract(F.input_file_name(), r"out/(\d+)/", 1).cast("int"))
    out = found.collect()
    return out


def test_sessions_end_by_timers_across_batches(spark, tmp_path):
    """A late event within the watermark joins two open sessions; a user's last session stays open."""
    at = lambda m: START + timedelta(minutes=m)
    parts = [
        [(1, at(0), 7, 1.0), (2, at(20), 7, 2.0), (3, at(100), 7, 4.0), (4, at(5), 8, 1.5)],
        [(5, at(70), 7, 8.0), (6, at(101), 8, 0.5)],
        [(7, at(400), 9, 1.0)],
    ]
    got = _run(spark, tmp_path, parts, "event_id long, ts timestamp, user_id long, value double", lambda s: S.ended_sessions(s, 1800, "60 minutes", 2))
    told = sorted((x["user_id"], x["no"], x["n"], x["total"], x["newest"], x["first"], x["last"]) for x in got)
    assert told == [(7, 1, 2, 3.0, [1, 2], at(0), at(20)), (7, 2, 2, 12.0, [5, 3], at(70), at(100)), (8, 1, 1, 1.5, [4], at(5), at(5)), (8, 2, 1, 0.5, [6], at(101), at(101))]


def test_sessions_of_shuffled_events_equal_a_loop(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, START + timedelta(minutes=r.randint(0, 4000)), i % 3, float(i % 11)) for i in range(500)]
    rows.sort(key=lambda x: (x[1] - START) // timedelta(hours=10))  # out of order by hours
    cut = [rows[k : k + 125] for k in range(0, 500, 125)]
    got = _run(spark, tmp_path, cut, "event_id long, ts timestamp, user_id long, value double", lambda s: S.ended_sessions(s, 600, "2 days"))
    want = []
    limit = max(t for _, t, _, _ in rows) - timedelta(days=2)
    for u in range(3):
        own = sorted((t, i, v) for i, t, w, v in rows if w == u)
        runs = [[own[0]]]
        for x in own[1:]:
            runs.append([x]) if x[0] - runs[-1][-1][0] > timedelta(seconds=600) else runs[-1].append(x)
        want += [(u, k, len(run), sum(v for _, _, v in run), [i for _, i, _ in run[-3:]]) for k, run in enumerate(runs, 1) if run[-1][0] + timedelta(seconds=600) < limit]
    assert sorted((x["user_id"], x["no"], x["n"], x["total"], x["newest"]) for x in got) == want and len(want) > 20


def test_cache_budget_replacement_and_age(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [(1, "a", at(0), 50), (1, "b", at(10), 30), (1, "c", at(20), 30), (2, "x", at(5), 500)],  # a goes: 30 + 30 + 50 > 100
        [(1, "b", at(30), 60), (1, "b", at(25), 1)],  # the newest b counts; c still fits
        [(3, "z", at(1000), 1)],  # time passes, the rest expires
    ]
    got = _run(spark, tmp_path, parts, "client long, id string, ts timestamp, tokens long", lambda s: S.budgeted_cache(s, 300, 100, "1 second"))
    by = {}
    for x in got:
        by.setdefault((x["client"], x["what"]), []).append((x["batch"], x["id"], x["tokens"]))
    kept = sorted(by[1, "kept"])
    assert [x[1:] for x in kept] == [("b", 30), ("c", 30), ("b", 60), ("c", 30)]
    assert [x[1:] for x in by[2, "kept"]] == [("x", 500)]  # the newest stays, whatever it costs
    assert sorted(x[1] for x in by[1, "expired"]) == ["b", "c"] and [x[1] for x in by[2, "expired"]] == ["x"]


PIECES = "call string, ts timestamp, seq long, piece string, last boolean"


def test_calls_come_back_whole_or_are_closed(spark, tmp_path):
    """Pieces out of order, repeated, and in several batches; repeats after the end are ignored; what misses a piece is told once its time is over."""
    at = lambda s: START + timedelta(seconds=s)
    parts = [
        [("p", at(1), 2, "three", True), ("p", at(0), 0, "one ", False), ("q", at(0), 0, "alone", True), ("r", at(3), 0, "a", False), ("r", at(4), 2, "c", True)],
        [("p", at(2), 0, "one ", False), ("p", at(3), 1, "two ", False), ("q", at(5), 0, "alone", True), ("s", at(6), 0, "", True)],
        [("p", at(7), 2, "three", True), ("t", at(500), 0, "later", True)],
    ]
    got = _run(spark, tmp_path, parts, PIECES, lambda s: S.assembled(s, 60, "5 seconds"))
    assert sorted((x["call"], x["text"], x["pieces"], x["whole"]) for x in got) == [("p", "one two three", 3, True), ("q", "alone", 1, True), ("r", "a", 2, False), ("s", "", 1, True), ("t", "later", 1, True)]


def test_state_store_setting_comes_back(spark):
    before = spark.conf.get(S.PROVIDER, None)
    with pytest.raises(RuntimeError), S.state_store(spark):
        raise RuntimeError
    assert spark.conf.get(S.PROVIDER, None) == before


class _Counted:
    """A handle that keeps values in memory and counts calls."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def _state(self, name):
        outer = self

        class State:
            def exists(self):
                outer.calls += 1
                return name in outer.values

            def get(self):
                outer.calls += 1
                return outer.values.get(name, [])

            def update(self, value):
                outer.calls += 1
                outer.values[name] = value

            def updateValue(self, key, value):  # noqa: N802
                outer.calls += 1
                outer.values.setdefault(name, {})[key] = value

            def removeKey(self, key):  # noqa: N802
                outer.calls += 1
                del outer.values[name][key]

            def iterator(self):
                outer.calls += 1
                return iter(list(outer.values.get(name, {}).items()))

            def appendList(self, rows):  # noqa: N802
                outer.calls += 1
                outer.values.setdefault(name, []).extend(rows)

            def clear(self):
                outer.calls += 1
                outer.values.pop(name, None)

        return State()

    def getValueState(self, name, schema):  # noqa: N802
        return self._state(name)

    getMapState = getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


class _At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_calls_to_the_state_do_not_grow_with_sessions():
    """500 sessions of a user take a few calls to the state and one timer, and all that the watermark has passed end at once."""
    ts = pd.Series([START + timedelta(hours=h) for h in range(500)]).astype("datetime64[us]")
    rows = pd.DataFrame({"event_id": range(500), "ts": ts, "user_id": 7, "value": 1.0})
    h, p = _Counted(), S.SessionsOfUser(1800, 3)
    p.init(h)
    list(p.handleInputRows((7,), iter([rows[::2], rows[1::2]]), _At(0)))
    assert len(h.timers) == 1
    watermark = int(pd.Timestamp(START + timedelta(hours=400)).value // 1_000_000)
    told = list(p.handleExpiredTimer((7,), _At(watermark), _At(min(h.timers))))
    assert [len(d) for d in told] == [400] and told[0]["no"].tolist() == list(range(1, 401))
    assert len(h.timers) == 2 and max(h.timers) > watermark and h.calls <= 12


def test_calls_to_the_state_do_not_grow_with_pieces():
    ts = pd.Series([START] * 300).astype("datetime64[us]")
    rows = pd.DataFrame({"call": "a", "ts": ts, "seq": range(300), "piece": "x", "last": False})
    h, p = _Counted(), S.PiecesOfCall(60)
    p.init(h)
    list(p.handleInputRows(("a",), iter([rows]), _At(0)))
    assert h.calls <= 6 and len(h.values["pieces"]) == 300
