"""State of several variables for each key: sessions, budgeted caches and calls put together from pieces.

Each processor reads what it needs of its key's state once for a batch, takes rows in any order, and writes what has changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that these processors need, for queries that are started within; the former setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


class SessionsOfUser(StatefulProcessor):
    """Open sessions in order, as one value, how many have ended, and a timer for the first that is to end; a session ends when the watermark has passed its last event by the gap."""

    def __init__(self, gap_seconds: int, newest: int) -> None:
        self.gap, self.newest = gap_seconds * 1_000_000, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<long>, last array<long>, n array<long>, total array<double>, ids array<array<long>>, times array<array<long>>, due long")
        self.ended = handle.getValueState("ended", "n long")

    def _due(self, run: tuple) -> int:
        return (run[1] + self.gap) // 1000 + 1

    def _held(self) -> tuple[list, int]:
        """Open sessions and the time of the timer for the first of them."""
        *columns, due = self.open.get() if self.open.exists() else ((), (), (), (), (), (), -1)
        return list(zip(*columns, strict=True)), due

    def _hold(self, runs: list, before: int) -> None:
        due = self._due(runs[0])
        self.open.update((*map(list, zip(*runs, strict=True)), due))
        if due != before:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        runs, due = self._held()
        for d in rows:
            runs = self._merged(runs + self._runs(d))
        if runs:
            self._hold(runs, due)
        yield from ()

    def _runs(self, d: pd.DataFrame) -> list:
        """Runs of rows whose times are not further apart than the gap."""
        us, ids, value = _micros(d["ts"]), d["event_id"].to_numpy(), d["value"].to_numpy("float64")
        order = np.lexsort((ids, us))
        us, ids, value = us[order], ids[order], value[order]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(us) > self.gap) + 1))
        total = np.add.reduceat(np.where(np.isnan(value), 0.0, value), starts).tolist()
        us, ids, starts = us.tolist(), ids.tolist(), starts.tolist()
        ends = [*starts[1:], len(us)]
        tails = [max(i, j - self.newest) for i, j in zip(starts, ends, strict=True)]
        return [(us[i], us[j - 1], j - i, t, ids[k:j], us[k:j]) for i, j, k, t in zip(starts, ends, tails, total, strict=True)]

    def _merged(self, runs: list) -> list:
        """Runs whose gap is short enough are one; of their events the newest stay."""
        out: list = []
        for r in sorted(runs, key=lambda r: r[0]):
            if out and r[0] - out[-1][1] <= self.gap:
                a, b, n, total, ids, times = out[-1]
                newest = sorted(zip([*times, *r[5]], [*ids, *r[4]], strict=True))[-self.newest :]
                out[-1] = (a, max(b, r[1]), n + r[2], total + r[3], [i for _, i in newest], [t for t, _ in newest])
            else:
                out.append(r)
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        runs, due = self._held()
        over = [r for r in runs if self._due(r) <= now]
        if not runs:
            return
        if len(over) < len(runs):
            self._hold(runs[len(over) :], due)
        else:
            self.open.clear()
        if over:
            done = self.ended.get()[0] if self.ended.exists() else 0
            self.ended.update((done + len(over),))
            rows = [(key[0], no, pd.Timestamp(a, unit="us"), pd.Timestamp(b, unit="us"), n, total, list(ids)) for no, (a, b, n, total, ids, _) in enumerate(over, done + 1)]
            yield pd.DataFrame(rows, columns=["user_id", "no", "first", "last", "n", "total", "newest"])

    def close(self) -> None:
        pass


def ended_sessions(events: DataFrame, gap_seconds: int = 1800, late: str = "10 minutes", newest: int = 3) -> DataFrame:
    """Sessions (user_id, no, first, last, n, total, newest) of a stream (event_id, ts, user_id, value) that have ended.

    no counts a user's ended sessions, newest holds the ids of the last few events. Events later than the watermark are dropped.
    """
    keyed = events.select("event_id", "ts", "user_id", "value").withWatermark("ts", late).groupBy("user_id")
    out = "user_id long, no long, first timestamp, last timestamp, n long, total double, newest array<long>"
    return keyed.transformWithStateInPandas(SessionsOfUser(gap_seconds, newest), out, "Append", "EventTime")


class CacheOfClient(StatefulProcessor):
    """The newest results of a client by id: a budget of tokens throws out the oldest, a timer those that are too old."""

    def __init__(self, ttl_seconds: int, budget: int) -> None:
        self.ttl, self.budget = ttl_seconds * 1_000_000, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "id string", "us long, tokens long")
        self.latest = handle.getValueState("latest", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = {k[0]: tuple(v) for k, v in self.held.iterator()}
        held, latest = dict(before), self.latest.get()[0] if self.latest.exists() else -(1 << 62)
        for d in rows:
            for i, us, tokens in zip(d["id"], _micros(d["ts"]).tolist(), d["tokens"].tolist(), strict=True):
                latest = max(latest, us)
                if i not in held or (us, tokens) > held[i]:
                    held[i] = (us, tokens)
        kept, used = {}, 0
        for i, (us, tokens) in sorted(held.items(), key=lambda x: (-x[1][0], x[0])):
            used += tokens
            if us < latest - self.ttl or (kept and used > self.budget):
                break
            kept[i] = (us, tokens)
        for i in before.keys() - kept.keys():
            self.held.removeKey((i,))
        for i, v in kept.items():
            if before.get(i) != v:
                self.held.updateValue((i,), v)
                self.handle.registerTimer((v[0] + self.ttl) // 1000 + 1)
        self.latest.update((latest,))
        yield self._told(key, [(i, v, "kept") for i, v in kept.items()] + [(i, before[i], "thrown out") for i in before.keys() - kept.keys()])

    @staticmethod
    def _told(key, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(key[0], i, pd.Timestamp(us, unit="us"), tokens, what) for i, (us, tokens), what in rows], columns=["client", "id", "ts", "tokens", "what"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        old = [(k[0], tuple(v)) for k, v in self.held.iterator() if (v[0] + self.ttl) // 1000 + 1 <= now]
        for i, _ in old:
            self.held.removeKey((i,))
        if old:
            yield self._told(key, [(i, v, "expired") for i, v in old])

    def close(self) -> None:
        pass


def budgeted_cache(results: DataFrame, ttl_seconds: int = 300, budget: int = 2000, late: str = "1 minute") -> DataFrame:
    """What a client's cache holds after each batch of results (client, id, ts, tokens), and what left it: client, id, ts, tokens, what.

    Of an id the newest result counts. Newest first, results stay until one would exceed the budget; the newest always stays.
    """
    keyed = results.select("client", "id", "ts", "tokens").withWatermark("ts", late).groupBy("client")
    return keyed.transformWithStateInPandas(CacheOfClient(ttl_seconds, budget), "client long, id string, ts timestamp, tokens long, what string", "Append", "EventTime")


class PiecesOfCall(StatefulProcessor):
    """The pieces of a call that have come, and the number of the last; whole calls leave, and a mark stays until the time is over, so that repeats are known."""

    def __init__(self, timeout_seconds: int) -> None:
        self.timeout = 1000 * timeout_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, piece string")
        self.call = handle.getValueState("call", "last long, until long, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.call.exists()
        last, until, told = self.call.get() if known else (-1, 0, False)
        have = {} if told or not known else dict(self.pieces.get())
        new, first = {}, None
        for d in rows:
            first = min(int(_micros(d["ts"]).min()) // 1000, first if first is not None else 1 << 62)
            for seq, piece, is_last in zip(d["seq"].tolist(), d["piece"], d["last"], strict=True):
                if seq not in have:
                    have[seq] = new[seq] = piece
                last = seq if is_last else last
        if told:
            return  # late or repeated
        if not known:
            until = first + self.timeout
            self.handle.registerTimer(until)
        whole = last >= 0 and len(have) == last + 1
        if whole:
            self.pieces.clear()
            yield self._told(key, have, True)
        elif new:
            self.pieces.appendList(list(new.items()))
        self.call.update((last, until, whole))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.call.exists() and not self.call.get()[2]:
            yield self._told(key, dict(self.pieces.get()), False)
        self.pieces.clear()
        self.call.clear()

    @staticmethod
    def _told(key, have: dict[int, str], whole: bool) -> pd.DataFrame:
        """The text up to the first piece that is missing."""
        text, seq = [], 0
        while seq in have:
            text.append(have[seq] or "")
            seq += 1
        return pd.DataFrame([(key[0], "".join(text), len(have), whole)], columns=["call", "text", "pieces", "whole"])

    def close(self) -> None:
        pass


def assembled(chunks: DataFrame, timeout_seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """Calls (call, text, pieces, whole) from a stream of their pieces (call string, ts, seq long from 0, piece, last boolean), in any order.

    A call leaves when all pieces up to the one marked as last are there, or, not whole, when the watermark has passed its first
    piece's time by ``timeout_seconds``; until then repeats of a whole one are ignored. Pieces later than the watermark are dropped.
    """
    keyed = chunks.select("call", "ts", "seq", "piece", "last").withWatermark("ts", late).groupBy("call")
    return keyed.transformWithStateInPandas(PiecesOfCall(timeout_seconds), "call string, text string, pieces long, whole boolean", "Append", "EventTime")
