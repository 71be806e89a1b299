"""Events of conversations by date, and questions about them."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T

#: Events that a question is answered from, at most.
MOST_EVENTS = 50
_DAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def named_day(sentence: str, session: datetime) -> tuple[datetime | None, str]:
    """The day that a sentence names, seen from its session's, and the words that name it; none without one."""
    low = sentence.lower()
    if m := re.search(K.SENTENCE_MONTH_DAY, sentence):
        try:
            return datetime(session.year, K.MONTHS[m[1].lower()], int(m[2])), m[0]
        except ValueError:
            pass
    if m := re.search(K.SENTENCE_YEAR, sentence):
        return datetime(int(m[1]), 6, 15), m[0]
    back = lambda n: session - timedelta(days=n)
    if "yesterday" in low:
        return back(1), "yesterday"
    if m := re.search(K.SENTENCE_AGO, sentence):
        return back(int(m[1]) * {"day": 1, "week": 7, "month": 30}[m[2].lower().rstrip("s")]), m[0]
    saturday = (session.weekday() - 5) % 7 or 7
    for words, n in (("last week", 7), ("last month", 30), ("this past weekend", saturday), ("last weekend", saturday)):
        if words in low:
            return back(n), words
    if m := re.search(f"last\\s+({'|'.join(_DAYS)})", low):
        return back((session.weekday() - _DAYS.index(m[1])) % 7 or 7), m[0]
    if m := re.search(f"this\\s+({'|'.join(_DAYS)})", low):
        return session + timedelta(days=(_DAYS.index(m[1]) - session.weekday()) % 7), m[0]
    for words, day, name in K.SENTENCE_HOLIDAYS:
        if words in low:
            month, at = day or (11, 22 + (3 - datetime(session.year, 11, 1).weekday()) % 7)  # the fourth Thursday of November
            return datetime(session.year, month, at), name
    return None, ""


def _named_days(sentence: Column | str, session: Column) -> Column:
    @F.pandas_udf("struct<day: timestamp_ntz, words: string>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sentences, sessions in parts:
            found = [named_day(s, t.to_pydatetime()) for s, t in zip(sentences, sessions, strict=True)]
            yield pd.DataFrame({"day": pd.Series([d for d, _ in found], dtype="datetime64[us]"), "words": [w for _, w in found]})

    return run(sentence, session)


def build(turns: DataFrame, fillers: bool = True) -> DataFrame:
    """conv_id, turn, role, pos, sentence, session_date, event_date and expression for the meaningful sentences of (conv_id, turn, role, text, session_date)."""
    s = turns.select("conv_id", "turn", "role", "session_date", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    good = T.meaningful(F.col("sentence")) if fillers else (F.length("sentence") >= 15) & (F.size(F.regexp_extract_all("sentence", F.lit(r"\S+"), F.lit(0))) >= 4)
    d = s.where(good).withColumn("named", _named_days("sentence", F.col("session_date").cast("timestamp_ntz")))
    return d.withColumn("event_date", F.coalesce("named.day", "session_date")).withColumn("expression", F.col("named.words")).drop("named")


def relevant(events: DataFrame, keywords: list[str], limit: int | None = MOST_EVENTS) -> DataFrame:
    """Events with enough of the keywords (one of up to two, else two), most hits first, then by date."""
    hits = F.size(F.array_intersect(T.tokenize(F.col("sentence")), F.array(*[F.lit(k) for k in keywords])))
    d = events.withColumn("hits", hits).where(F.col("hits") >= (1 if len(keywords) <= 2 else 2))
    return d.orderBy(F.desc("hits"), "event_date", "conv_id", "turn", "pos").limit(limit) if limit else d


def within(events: DataFrame, start: Column, end: Column, margin_days: int = 14) -> DataFrame:
    """Events whose session or own date lies in the interval, widened on both sides."""
    m = F.make_dt_interval(days=F.lit(margin_days))
    lo, hi = start - m, end + m
    return events.where(F.col("session_date").between(lo, hi) | F.col("event_date").between(lo, hi))


def keywords(text: str) -> list[str]:
    words = [w.strip("?,!.;:\"'()[]") for w in text.lower().split()]
    return [w for w in words if len(w) > 2 and w not in K.CALENDAR_STOP_WORDS]


def time_window(question: str, asked: datetime) -> tuple[datetime, datetime] | None:
    """The time that a question is about, seen from the day it is asked; None if it names none."""
    q = question.lower()
    months = "|".join(K.MONTHS)

    def month(year: int, m: int) -> tuple[datetime, datetime]:
        return datetime(year, m, 1), datetime(year, m, calendar.monthrange(year, m)[1], 23, 59, 59)

    if m := re.search(rf"\bin\s+({months})\s+(\d{{4}})\b", q) or re.search(rf"\b({months})\s+(\d{{4}})\b", q):
        return month(int(m[2]), K.MONTHS[m[1]])
    if m := re.search(rf"\bin\s+({months})\b(?!\s+\d{{4}})", q):
        return month(asked.year, K.MONTHS[m[1]])
    ago = lambda days: asked - timedelta(days=days)
    if m := re.search(r"(\d+)\s+(day|week|month)s?\s+ago", q):
        n = int(m[1])
        first, last = {"week": (7 * n + 7, 7 * n - 7), "day": (n + 7, n - 1), "month": (30 * n + 30, 30 * n - 30)}[m[2]]
        return ago(first), ago(max(last, 0))
    if re.search(r"\blast\s+week\b", q):
        return ago(14), asked
    if re.search(r"\blast\s+month\b", q):
        end = asked.replace(day=1) - timedelta(days=1)
        return end.replace(day=1), datetime(end.year, end.month, end.day, 23, 59, 59)
    if re.search(r"\b(?:past|recent)\s+(?:month|few weeks|weeks)\b|\brecently\b", q):
        return ago(45), asked
    m = re.search(r"\bin\s+(\d{4})\b", q)
    return (datetime(int(m[1]), 1, 1), datetime(int(m[1]), 12, 31, 23, 59, 59)) if m and 1900 <= int(m[1]) <= 2100 else None


def _day(e) -> str:
    return e["event_date"].strftime("%Y/%m/%d")


def _told(e, n: int, speaker: bool = False, session: bool = True, ago: str = "") -> str:
    who = f" [{e['role']}]" if speaker else ""
    where = f" (Session {e['conv_id'] + 1})" if session else ""
    said = f' [expr: "{e["expression"]}"]' if e["expression"] else ""
    return f"{_day(e)} — {e['sentence'][:n]}{who}{where}{ago}{said}"


def _lines(kind: str, m: re.Match, events: list, asked: datetime) -> list[str]:
    """The answer of one kind from events in the order of time."""
    first, last = events[0], events[-1]
    days = (last["event_date"] - first["event_date"]).days
    weeks, months = round(days / 7, 1), round(days / 30.44, 1)
    lead = "CALENDAR ANSWER: "
    numbered = lambda n, session: [f"  {i}. {_told(e, 80, session=session)}" for i, e in enumerate(events[:n], 1)]
    if kind == "duration":
        length = {"weeks": f" ({weeks} weeks)", "months": f" (~{months} months)"}.get(m[1], "")
        return [f"{lead}{abs(days)} days{length} between '{first['sentence'][:60]}' ({_day(first)}) and '{last['sentence'][:60]}' ({_day(last)})"]
    if kind == "ago":
        since = (asked - last["event_date"]).days
        return [f"{lead}{since} days ago (~{round(since / 7, 1)} weeks) — '{last['sentence'][:60]}' was on {_day(last)}, question date is {asked.strftime('%Y/%m/%d')}"]
    if kind == "order":
        return [f"{lead}Chronological order:", *numbered(5, True), f"  FIRST: {first['sentence'][:80]}", f"  LAST: {last['sentence'][:80]}"]
    if kind == "when":
        e = first if m[1] == "first" else last
        return [f"{lead}{m[1].title()} occurrence on {_day(e)} — '{e['sentence'][:80]}' (Session {e['conv_id'] + 1})"]
    if kind == "recent":
        return [f"{lead}Most recent occurrence on {_day(last)} — '{last['sentence'][:80]}' (Session {last['conv_id'] + 1})"]
    if kind == "list":
        return [f"{lead}Chronological order:", *numbered(6, True)]
    if kind == "until":
        return [f"{lead}{days} days (~{weeks} weeks, ~{months} months) between first mention ({_day(first)}) and the referenced event ({_day(last)})"]
    if kind == "spent":
        return [f"{lead}{days} days (from {_day(first)} to {_day(last)})"]
    if kind == "finished":
        return [f"{lead}{abs(days)} days (~{round(abs(days) / 7, 1)} weeks) from first mention ({_day(first)}: {first['sentence'][:60]}) to last mention ({_day(last)}: {last['sentence'][:60]})"]
    if kind == "weekday":
        return [f"{lead}Events near that date:", *[f"  {_told(e, 100, True)}" for e in events[:8]]]
    if kind == "count":
        return [f"{lead}{len(events)} relevant events found:", *numbered(10, False)]
    if kind == "who":
        return [f"{lead}Chronological order:", *numbered(5, False)]
    before = lambda e: f" [{(asked - e['event_date']).days} days before question date]" if (asked - e["event_date"]).days > 0 else ""
    return ["CALENDAR TIMELINE (chronological):", f"  Question date: {asked.strftime('%Y/%m/%d')}", *[f"  {_told(e, 100, True, ago=before(e))}" for e in events[:15]]]


def changed(events: list) -> tuple | None:
    """The first and the last event that tell a value (by the user), if they differ and come from two sessions; else the first events of the
    first and of the last session, if they differ."""
    valued = []
    for e in events:
        found = [m for p in K.CALENDAR_VALUES if e["role"] == "user" and (m := re.search(p, e["sentence"]))]
        if found:
            valued.append((e["event_date"], found[0][1].strip()[:60].lower(), e))
    valued.sort(key=lambda x: x[0])
    if len(valued) >= 2 and valued[0][1] != valued[-1][1] and valued[0][2]["conv_id"] != valued[-1][2]["conv_id"]:
        return valued[0][2], valued[-1][2]
    firsts: dict = {}
    for e in events:
        firsts.setdefault(e["conv_id"], e)
    sessions = sorted(firsts)
    newest = firsts[sessions[-1]] if sessions else None
    return next(((firsts[s], newest) for s in sessions[:-1] if firsts[s]["sentence"].lower() != newest["sentence"].lower()), None)


def answer(events: DataFrame, question: str, asked: datetime | None = None) -> str:
    """The answer to a question about time from the events of a calendar; empty without events that match.

    At most MOST_EVENTS events, those that match the question best within the time it names, reach the driver.
    """
    if asked is None:
        asked = events.agg(F.max("session_date").alias("d")).first()["d"]
        if asked is None:
            return ""
    words = keywords(question)
    window = time_window(question, asked)
    stamp = lambda d: F.lit(d.isoformat(sep=" ")).cast("timestamp_ntz")
    inside = within(events, stamp(window[0]), stamp(window[1])) if window else events
    columns = ["conv_id", "role", "sentence", "event_date", "expression"]
    found = _matching(inside, words).select(*columns).collect()  # MOST_EVENTS rows
    if not found:
        return ""
    names = {w for x in question.split() if (w := x.strip("?,!.;:\"'()[]").lower()) and len(w) > 1 and x.strip("?,!.;:\"'()[]")[0].isupper() and w not in K.CALENDAR_NO_NAMES}
    named = [e for e in found if any(n in e["sentence"].lower() for n in names)]
    ordered = sorted(named or found, key=lambda e: e["event_date"])
    out: list[str] = []
    for kind, pattern, least, alone in K.CALENDAR_QUESTIONS:
        m = re.search(pattern, question.lower())
        if m and len(ordered) >= least and not (alone and out):
            out += _lines(kind, m, ordered, asked)
    every = _matching(events, words).select(*columns).collect() if window else found
    if len(every) >= 2 and (change := changed(every)):
        old, new = change
        out += ["\nKNOWLEDGE UPDATE DETECTED (use MOST RECENT value):", f"  SUPERSEDED ({_day(old)}): {old['sentence'][:100]}", f"  CURRENT ({_day(new)}): {new['sentence'][:100]}", "  ALWAYS USE THE CURRENT/MOST RECENT VALUE ABOVE."]
    return "\n".join(out)


def _matching(events: DataFrame, words: list[str]) -> DataFrame:
    """Events by how often words of theirs are among the keywords; each keyword counts as often as it is asked."""
    marks = r"[?,!.;:\"'()\[\]]"
    own = F.transform(F.split(F.lower("sentence"), r"\s+"), lambda w: F.regexp_replace(w, f"^{marks}+|{marks}+$", ""))
    count = lambda k: F.size(F.filter("own", lambda w: w == k))
    counts = [count(k) for k in words]
    hits = counts[0] if counts else F.lit(0)
    for c in counts[1:]:
        hits = hits + c
    d = events.withColumn("own", own).withColumn("hits", hits).where(F.col("hits") >= (1 if len(words) <= 2 else 2))
    return d.orderBy(F.desc("hits"), "conv_id", "turn", "pos").limit(MOST_EVENTS)
