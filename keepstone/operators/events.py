"""Subject, verb and object of sentences that tell an event, with dates and aliases, and search over them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.operators.retrieval import bm25

#: Events of a text are few beside it, so texts that can't have any are left out before Python sees them.
_MAY_TELL = r"(?i)\b(?:I|we|he|she|they|my|the\s+team|allergic)\b"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_FORMS = [(kind, confidence, least, verb, re.compile(p, re.IGNORECASE)) for kind, confidence, least, verb, p in K.EVENT_FORMS]
_LOOSE_END = re.compile(K.EVENT_LOOSE_ENDS)
_DATES = [(kind, re.compile(p)) for kind, p in K.EVENT_DATES]
_SCHEMA = "id {id}, seq int, kind string, subject string, verb string, object string, event_date string, aliases array<string>, confidence double"


def _ago(words: str, now: date) -> str:
    """The day, month or year that today, yesterday and last week, month or year name."""
    words = " ".join(words.lower().split())
    if words == "last year":
        return str(now.year - 1)
    if words == "last month":
        return (now.replace(day=1) - timedelta(days=1)).strftime("%Y-%m")
    return (now - timedelta(days={"today": 0, "yesterday": 1, "last week": 7}[words])).isoformat()


def event_date(sentence: str, now: date) -> str | None:
    """The first date that a sentence names, as year, year and month, or all three; the first form that occurs decides.

    After "in" a year may be followed by numbers, of which the last one counts.
    """
    for kind, pattern in _DATES:
        m = pattern.search(sentence)
        if not m:
            continue
        if kind == "relative":
            return _ago(m.group(), now)
        if kind == "iso":
            return m.group(1)
        parts = [g for g in m.groups() if g]
        if kind == "named":
            year = parts.pop()
            month = next(K.MONTHS[g.lower()] for g in parts if g.lower() in K.MONTHS)
            day = next(int(g) for g in parts if g.isdigit())
            return f"{year}-{month:02d}" + (f"-{day:02d}" if day else "")
        rest = [int(g) for g in parts[1:] if int(g)]
        if int(parts[0]) > 31:
            return f"{int(parts[0])}" + (f"-{rest[-1]:02d}" if rest else "")
    return None


def _object(text: str) -> str:
    return _LOOSE_END.sub("", text.strip().rstrip(".,;:!?")).strip()


def _subject(text: str | None) -> str:
    low = (text or "my").strip().lower()
    return "user" if low.split()[0] == "my" else low[4:] if low.startswith("the ") else K.EVENT_SUBJECTS.get(low, low)


def aliases(subject: str, verb: str, obj: str) -> list[str]:
    """Up to four other ways to tell an event: with two other verbs, from the object on, and without the subject."""
    plain = verb.lower().replace("_", " ").strip()
    others = K.VERB_SYNONYMS.get(plain) or K.VERB_SYNONYMS.get(re.sub(r" (?:to|at|in|for|with)$", "", plain), [])
    said = verb.replace("_", " ")
    turned = f"{obj} was {said}" if subject in ("user", "team") else f"{obj} {said} by {subject}"
    told = [*[f"{subject} {v} {obj}".strip() for v in others[:2]], turned, f"{said} {obj}"]
    kept: dict[str, str] = {}
    for a in told:
        kept.setdefault(a.lower().strip(), a)
    return list(kept.values())[:4]


def events_of(text: str, now: date) -> list[tuple]:
    """kind, subject, verb, object, event_date, aliases and confidence of each event that a text tells.

    Forms are tried in their order within each sentence. A match is passed over if it begins or ends
    inside an earlier one; places count from the beginning of a sentence, over all sentences of the text.
    """
    out: list[tuple] = []
    taken = bytearray()
    for sentence in _SENTENCE_END.split(text):
        sentence = sentence.strip()
        if len(sentence) < 5:
            continue
        taken.extend(bytes(max(0, len(sentence) + 1 - len(taken))))
        when = event_date(sentence, now)
        for kind, confidence, least, verb, pattern in _FORMS:
            for m in pattern.finditer(sentence):
                if taken[m.start()] or taken[m.end() - 1]:
                    continue
                found = m.groupdict()
                obj = _object(found["o"])
                if len(obj) < least:
                    continue
                v = (found.get("v") or "").lower()
                if kind == "my_is":
                    v = v.removesuffix("'s")
                    v = f"has_{v}_named" if v in K.EVENT_PETS else v
                subject, v = _subject(found.get("s")), verb.format(v=v, p=found.get("p"))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                out.append((kind, subject, v, obj, when, aliases(subject, v, obj), confidence))
    return out


def extract_events(texts: DataFrame, now: date) -> DataFrame:
    """id, seq and what events_of() tells of each text of (id, text); relative dates are taken from ``now``. Null texts tell none."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = events_of(t, now)
                ids += [i] * len(found)
                rows += [(n, *e) for n, e in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.float64()]
            names = ["seq", "kind", "subject", "verb", "object", "event_date", "aliases", "confidence"]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], ["id", *names])

    return texts.select("id", "text").where(F.col("text").rlike(_MAY_TELL)).mapInArrow(run, _SCHEMA.format(id=texts.schema["id"].dataType.simpleString()))


def on_date(events: DataFrame, when: str | None) -> DataFrame:
    """Events of a year, of a month or of a day, by as much as ``when`` names; all without it."""
    if not when:
        return events
    return events.where(F.col("event_date") == when if when.count("-") == 2 else F.startswith("event_date", F.lit(when)))


def search_events(events: DataFrame, query: str, now: date, limit: int = 20) -> DataFrame:
    """id and score of the memories with the best events for a query, of the date that it names; one, the best, for each memory."""
    terms = T.full_text_terms(query)
    text = F.concat_ws(" ", "subject", "verb", "object", F.array_join("aliases", " "))
    numbered = on_date(events, event_date(query, now)).select(F.struct("id", "seq").alias("id"), text.alias("text"))
    return best_by_memory(bm25(numbered, terms), limit)


def best_by_memory(scored: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("m").orderBy(F.desc("score"), "p")
    best = scored.select(F.col("id.id").alias("m"), F.col("id.seq").alias("p"), "score").withColumn("r", F.row_number().over(w)).where("r = 1")
    return best.orderBy(F.desc("score"), "m").limit(limit).select(F.col("m").alias("id"), "score")

