"""Questions of several parts, cut into the questions that they join."""

from __future__ import annotations

import re

from keepstone.functions import constants as K

#: Questions at most, the whole one included.
MOST = 3


def _words(text: str) -> int:
    return len(text.split())


def _names(query: str) -> list[str]:
    return [n for n in re.findall(K.CAPITALISED, query) if n.lower() not in K.NO_NAMES]


def _clauses(query: str) -> list[str]:
    """What stands between the words and, if there are two such parts of three words or more."""
    parts = [p.strip() for p in re.split(K.JOINED_BY_AND, query)]
    long = [p for p in parts if _words(p) >= 3]
    return long if len(long) >= 2 else []


def _joined(query: str) -> list[str]:
    """Parts of two words or more among the first two around compound conjunctions."""
    if not re.search(K.JOINED_BY, query):
        return []
    parts = [p.strip() for i, p in enumerate(re.split(K.JOINED_BY, query)) if i % 2 == 0 and p.strip()]
    return [p for p in parts[:2] if _words(p) >= 2]


def _around_time(query: str) -> list[str]:
    """What stands before and after a word that orders things in time; else the topic and the period that is named."""
    mark, period = re.search(K.TIME_MARK, query), re.search(K.IN_A_PERIOD, query)
    if mark:
        sides = [p.strip().rstrip("?").strip() for p in query.split(mark.group(), 1)]
        if found := [p for p in sides if _words(p) >= 2]:
            return found
    if period:
        topic = " ".join(re.sub(K.IN_A_PERIOD, "", query).split()).strip("? ")
        if _words(topic) >= 2:
            return [topic, f"events {period.group()}"]
    return []


def _topics(query: str) -> list[str]:
    m = re.search(K.ASKED_ABOUT, query)
    return [m[1], m[2]] if m and m[1].strip() and m[2].strip().rstrip("?").strip() else []


def _compared(query: str) -> list[str]:
    if not re.search(K.COMPARED, query):
        return []
    m = re.search(K.BETWEEN_TWO, query) or re.search(K.AGAINST, query)
    return [m[1], m[2]] if m else []


def _named(query: str) -> list[str]:
    return _names(query)[:2] if len(_names(query)) >= 2 else []


def has_parts(query: str) -> bool:
    """Whether a question compares, orders things in time, joins clauses, or names or asks about several things."""
    rest = re.sub(K.TIME_MARK, "", query)
    in_time = re.search(K.TIME_MARK, query) and sum(len(w) > 2 for w in rest.split()) >= 3
    return bool(re.search(K.COMPARED, query) or in_time or re.search(K.JOINED_BY, query) or _clauses(query) or len(_names(query)) >= 2 or re.search(K.ASKED_ABOUT, query))


def sub_queries(query: str) -> list[str]:
    """The question itself and up to two that it is made of, by the first way to cut it that gives any."""
    out = {query.lower().strip(): query}
    if has_parts(query):
        for cut in (_joined, lambda q: _clauses(q)[:2], _around_time, _topics, _compared, _named):
            if parts := cut(query):
                for p in parts:
                    p = p.strip().rstrip("?").strip()
                    if p:
                        out.setdefault(p.lower(), p)
                break
    return list(out.values())[:MOST]
