"""Dates in queries (parsed on the driver, with a given now) and in texts (as Columns)."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import scoring as S

_MONTH = "|".join(K.MONTHS)


def _end_of_month(year: int, month: int) -> datetime:
    return datetime(year, month, calendar.monthrange(year, month)[1], 23, 59, 59)


def _whole_month(year: int, month: int) -> tuple[datetime, datetime]:
    year, month = year + (month - 1) // 12, (month - 1) % 12 + 1
    return datetime(year, month, 1), _end_of_month(year, month)


def _whole_year(year: int) -> tuple[datetime, datetime]:
    return datetime(year, 1, 1), datetime(year, 12, 31, 23, 59, 59)


def _week(now: datetime, back: int) -> tuple[datetime, datetime]:
    monday = (now - timedelta(days=now.weekday() + 7 * back)).replace(hour=0, minute=0, second=0, microsecond=0)
    return monday, monday + timedelta(days=6, hours=23, minutes=59, seconds=59)


def _moment(m: re.Match, now: datetime) -> datetime | None:
    try:
        return datetime(*[int(g or 0) for g in m.groups()])
    except ValueError:
        return None


def _ago(m: re.Match, now: datetime) -> datetime | tuple[datetime, datetime]:
    """A day so many days back; the whole week, month or year for longer units."""
    n = int(m[1])
    whole = {"week": lambda: _week(now, n), "month": lambda: _whole_month(now.year, now.month - n), "year": lambda: _whole_year(now.year - n)}
    return whole[m[2]]() if m[2] in whole else now - timedelta(days=n)


def _holiday(m: re.Match, now: datetime) -> datetime | tuple[datetime, datetime]:
    """The last one; what lies before or after it in its year, if that is asked."""
    month, day = K.HOLIDAYS[m[2]]
    at = datetime(now.year, month, day)
    at = at if at <= now else datetime(now.year - 1, month, day)
    return {"before": (datetime(at.year, 1, 1), at), "after": (at, _whole_year(at.year)[1])}.get(m[1], at)


def _season(m: re.Match, now: datetime) -> tuple[datetime, datetime]:
    first, last = K.SEASONS[m[2]]
    year = now.year - ("last" in m[1])
    return datetime(year, first, 1), _end_of_month(year + (last < first), last)


def _noon(now: datetime, back: int) -> datetime:
    return now.replace(hour=12, minute=0, second=0) - timedelta(days=back)


# What each family of expressions means, seen from now: a date, a range, or nothing.
_MEANING = {
    "moment": _moment,
    "ago": _ago,
    "day": lambda m, now: _noon(now, int(m[0] == "yesterday")),
    "last": lambda m, now: {"week": lambda: _week(now, 1), "month": lambda: _whole_month(now.year, now.month - 1), "year": lambda: _whole_year(now.year - 1)}[m[1]](),
    "recently": lambda m, now: (now - timedelta(days=30), now),
    "weekday": lambda m, now: _noon(now, (now.weekday() - K.WEEKDAYS[m[1]] - 1) % 7 + 1),
    "month of a year": lambda m, now: _whole_month(int(m[2]), K.MONTHS[m[1]]),
    "month": lambda m, now: _whole_month(now.year - (K.MONTHS[m[1]] > now.month), K.MONTHS[m[1]]),
    "season": _season,
    "year": lambda m, now: _whole_year(int(m[1])) if 1900 <= int(m[1]) <= 2100 else None,
    "holiday": _holiday,
}


def parse_query(query: str, now: datetime) -> dict[str, list]:
    """dates and ranges that a query names, each once, family by family."""
    dates: list[datetime] = []
    ranges: list[tuple[datetime, datetime]] = []
    for family, pattern in K.QUERY_DATES:
        for m in re.finditer(pattern, query.lower()):
            found = _MEANING[family](m, now)
            into = ranges if isinstance(found, tuple) else dates
            if found is not None and found not in into:
                into.append(found)
    return {"dates": dates, "ranges": ranges}


def parse_relative(text: str, now: datetime) -> datetime:
    """now, yesterday, last week or month, N hours, days, weeks or months (of 30 days) ago, or an ISO date."""
    t = text.strip().lower()
    fixed = {"now": 0, "yesterday": 1, "last week": 7, "last month": 30}
    if t in fixed:
        return now - timedelta(days=fixed[t])
    if m := re.match(r"(\d+)\s+(day|hour|week|month)s?\s+ago", t):
        return now - int(m[1]) * {"day": timedelta(days=1), "hour": timedelta(hours=1), "week": timedelta(weeks=1), "month": timedelta(days=30)}[m[2]]
    return datetime.fromisoformat(text.strip())


def creation_range_score(created: Column, lo: Column, hi: Column) -> Column:
    """0.9 for lying in a range, up to 1 in its middle."""
    whole = F.greatest(S.days(hi, lo), F.lit(1.0))
    off = F.abs(S.days(created, lo) - S.days(hi, lo) / 2)
    return 0.9 + 0.1 * (1 - F.least(off / whole, F.lit(1.0)))


def content_dates(text: Column) -> Column:
    """Dates that a text names: array of (date, kind)."""

    def made(pattern: str, build, kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda s: F.struct(build(s).alias("date"), F.lit(kind).alias("kind")))

    iso = made(r"\d{4}-\d{2}-\d{2}", lambda s: F.try_to_date(s, "yyyy-MM-dd"), "exact")
    slash = made(r"\d{4}/\d{1,2}/\d{1,2}", lambda s: F.try_to_date(s, "yyyy/M/d"), "exact")

    def month_of(s: Column) -> Column:
        name = F.lower(F.regexp_extract(s, r"^[A-Za-z]+", 0))
        out = F.lit(None).cast("string")
        for k, v in K.MONTHS.items():
            out = F.when(name == k, f"{v:02d}").otherwise(out)
        return out

    year = lambda s: F.regexp_extract(s, r"(\d{4})$", 1)
    day = lambda s: F.lpad(F.regexp_extract(s, r"\s(\d{1,2}),?\s", 1), 2, "0")
    exact = made(rf"(?i)\b(?:{_MONTH})\s+\d{{1,2}},?\s+\d{{4}}\b", lambda s: F.try_to_date(F.concat_ws("-", year(s), month_of(s), day(s)), "yyyy-MM-dd"), "exact")
    month = made(rf"(?i)\b(?:{_MONTH})\s+\d{{4}}\b", lambda s: F.try_to_date(F.concat_ws("-", year(s), month_of(s), F.lit("01")), "yyyy-MM-dd"), "month")
    alone = made(r"(?i)\b(?:in|during)\s+(?:19\d\d|20\d\d|2100)\b", lambda s: F.try_to_date(F.concat(year(s), F.lit("-01-01")), "yyyy-MM-dd"), "year")
    return F.filter(F.concat(iso, slash, exact, month, alone), lambda x: x["date"].isNotNull())
