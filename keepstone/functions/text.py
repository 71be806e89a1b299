"""Text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstone.functions import constants as K


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _unicode(pattern: str) -> str:
    """Word boundaries and classes over all letters, not ASCII only."""
    return f"(?U){pattern}"


def _needed(pattern: str) -> str:
    """The longest plain piece that any match of a pattern contains; empty if there may be none."""
    if re.search(r"[|(\[]", pattern):
        return ""
    plain = re.sub(r"\\.[*+?]?|.[?*]", "\0", pattern)
    return max(re.findall(r"[A-Za-z=`> ]+", plain), key=len, default="")


def matches(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; a search for its longest plain piece comes first, as that is much cheaper."""
    piece = _needed(pattern)
    found = text.rlike(_unicode(pattern))
    return F.contains(text, F.lit(piece)) & found if piece else found


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, [matches(text, p).cast("int") for p in patterns])


def tokenize(text: Column) -> Column:
    """Lower-case words of two or more of a-z and 0-9, without stop words, in order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike("^[a-z0-9]{2,}$") & ~w.isin(K.STOP_WORDS))


def bigrams(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at(tokens, i), F.lit("_"), F.element_at(tokens, i + 1)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def memory_type(text: Column) -> Column:
    """The type with most patterns; the first on ties; general without any."""
    low = F.lower(text)
    scores = [hits(low, p) for p in K.TYPE_PATTERNS.values()]
    best = F.greatest(*scores)
    out = F.lit("general")
    for name, s in reversed(list(zip(K.TYPE_PATTERNS, scores, strict=True))):
        out = F.when((s == best) & (best > 0), F.lit(name)).otherwise(out)
    return out


def staleness_class(text: Column) -> Column:
    low = F.lower(text)
    volatile, semi = hits(low, K.VOLATILE_PATTERNS), hits(low, K.SEMI_STABLE_PATTERNS)
    return F.when(volatile >= 2, "volatile").when((semi >= 2) | (volatile >= 1), "semi-stable").otherwise("stable")


def topic_tags(text: Column, existing: Column | None = None) -> Column:
    """Up to five topics of which a keyword occurs, in fixed order, without those in ``existing``."""
    low = F.lower(text)
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]), F.lit(t)) for t, ks in K.TOPIC_KEYWORDS.items()]))
    if existing is not None:
        found = F.array_except(found, F.coalesce(existing, F.array().cast("array<string>")))
    return F.slice(found, 1, K.MAX_TOPICS)


def strip_private(text: Column, replacement: str = "") -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<private>(.*?)</private>", replacement))


def sensitive_counts(text: Column) -> dict[str, Column]:
    """Matches for each category."""
    out: dict[str, Column] = {}
    for category, _, p in K.SENSITIVE_PATTERNS:
        n = F.regexp_count(text, F.lit(_unicode(p)))
        out[category] = out[category] + n if category in out else n
    return out


def redact_sensitive(text: Column) -> Column:
    """Each match replaced by its category's mark, patterns one after the other."""
    for category, _, p in K.SENSITIVE_PATTERNS:
        text = F.regexp_replace(text, _unicode(p), f"[{category.upper()}_REDACTED]")
    return text


def key_terms(text: Column) -> Column:
    """Distinct words of a-z that aren't stop words, in alphabetical order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(runs, lambda w: w.rlike("^[a-z]+$") & ~w.isin(K.KEY_TERM_STOP_WORDS))))


def blank_words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(blank_words(text), _words(K.NEGATIONS))


def opposed(a: Column, b: Column) -> Column:
    """Whether one text has a word and the other its opposite."""
    wa, wb = blank_words(a), blank_words(b)
    pairs = [(F.array_contains(wa, x) & F.array_contains(wb, y)) | (F.array_contains(wa, y) & F.array_contains(wb, x)) for x, y in K.OPPOSITES]
    return reduce(lambda p, q: p | q, pairs)


def contradiction(a: Column, b: Column, score: Column) -> Column:
    """Confidence, 0 to 1, that two texts of the given similarity contradict each other; null below 0.3."""
    overlap = F.size(F.array_intersect(key_terms(a), key_terms(b)))
    c = F.when((has_negation(a) != has_negation(b)) & (overlap >= 3), 0.4).otherwise(0.0) + F.when(opposed(a, b), 0.5).otherwise(0.0) + F.when((score > 0.85) & (F.trim(a) != F.trim(b)), 0.3).otherwise(0.0)
    return F.when((overlap >= 2) & (c >= 0.3), F.least(c, F.lit(1.0)))


def outcome(text: Column) -> Column:
    """mistake, win or observation, by words."""
    w = blank_words(text)
    return F.when(F.arrays_overlap(w, _words(K.LOSS_WORDS)), "mistake").when(F.arrays_overlap(w, _words(K.WIN_WORDS)), "win").otherwise("observation")


def meaningful(sentence: Column) -> Column:
    """At least 15 characters and four words, and no filler at the beginning."""
    filler = reduce(lambda a, b: a | b, [F.startswith(F.lower(sentence), F.lit(f)) for f in K.FILLERS])
    return (F.length(sentence) >= 15) & (F.size(F.regexp_extract_all(sentence, F.lit(r"\S+"), F.lit(0))) >= 4) & ~filler


def week_bucket(ts: Column) -> Column:
    """Year and number of the week that begins on Monday; days before the first Monday are in week 00."""
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-W"), F.lpad(F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("string"), 2, "0"))


def full_text_terms(query: str) -> list[str]:
    """Terms of a full-text query: without operators and stop words, unless nothing else is left."""
    import re

    words = re.sub(r'[*^{}():"]', " ", query).split()
    return [w for w in words if w.lower() not in K.QUERY_STOP_WORDS] or words
