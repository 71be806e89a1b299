"""Where sensitive data stands in a text, as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.functions.context import bound

SPAN = "array<struct<start:int,end:int,category:string,name:string>>"


def found(text: Column, pattern: str) -> Column:
    """Start and end (exclusive, in characters) of each match of a pattern, from left to right.

    A match starts behind all the text between the matches up to it, and all earlier matches.
    """
    p = f"(?U){pattern}"
    matches, between = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)

    def placed(x: Column) -> Column:
        ends = F.aggregate(
            F.zip_with(x["m"], F.slice(x["b"], F.lit(1), F.size(x["m"])), lambda m, b: F.length(m) + F.length(b)),
            F.array().cast("array<int>"),
            lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)),
        )
        return F.zip_with(ends, x["m"], lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(T.matches(text, pattern), bound(F.struct(matches.alias("m"), between.alias("b")), placed)).otherwise(none)


def sensitive_spans(text: Column) -> Column:
    """All matches of all patterns, by start, end, category and name; they may overlap. None in a null text."""

    def tagged(category: str, name: str, pattern: str) -> Column:
        return F.transform(found(text, pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(category).alias("category"), F.lit(name).alias("name")))

    return F.coalesce(F.array_sort(F.concat(*[tagged(*p) for p in K.SENSITIVE_PATTERNS])), F.array().cast(SPAN))


def without_overlaps(spans: Column) -> Column:
    """Of sorted spans those to replace: swept from the left, a span stays if it starts where the last one that stayed has ended, or later."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(spans, F.array().cast(SPAN), lambda acc, s: F.when(s["start"] >= last(acc), F.concat(acc, F.array(s))).otherwise(acc))


def redacted(text: Column, spans: Column) -> Column:
    """The text with a mark of its category in the place of each span; of overlapping ones the first."""

    def marked(kept: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["category"]), F.lit("_REDACTED]")).alias("out"))
        return F.aggregate(kept, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))

    return F.when(F.size(spans) > 0, bound(without_overlaps(spans), marked)).otherwise(text)
