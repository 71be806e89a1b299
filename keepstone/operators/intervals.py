"""Joins of points with spans that hold them, by bins of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.operators.store import stash

#: A span has no more bins than this of its own width, and one more.
BINS = 8
#: Points of a bin from which they are dealt over several tasks.
SALTED = 4096
#: Full bins whose numbers of pieces are broadcast; with more of them the join shuffles.
BROADCAST_BINS = 10_000


def place(column: str, rows: DataFrame) -> Column:
    """Where a value lies on a line of numbers, in the order of the values: seconds for times, days for dates, numbers themselves."""
    kind = rows.schema[column].dataType.simpleString()
    c = F.col(column)
    if kind == "timestamp":
        return F.unix_seconds(c).cast("double")
    if kind == "timestamp_ntz":
        return (F.unix_date(F.to_date(c)) * 86400.0 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))).cast("double")
    return F.unix_date(c).cast("double") if kind == "date" else c.cast("double")


def within(points: DataFrame, spans: DataFrame, at: str, lo: str, hi: str, on: tuple[str, ...] = (), end_open: bool = False) -> DataFrame:
    """Each point with each span of the same ``on`` that it lies in: lo <= at <= hi, or at < hi with ``end_open``.

    A null lo or hi is no limit on that side; a null ``at`` lies nowhere. All columns of both sides come back, those in ``on`` once;
    others must differ in their names. Nulls in ``on`` meet nothing.

    A span is cut to the range of the points and put into bins of the least width of which it needs BINS at
    most (widths are powers of two), a point into one bin of each width that spans use: rows grow
    by constants, whatever the lengths, and only what shares a bin meets. Points of a full bin are dealt
    over several tasks, which its spans go to all.
    """
    p = points.withColumn("_x", place(at, points)).where("_x IS NOT NULL")
    ends = p.agg(F.min("_x").alias("a"), F.max("_x").alias("b")).first()
    least, most = (0.0, 0.0) if ends["a"] is None else (ends["a"], ends["b"])
    x, y = F.coalesce(place(lo, spans), F.lit(least)), F.coalesce(place(hi, spans), F.lit(most))
    s = spans.withColumn("_a", F.greatest(x, F.lit(least))).withColumn("_b", F.least(y, F.lit(most))).where("_a <= _b")
    size = F.greatest(F.col("_b") - F.col("_a"), F.lit(1e-9)) / BINS
    s = s.withColumn("_w", F.ceil(F.log2(size)).cast("int"))
    widths = [r["_w"] for r in s.select("_w").distinct().collect()]  # as many as there are powers of two
    bin_of = lambda v, w: F.floor(v / F.pow(F.lit(2.0), w)).cast("long")
    s = s.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_a"), F.col("_w")), bin_of(F.col("_b"), F.col("_w"))))).drop("_a", "_b")
    p = p.withColumn("_w", F.explode(F.array(*[F.lit(w) for w in widths]).cast("array<int>"))).withColumn("_bin", bin_of(F.col("_x"), F.col("_w"))).drop("_x")
    keys = [*on, "_w", "_bin"]
    full = stash(p.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > SALTED).select(*keys, F.ceil(F.col("_n") / SALTED).cast("int").alias("_pieces")), "bins")
    full = F.broadcast(full) if full.limit(BROADCAST_BINS + 1).count() <= BROADCAST_BINS else full
    pieces = F.coalesce("_pieces", F.lit(1))
    p = p.join(full, keys, "left").withColumn("_salt", F.floor(F.rand(7) * pieces).cast("int")).drop("_pieces")
    s = s.join(full, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    inside = (F.col(lo).isNull() | (F.col(lo) <= F.col(at))) & (F.col(hi).isNull() | ((F.col(at) < F.col(hi)) if end_open else (F.col(at) <= F.col(hi))))
    # spans are many times what their files' sizes say, so they are never broadcast for being small
    return p.join(s.hint("merge"), [*keys, "_salt"]).where(inside).drop("_w", "_bin", "_salt")
