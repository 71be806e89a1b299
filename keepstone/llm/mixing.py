"""Mixing sources to target weights by Poisson replication, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import at_most

#: A Poisson count with a larger mean is a sum of independent counts whose means are at most this.
PART_MEAN = 8.0
#: Sources whose table is broadcast; with more of them the join shuffles.
BROADCAST_SOURCES = 10_000
#: Numbers that a 52-bit hash takes.
SPAN = float(1 << 52)


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of the parts, the same on any engine."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / SPAN


def poisson_table(mean: Column) -> Column:
    """The distribution function of a Poisson variable of a mean up to PART_MEAN, at 0, 1, 2 ... until it is 1 in doubles."""
    last = int(PART_MEAN + 12 * math.sqrt(PART_MEAN) + 20)
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(last)), start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, temperature: float, budget: int | None, source_col: str = "source") -> DataFrame:
    """One row for each source: its size, its mean repetition rate, and the distribution of its parts.

    The rate is weight x budget / size. Without weights they are size ** temperature, made to sum
    to 1; sources without a weight get none. The budget is the number of all rows if not given.
    """
    n = docs.groupBy(F.col(source_col).alias("m_source")).agg(F.count("*").alias("m_rows"))
    if weights is not None:
        share = sum(weights.values()) or 1.0
        w = F.lit(0.0)
        for k, v in sorted(weights.items(), key=lambda kv: str(kv[0])):
            w = F.when(F.col("m_source").eqNullSafe(F.lit(k)), F.lit(v / share)).otherwise(w)
        n = n.withColumn("m_weight", w)
        total = n.agg(F.sum("m_rows").alias("m_total"), F.lit(1.0).alias("m_norm"))
    else:
        n = n.withColumn("m_weight", F.pow(F.col("m_rows").cast("double"), F.lit(float(temperature))))
        total = n.agg(F.sum("m_rows").alias("m_total"), F.sum("m_weight").alias("m_norm"))
    rate = F.col("m_weight") / F.col("m_norm") * (F.lit(float(budget)) if budget is not None else F.col("m_total").cast("double")) / F.col("m_rows")
    return (
        n.join(F.broadcast(total))  # one row
        .select("m_source", "m_rows", rate.alias("m_rate"))
        .withColumn("m_parts", F.greatest(F.lit(1), F.ceil(F.col("m_rate") / PART_MEAN)).cast("int"))
        .withColumn("m_cdf", poisson_table(F.col("m_rate") / F.col("m_parts")))
    )


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """Repeat each document a Poisson number of times whose mean is its source's target rate; shuffle the copies globally.

    Returns the columns of ``docs``, copy int (from 0), n_copies int, mix_key string; rows lie in
    the order of mix_key within each partition, and partitions are dealt by its hash. The count
    follows from seed and id alone: repeated ids get the same count, a null id counts as the
    empty text, a null source is a source of its own. Documents whose count is 0 don't appear. Texts aren't
    read. Columns of ``docs`` named copy, n_copies or mix_key are replaced.
    """
    docs = docs.drop("copy", "n_copies", "mix_key")
    rates = source_rates(docs.select(source_col), weights, temperature, budget, source_col)
    small = at_most(docs.select(source_col).distinct(), BROADCAST_SOURCES)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    joined = docs.join(F.broadcast(rates) if small else rates, docs[source_col].eqNullSafe(rates["m_source"]))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("m_parts")),
        F.lit(0),
        lambda acc, part: acc + F.size(F.filter(F.col("m_cdf"), lambda c: c < uniform(f"{seed}", ident, part.cast("string")))),
    )
    # a draw is the number of entries of the distribution function below the uniform number
    out = joined.withColumn("n_copies", drawn).where("n_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    out = out.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}"), F.lit("order"), ident, F.col("copy").cast("string")).cast("binary")))
    out = out.drop("m_source", "m_rows", "m_rate", "m_parts", "m_cdf")
    key = F.col("mix_key")
    return (out.repartition(partitions, key) if partitions else out.repartition(key)).sortWithinPartitions(key)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The number of copies needs a running sum of doubles in the same order as mix() takes it.
OP2_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
norm AS (SELECT sum(n) AS total, sum(pow(CAST(n AS DOUBLE), 0.5)) AS s FROM sizes),
rates AS (SELECT source, pow(CAST(n AS DOUBLE), 0.5) / s * CAST(total AS DOUBLE) / n AS rate FROM sizes, norm),
parts AS (SELECT source, CAST(greatest(1, ceil(rate / 8.0)) AS INT) AS m, rate / CAST(greatest(1, ceil(rate / 8.0)) AS INT) AS mean FROM rates),
cdf AS (
  SELECT source, m, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
  UNION ALL
  SELECT source, m, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 61
),
draws AS (
  SELECT DISTINCT d.doc_id, d.source, i.i,
    (CAST(('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || i.i), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.m + 1)) AS i) i
),
counts AS (
  SELECT w.doc_id, w.source, count(*) AS n_copies FROM draws w JOIN cdf ON w.source IS NOT DISTINCT FROM cdf.source AND cdf.c < w.u GROUP BY w.doc_id, w.source
)
SELECT d.*, CAST(c.n_copies AS INT) AS n_copies, CAST(x.copy AS INT) AS copy,
  md5('0:order:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || x.copy) AS mix_key
FROM documents d JOIN counts c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.source IS NOT DISTINCT FROM c.source,
  LATERAL (SELECT unnest(range(0, c.n_copies)) AS copy) x
"""
