"""Line dedup by distinct-site spread: sketches per line, exact counts near the threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions.context import bound
from keepstone.llm.common import stash

#: Characters that a line is stripped of before it is compared.
EDGE = " \t\r\x0b\f"
#: log2 of the registers of a sketch.
LG_K = 12
#: Sites from which a line counts as boilerplate.
MIN_SITES = 5


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(EDGE))


def line_keys(text: Column) -> Column:
    """Two hashes (96 bits) of each line that isn't blank; null for a blank one."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(stripped(x) != "", F.struct(F.xxhash64(stripped(x)).alias("a"), F.crc32(stripped(x).cast("binary")).alias("b"))))


def spread(docs: DataFrame, min_sites: int, text_col: str, site_col: str) -> DataFrame:
    """Lines (a, b) whose sketch says that at least min_sites - 1 sites have them, with the estimate."""
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.array_compact(line_keys(F.col(text_col))))).alias("l"))
    sketches = lines.select("site", "l.a", "l.b").where("site IS NOT NULL").groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    return sketches.where(F.col("estimate") >= max(1, min_sites - 1 - _margin(min_sites)))


def _margin(min_sites: int) -> int:
    """Four standard errors of a sketch at the threshold."""
    return int(4 * 1.04 / 2 ** (LG_K / 2) * min_sites)


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Where lines of at least ``min_sites`` distinct sites occur: a, b, id, text hash, first (the smallest id that has it).

    Sketches are merged by partial aggregation, so a very frequent line is summed up before it is
    shuffled. Lines whose estimate lies within one site plus four standard errors of the threshold
    are counted exactly; only places of lines near or above the threshold are written.
    """
    near = max(1, 1 + _margin(min_sites))
    wanted = stash(spread(docs, min_sites, text_col, site_col), "spread", narrow=True)
    places = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.array_compact(line_keys(F.col(text_col))))).alias("l")
    ).select("id", "text_hash", "site", "l.a", "l.b")
    places = stash(places.join(wanted, ["a", "b"]), "places", narrow=True)
    sure = places.where(F.col("estimate") > min_sites + near)
    close = places.where(F.col("estimate") <= min_sites + near)
    sites = close.where("site IS NOT NULL").select("a", "b", "site").distinct().groupBy("a", "b").agg(F.count("*").alias("sites"))
    spread_out = sure.select("a", "b").distinct().unionByName(sites.where(F.col("sites") >= min_sites).select("a", "b"))
    first = places.groupBy("a", "b").agg(F.min("id").alias("first"))
    boilerplate = stash(first.join(spread_out, ["a", "b"], "left_semi"), "boilerplate", narrow=True)  # its size is known before the join is planned
    return places.select("a", "b", "id", "text_hash").join(boilerplate, ["a", "b"])


def _key(x: Column) -> Column:
    return F.struct(x["a"].alias("a"), x["b"].alias("b"))


def _steps(keys: Column) -> Column:
    """Falling powers of two, from the largest that is no more than the number of keys."""
    return F.when(F.size(keys) > 0, F.transform(F.sequence(F.floor(F.log2(F.size(keys))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2.0), e).cast("int")))


def _last_upto(table: Column, key: Column) -> Column:
    """The place of the last of the sorted keys k of a table (k, steps) that is no more than this one, by bisection; -1 if there is none."""
    return F.aggregate(table["steps"], F.lit(-1), lambda at, step: F.when(F.get(table["k"], at + step) <= key, at + step).otherwise(at))


def _table(rows: Column, use: Callable[[Column], Column]) -> Column:
    """use(table) of rows that are sorted by their keys (a, b): rows r, keys k, steps."""
    return bound(rows, lambda r: bound(F.transform(r, _key), lambda k: bound(F.struct(r.alias("r"), k.alias("k"), _steps(k).alias("steps")), use)))


def left_over(text: Column, gone: Column) -> Column:
    """The lines that stay and the number of others, as a struct (lines, removed): gone has (a, b, stays) of a text's boilerplate lines.

    Whatever is looked up in is bound once for a text: the expression can be moved or repeated by the optimiser
    without being computed for each line.
    """
    pieces = F.zip_with(F.split(text, "\n"), line_keys(text), lambda t, k: F.struct(t.alias("t"), k["a"].alias("a"), k["b"].alias("b")))

    def kept(p: Column, of_gone: Column, of_firsts: Column) -> Column:
        def stays(x: Column, i: Column) -> Column:
            found = F.get(of_gone["r"], _last_upto(of_gone, _key(x)))
            first_here = F.get(of_firsts["r"], _last_upto(of_firsts, _key(x)))["i"] == i
            return F.when(x["a"].isNull() | ~_key(found).eqNullSafe(_key(x)), True).otherwise(found["stays"] & first_here)

        lines = F.transform(F.filter(p, stays), lambda x: x["t"])
        return bound(lines, lambda x: F.struct(x.alias("lines"), (F.size(p) - F.size(x)).alias("removed")))

    def with_firsts(p: Column, of_gone: Column) -> Column:
        order = F.when(F.exists(of_gone["r"], lambda g: g["stays"]), F.sort_array(F.transform(p, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("i")))))
        firsts = bound(order, lambda o: F.filter(o, lambda x, i: ~_key(x).eqNullSafe(_key(F.get(o, i - 1)))))
        return _table(firsts, lambda of_firsts: kept(p, of_gone, of_firsts))

    return F.when(gone.isNotNull(), bound(pieces, lambda p: _table(F.sort_array(gone), lambda of_gone: with_firsts(p, of_gone))))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Take lines that many sites share out of all documents but the first that has them.

    Adds n_lines, n_removed (long) and replaces the text; other columns stay as they are, and
    columns called n_lines or n_removed are replaced. Lines are compared without blanks at their
    edges; blank lines stay. With keep_first a line stays at its first place in the document of
    the smallest id that has it (null ids last), so no content vanishes from the corpus.
    Null sites are no sites; null texts stay null with counts 0; repeated rows get the same result.
    The lines of a text are looked up among its boilerplate lines by bisection, so a long text of n lines takes n log n steps.
    """
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    found = boilerplate_lines(docs, min_sites, id_col, text_col, site_col)
    stays = (F.col("id").eqNullSafe(F.col("first"))) if keep_first else F.lit(False)
    gone = stash(found.groupBy(F.col("id").alias("g_id"), "text_hash").agg(F.collect_set(F.struct("a", "b", stays.alias("stays"))).alias("gone")), "gone", narrow=True)
    plain = [f"d{i}" for i in range(len(names))]  # no column's name can clash with those used here
    ident, text = (F.col(plain[names.index(c)]) for c in (id_col, text_col))
    d = docs.toDF(*plain).join(gone, ident.eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("text_hash")), "left").drop("g_id", "text_hash")
    d = d.withColumn("done", left_over(text, F.col("gone")))
    n_lines = F.coalesce(F.size(F.array_compact(line_keys(text))), F.lit(0))
    n_removed = F.coalesce("done.removed", F.lit(0))
    left = F.when(F.col("done").isNotNull(), F.array_join("done.lines", "\n")).otherwise(text)
    out = [left.alias(n) if n == text_col else F.col(p).alias(n) for p, n in zip(plain, names, strict=True)]
    return d.select(*out, F.when(text.isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH l AS (
  SELECT doc_id, source, u.i AS pos, u.t AS line, trim(u.t, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
),
b AS (SELECT s, min(doc_id) AS first FROM l WHERE s <> '' GROUP BY s HAVING count(DISTINCT source) >= 5),
m AS (
  SELECT l.*, b.s IS NOT NULL AND NOT (l.doc_id = b.first AND row_number() OVER (PARTITION BY l.doc_id, l.s ORDER BY l.pos) = 1) AS gone
  FROM l LEFT JOIN b ON l.s = b.s
)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_removed, 0) AS n_removed,
  sha256(coalesce(x.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (s <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept
  FROM m GROUP BY doc_id
) x ON d.doc_id = x.doc_id
"""
