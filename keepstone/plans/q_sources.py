"""Spans of sensitive data, dense parts of web pages, and memories and notes kept in step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import spans as P
from keepstone.plans.data import PLAIN_CASED, TEXTS_SQL, hours_after, sql_text, texts
from keepstone.plans.registry import query
from keepstone.session import table
from keepstone.sources import imports as I
from keepstone.sources import sync as Y


def spans_sql(source: str) -> str:
    """A table of spans (id, start, stop, category, name) of the texts p of a table (id, p), pattern by pattern."""
    one = lambda c, n, p: (
        f"SELECT id, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n, '{c}' AS category, {sql_text(n)} AS name "
        f"FROM (SELECT id, m, b, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(p, {sql_text(p)}) AS m, string_split_regex(p, {sql_text(p)}) AS b FROM {source}))"
    )
    return "SELECT id, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop, category, name FROM (" + " UNION ALL ".join(one(c, n, p) for c, n, p in K.SENSITIVE_PATTERNS) + ")"


@query("x16_sensitive_spans", f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN_CASED} AS p FROM texts), s AS ({spans_sql('p')}) SELECT id, count(*) AS n, string_agg(start || '-' || stop || ' ' || name, ',' ORDER BY start, stop, category, name) AS spans FROM s GROUP BY id")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    """Where the sensitive data of all documents and samples stands."""
    s = texts(spark, sf).select("id", P.sensitive_spans(F.col("text")).alias("s")).where(F.size("s") > 0)
    told = F.transform("s", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(" "), x["name"]))
    return s.select("id", F.size("s").cast("long").alias("n"), F.array_join(told, ",").alias("spans"))


@query("a19_span_categories", f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN_CASED} AS p FROM texts), s AS ({spans_sql('p')}) SELECT category, name, count(*) AS n, count(DISTINCT id) AS texts, CAST(sum(stop - start) AS BIGINT) AS chars FROM s GROUP BY category, name")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    s = texts(spark, sf).select("id", F.explode(P.sensitive_spans(F.col("text"))).alias("s"))
    return s.groupBy(F.col("s.category").alias("category"), F.col("s.name").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("texts"), F.sum((F.col("s.end") - F.col("s.start")).cast("long")).alias("chars"))


_VISIBLE = lambda x: (
    f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
)
_WORDS = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"
_OPEN = r"(?i)</?article\b[^>]*>"


def _bare_sql(x: str) -> str:
    for tag in ("script", "style", "head", "nav", "footer"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    return f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"


@query(
    "s15_dense_pages",
    f"WITH h AS (SELECT page_id, {_bare_sql(f'regexp_replace(html, {sql_text(_OPEN)}, {sql_text("<div>")}, {sql_text("g")})')} AS x FROM pages), "
    f"c AS (SELECT page_id, list_filter(list_transform(string_split_regex(x, {sql_text(I.BLOCK)}), lambda y: {{'t': {_VISIBLE('y')}, 'l': {_VISIBLE(f'array_to_string(regexp_extract_all(y, {sql_text(I.LINK)}, 1), {sql_text(" ")})')}}}), lambda z: z.t <> '') AS b FROM h), "
    f"d AS (SELECT page_id, list_transform(b, lambda z: {{'t': z.t, 'n': {_WORDS('z.t')}, 'd': {_WORDS('z.l')} / {_WORDS('z.t')}}}) AS b FROM c), "
    "k AS (SELECT page_id, list_filter(range(1, len(b) + 1), lambda i: b[i].d <= 0.333333 AND CASE WHEN i > 1 AND b[i - 1].d > 0.555556 THEN b[i].n > 40 OR coalesce(b[i + 1].n, 0) > 17 ELSE b[i].n > 16 OR coalesce(b[i + 1].n, 0) > 15 OR (i > 1 AND b[i - 1].n > 4) END) AS k, b FROM d) "
    "SELECT page_id, CAST(len(k) AS INT) AS blocks, md5(coalesce(array_to_string(list_transform(k, lambda i: b[i].t), chr(10)), '')) AS text_md5 FROM k",
)
def s15(spark: SparkSession, sf: str) -> DataFrame:
    """Main contents of pages that no longer say where their article is."""
    d = table(spark, sf, "pages").select("page_id", I.dense_text(F.regexp_replace("html", _OPEN, "<div>")).alias("t"))
    return d.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).alias("blocks"), F.md5("t").alias("text_md5"))


_SIDES = """b AS (SELECT doc_id AS id, md5(text) AS d FROM documents WHERE doc_id % 17 <> 5 AND text IS NOT NULL),
n AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 7 = 1 THEN text || ' noted' ELSE text END) AS d, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 5 AS INT)) AS t FROM documents WHERE doc_id % 11 <> 2 AND text IS NOT NULL),
m AS (SELECT doc_id AS id, md5(CASE WHEN doc_id % 5 = 3 THEN text || ' kept' ELSE text END) AS d, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 4 AS INT)) AS t FROM documents WHERE doc_id % 13 <> 4 AND text IS NOT NULL)"""


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last sync, notes and memories of the documents: some are new, changed or gone on either side."""
    d, i = table(spark, sf, "documents").where("text IS NOT NULL"), F.col("doc_id")
    side = lambda changed, more, hours: [i.alias("id"), F.md5(F.when(changed, F.concat("text", F.lit(more))).otherwise(F.col("text"))).alias("digest"), hours_after(hours).alias("modified")]
    return d.where("doc_id % 17 <> 5").select(i.alias("id"), F.md5("text").alias("digest")), d.where("doc_id % 11 <> 2").select(*side(i % 7 == 1, " noted", i % 5)), d.where("doc_id % 13 <> 4").select(*side(i % 5 == 3, " kept", i % 4))


@query(
    "k8_sync_plan",
    f"WITH {_SIDES}, u AS (SELECT coalesce(b.id, n.id, m.id) AS id, b.d AS bd, n.d AS nd, m.d AS md, n.t AS nt, m.t AS mt FROM b FULL JOIN n ON b.id = n.id FULL JOIN m ON m.id = coalesce(b.id, n.id)), "
    "s AS (SELECT *, CASE WHEN bd IS NULL THEN CASE WHEN nd IS NULL THEN 'absent' ELSE 'new' END WHEN nd IS NULL THEN 'gone' WHEN nd = bd THEN 'same' ELSE 'changed' END AS note, CASE WHEN bd IS NULL THEN CASE WHEN md IS NULL THEN 'absent' ELSE 'new' END WHEN md IS NULL THEN 'gone' WHEN md = bd THEN 'same' ELSE 'changed' END AS memory FROM u), "
    "a AS (SELECT *, CASE note || '/' || memory WHEN 'same/same' THEN 'none' WHEN 'same/changed' THEN 'export' WHEN 'same/gone' THEN 'delete_note' WHEN 'changed/same' THEN 'import' WHEN 'changed/gone' THEN 'import' WHEN 'gone/same' THEN 'delete_memory' WHEN 'gone/changed' THEN 'export' WHEN 'gone/gone' THEN 'forget' WHEN 'new/absent' THEN 'import' WHEN 'absent/new' THEN 'export' "
    "ELSE CASE WHEN nd = md THEN 'agree' WHEN nt > mt THEN 'import' ELSE 'export' END END AS action FROM s) "
    "SELECT id, note, memory, action, CASE action WHEN 'import' THEN nd WHEN 'export' THEN md WHEN 'agree' THEN md WHEN 'none' THEN bd END AS digest FROM a",
)
def k8(spark: SparkSession, sf: str) -> DataFrame:
    """What a full sync of notes and memories does, for every combination of changes."""
    return Y.sync_plan(*sides(spark, sf))
