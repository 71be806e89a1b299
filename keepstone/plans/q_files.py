"""Files of foreign formats, made from the supplied tables, written, and read by the importers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.operators import rotation as R
from keepstone.operators import search as Q
from keepstone.operators import writing as W
from keepstone.operators.store import scratch as place
from keepstone.operators.summaries import summaries
from keepstone.plans.data import ASKING, MEMORIES_SQL, TEXTS_SQL, memories
from keepstone.plans.q_graph import EDGES_SQL, edges, raw_edges
from keepstone.plans.q_text import SUMMARY_SQL, tokens_sql
from keepstone.plans.registry import query
from keepstone.session import table
from keepstone.sources import exports as X
from keepstone.sources import imports as I

_M = f"WITH {MEMORIES_SQL}"


@query("s8_jsonl", _M + " SELECT md5(trim(content)) AS content_md5, array_to_string(tags, ',') AS tags, source, priority FROM memories WHERE length(trim(content)) >= 5")
def s8(spark: SparkSession, sf: str) -> DataFrame:
    """Exported lines and broken ones, from files."""
    path = place(spark, "jsonl")
    broken = spark.createDataFrame([("{not json",), ('{"content": "abc"}',), ("",)], "line string")
    X.write_lines(X.jsonl(memories(spark, sf)).select("line").unionByName(broken), path)
    return I.read_jsonl(spark, path).select(F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "source", "priority")


@query("s9_json_arrays", "SELECT md5(text) AS content_md5, 'a,b' AS tags, 'json' AS source, 0.5::DOUBLE AS priority FROM documents WHERE length(text) >= 5")
def s9(spark: SparkSession, sf: str) -> DataFrame:
    """Files that each hold an array of so many objects; source and priority are missing."""
    path = place(spark, "arrays")
    d = table(spark, sf, "documents").select(F.to_json(F.struct(F.col("text").alias("content"), F.array(F.lit("a"), F.lit("b")).alias("tags"))).alias("line"))
    X.write_arrays(d, path)
    return I.read_json_array(spark, path).select(F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "source", "priority")


@query("s10_csv", "SELECT md5(trim(text)) AS content_md5, lang AS tags, source FROM documents WHERE length(trim(text)) >= 5")
def s10(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line ends, commas and quotes in quoted fields."""
    path = place(spark, "csv")
    table(spark, sf, "documents").select(F.col("text").alias("body"), "lang", F.col("source").alias("origin")).write.csv(path, header=True, quoteAll=True, escape='"')
    d = I.read_csv(spark, path, content="body", tag="lang", source="origin")
    return d.select(F.md5("content").alias("content_md5"), F.array_join("tags", ",").alias("tags"), "source")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as memories: few enough to be files of their own."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"), F.array(F.lit("x"), F.lit("y z")).alias("tags"), F.lit("bench").alias("source"), F.lit(0.25).alias("priority"))


@query("s11_markdown", "SELECT CAST(item_id AS VARCHAR) AS id, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS content_md5, 'x|y z' AS tags, 'bench' AS source, 0.25::DOUBLE AS priority FROM benchmark WHERE length(trim(text)) >= 5")
def s11(spark: SparkSession, sf: str) -> DataFrame:
    """One file a memory, with frontmatter, written and read."""
    path = place(spark, "markdown")
    X.write_files(X.markdown(_items(spark, sf)), path)
    return I.read_markdown(spark, path).select("id", F.md5("content").alias("content_md5"), F.array_join("tags", "|").alias("tags"), "source", "priority")


@query("s18_unknown_notes", "SELECT CAST(item_id AS VARCHAR) AS id FROM benchmark WHERE item_id % 2 = 1 AND length(trim(text)) >= 5")
def s18(spark: SparkSession, sf: str) -> DataFrame:
    """Notes whose ids aren't known."""
    path = place(spark, "notes")
    m = _items(spark, sf).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).withColumn("l3", F.lit("a"))
    X.write_files(X.obsidian(m), path)
    known = m.where("id % 2 = 0").select(F.col("id").cast("string").alias("id"))
    return I.read_markdown(spark, path, known).select("id")


@query("s19_logseq", "SELECT md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[ \\t]*-[ \\t]?', ''))), lambda x: x <> ''), chr(10))) AS content_md5, 'x|y z' AS tags FROM benchmark")
def s19(spark: SparkSession, sf: str) -> DataFrame:
    path = place(spark, "logseq")
    X.write_files(X.logseq(_items(spark, sf)), path)
    return I.read_logseq(spark, path).select(F.md5("content").alias("content_md5"), F.array_join("tags", "|").alias("tags"))


@query("s17_notion", "SELECT 'Title ' || item_id AS l3, md5('# Title ' || item_id || chr(10) || 'Tags: a, b' || chr(10) || trim(text)) AS content_md5, 'notion|a|b' AS tags FROM benchmark UNION ALL SELECT 'Row ' || c_custkey, md5('# Row ' || c_custkey || chr(10) || '**Segment**: ' || c_mktsegment || chr(10) || '**Note**: a longer note'), 'notion|t' FROM customer")
def s17(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, and a database as CSV."""
    path = place(spark, "notion")
    page = F.concat(F.lit("# Title "), F.col("item_id").cast("string"), F.lit("\nTags: a, b\n"), F.trim("text"))
    X.write_files(table(spark, sf, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".md")).alias("name"), page.alias("body")), path)
    rows = table(spark, sf, "customer").select(F.concat(F.lit("Row "), F.col("c_custkey").cast("string")).alias("Name"), F.lit("t").alias("Tags"), F.col("c_mktsegment").alias("Segment"), F.lit("a longer note").alias("Note"))
    rows.write.option("maxRecordsPerFile", 100_000).csv(f"{path}/database", header=True, quoteAll=True, escape='"')
    return I.read_notion(spark, path).select("l3", F.md5("content").alias("content_md5"), F.array_join("tags", "|").alias("tags"))


_SAID = "SELECT md5(trim(text)) AS content_md5, 'conversation ' || conv_id AS title FROM conversations WHERE role = 'assistant' AND length(trim(text)) >= 10"


@query("s12_chat_mapping", _SAID)
def s12(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    message = F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"))
    node = F.struct(F.col("turn").cast("string").alias("k"), F.struct(message.alias("message")).alias("v"))
    each = c.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(node)).alias("mapping"))  # of one conversation
    path = place(spark, "chat")
    X.write_arrays(each.select(F.to_json(F.struct(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), "mapping")).alias("line")), path)
    return I.read_chat_mapping(spark, path).select(F.md5("content").alias("content_md5"), "title")


@query("s13_chat_messages", _SAID)
def s13(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    message = F.struct("turn", F.col("role").alias("sender"), "text")
    each = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("chat_messages"))  # of one conversation
    path = place(spark, "messages")
    X.write_arrays(each.select(F.to_json(F.struct(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("name"), "chat_messages")).alias("line")), path)
    return I.read_chat_messages(spark, path).select(F.md5("content").alias("content_md5"), "title")


@query("k5_instructions", f"WITH {TEXTS_SQL}, {SUMMARY_SQL} SELECT t.id, md5(coalesce(s.l3, substr(t.text, 1, 200))) AS asked_md5, md5(t.text) AS answered_md5 FROM texts t LEFT JOIN summary s ON t.id = s.id WHERE t.id >= 0 AND coalesce(s.l3, substr(t.text, 1, 200)) <> ''")
def k5(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    m = summaries(t).join(t.withColumnRenamed("text", "content"), "id")
    r = X.instructions(m, ASKING).select("id", F.from_json("line", "instruction string, input string, output string").alias("r"))
    return r.select("id", F.md5(F.substring("r.instruction", len(ASKING) + 1, 1 << 30)).alias("asked_md5"), F.md5("r.output").alias("answered_md5"))


@query("k11_backup", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    """A table that was copied, lost all but a row, and was brought back."""
    copy, live = place(spark, "copy"), place(spark, "live")
    d = table(spark, sf, "documents")
    X.backup({"documents": d}, copy)
    X.backup({"documents": d.limit(1)}, live)
    return X.restore(spark, copy, live, ["documents"], place(spark, "safe"))["documents"].select("doc_id", F.md5("text").alias("text_md5"))


def archived(spark: SparkSession, sf: str) -> str:
    path = place(spark, "archives")
    R.archive(memories(spark, sf).select("id", "content", "created_at"), path)
    return path


@query("p24_archives", _M + "SELECT strftime(created_at, '%Y_%m') AS month, count(*) AS n FROM memories GROUP BY 1")
def p24(spark: SparkSession, sf: str) -> DataFrame:
    return R.archives(spark, archived(spark, sf)).select("month", "n")


@query("d11_aged", _M + "SELECT id, CASE WHEN created_at < TIMESTAMP '2024-01-25 00:00:00' THEN 'x' ELSE 'y' END AS part, CASE WHEN date_diff('month', created_at, TIMESTAMP '2025-01-15 00:00:00') > 11 THEN 'pruned' WHEN date_diff('month', created_at, TIMESTAMP '2025-01-15 00:00:00') >= 10 THEN 'packed' ELSE 'fresh' END AS state, CASE WHEN date_diff('month', created_at, TIMESTAMP '2025-01-15 00:00:00') < 10 THEN md5(content) END AS content_md5, date_diff('month', created_at, TIMESTAMP '2025-01-15 00:00:00') BETWEEN 10 AND 11 AS has_bytes FROM memories")
def d11_aged(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of archived months: all of the newest, bytes of older ones, abstracts of the oldest."""
    d = R.aged(memories(spark, sf), date(2025, 1, 15), pack_after=10, keep=11)
    part = F.when(F.col("created_at") < F.expr("timestamp_ntz'2024-01-25 00:00:00'"), "x").otherwise("y")
    return d.select("id", part.alias("part"), "state", F.md5("content").alias("content_md5"), F.col("packed").isNotNull().alias("has_bytes"))


_TERMS = ["rewh", "nd"]


@query(
    "j17_archive_search",
    _M + f""", tok AS (SELECT strftime(created_at, '%Y_%m') AS archive, id, {tokens_sql('content')} AS t FROM memories), q(w) AS (VALUES ('rewh'), ('nd')),
tf AS (SELECT archive, id, w, len(t) AS n, len(list_filter(t, lambda x: x = w)) AS f FROM tok, q), df AS (SELECT archive, w, count(*) FILTER (f > 0) AS df FROM tf GROUP BY archive, w), tot AS (SELECT archive, count(*) AS total, avg(len(t)) AS mean FROM tok GROUP BY archive),
bm AS (SELECT archive, id, sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM tf JOIN df USING (archive, w) JOIN tot USING (archive) GROUP BY archive, id HAVING sum(f) > 0),
best AS (SELECT * FROM bm QUALIFY row_number() OVER (PARTITION BY archive ORDER BY score DESC, id) <= 10)
SELECT archive, id, round(score, 9) AS score FROM best ORDER BY score DESC, archive, id LIMIT 10""",
)
def j17(spark: SparkSession, sf: str) -> DataFrame:
    """A union over archives, each of which ranks its own texts."""
    return R.search(spark, archived(spark, sf), _TERMS).select("archive", "id", F.round("score", 9).alias("score"))


@query("d4_shared", _M + "SELECT id + 1000000 AS id, md5(content) AS content_md5, 'team' AS namespace, 'general' AS memory_type, 'stable' AS staleness FROM memories WHERE id IN (2, 3, 5)")
def d4_shared(spark: SparkSession, sf: str) -> DataFrame:
    s = W.shared(memories(spark, sf), [2, 3, 5], "team", lambda i: i + 1_000_000)
    return s.select("id", F.md5("content").alias("content_md5"), "namespace", "memory_type", "staleness")


@query("d4_forgotten", f"WITH {EDGES_SQL}, {MEMORIES_SQL.strip()} SELECT 'memory' AS kind, id FROM memories WHERE id % 10 <> 3 UNION ALL SELECT 'edge', edge_id FROM edges0 WHERE memory_id % 10 <> 3 OR memory_id >= (SELECT count(*) FROM memories)")
def d4_forgotten(spark: SparkSession, sf: str) -> DataFrame:
    """Memories that are forgotten, and the edges that go with them."""
    m = memories(spark, sf)
    out = W.forgotten(m, m.where("id % 10 = 3").select("id"), edges=raw_edges(spark, sf))
    return out["memories"].select(F.lit("memory").alias("kind"), "id").unionByName(out["edges"].select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")))


@query("p4_manual_close", f"WITH {EDGES_SQL} SELECT edge_id, (valid_until IS NULL AND superseded_by IS NULL) AND NOT (source = 'u7' AND relation = 'view') AS active FROM edges")
def p4_close(spark: SparkSession, sf: str) -> DataFrame:
    """Edges after all of one entity and relation are closed by hand."""
    from keepstone.operators.graph import close

    e = close(edges(spark, sf), (F.col("source") == "u7") & (F.col("relation") == "view"), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    return e.select("edge_id", (F.col("valid_until").isNull() & F.col("superseded_by").isNull()).alias("active"))


@query("p22_diff_json", _M + "SELECT id, '{\"id\":' || id || ',\"change\":\"' || CASE WHEN created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' THEN 'new' ELSE 'updated' END || '\"}' AS line FROM memories WHERE created_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' OR updated_at BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def p22_json(spark: SparkSession, sf: str) -> DataFrame:
    """A difference as lines of JSON."""
    from keepstone.operators.timeline import diff, rendered

    m = memories(spark, sf)
    at = lambda d: F.expr(f"timestamp_ntz'2024-01-{d} 00:00:00'")
    none = m.limit(0).select("id", F.col("created_at").alias("ts"))
    return rendered(diff(m, m, none, at(10), at(20)), "json")


@query("tk2_sign_index")
def tk2(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate search by stored sign projections; the tests measure what it finds."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = Q.build_sign_index(v)
    q = v.where("id = 7").first()["embedding"]
    return index.nearest(list(q), 10).select("id", F.round("score", 9).alias("score"))
