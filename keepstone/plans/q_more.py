"""Lifecycle, dates in texts, observations, encryption, sessions and code style."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import dates as D
from keepstone.functions import profile_values as V
from keepstone.functions.context import prefix, with_context
from keepstone.functions.crypt import MARK, decrypted, encrypted
from keepstone.operators import cards as C
from keepstone.operators import profile as P
from keepstone.operators import reports as O
from keepstone.operators import search as Q
from keepstone.operators import workspace as B
from keepstone.operators import writing as W
from keepstone.operators.calendar import answer, build
from keepstone.operators.summaries import summaries
from keepstone.plans.data import MEMORIES_SQL, TEXTS_SQL, hours_after, memories, sql_text, stamp, texts
from keepstone.plans.q_events import all_events
from keepstone.plans.q_retrieval import index_of, part_sql
from keepstone.plans.q_text import SUMMARY_SQL, sentences_sql
from keepstone.plans.registry import query
from keepstone.session import table

_M = f"WITH {MEMORIES_SQL}"


@query("f10_date_prefix", "SELECT event_id FROM events WHERE starts_with(strftime(ts, '%Y-%m-%d'), '2024-01-1')")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.startswith(F.date_format("ts", "yyyy-MM-dd"), F.lit("2024-01-1"))).select("event_id")


@query("d9_lifecycle", _M + "SELECT id, CASE WHEN list_contains(tags, 'pinned') THEN 1.0 WHEN id % 17 = 0 THEN 0.1 WHEN id % 5 = 0 THEN greatest(priority, 0.9) WHEN id % 3 = 0 THEN least(priority, 0.3) ELSE priority END AS priority FROM memories")
def d9(spark: SparkSession, sf: str) -> DataFrame:
    """Pinned, archived, promoted and demoted priorities."""
    p, i = F.col("priority"), F.col("id")
    new = F.when(F.array_contains("tags", "pinned"), 1.0).when(i % 17 == 0, 0.1).when(i % 5 == 0, F.greatest(p, F.lit(0.9))).when(i % 3 == 0, F.least(p, F.lit(0.3))).otherwise(p)
    return memories(spark, sf).select("id", new.alias("priority"))


@query("x41_encryption", "SELECT doc_id AS id, md5(text) AS content_md5, doc_id % 3 <> 0 AS hidden, doc_id % 3 <> 0 AS shut FROM documents")
def x41(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of which every third is from before encryption: what they hold, whether they hide it, and whether another key opens them."""
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    text = F.col("text")
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, text).otherwise(encrypted(text, key)).alias("e"))
    hidden, shut = F.startswith("e", F.lit(MARK)), decrypted(F.col("e"), other) != text
    return d.select(F.col("doc_id").alias("id"), F.md5(decrypted(F.col("e"), key)).alias("content_md5"), hidden.alias("hidden"), shut.alias("shut"))


_TURNS = "texts AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)"
_SESSION_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(s), {sql_text(k)})" for k in ks) + f" THEN '{c}'" for c, ks in K.SESSION_CATEGORIES.items()) + " ELSE 'learned' END"


def session_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn of a conversation as a memory of its session, with abstract and facts."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return summaries(t).withColumn("session", F.floor(F.col("id") / 1000))


@query("a21_session_summary", f"WITH {_TURNS}, {SUMMARY_SQL}, p AS (SELECT id // 1000 AS session, unnest(list_concat([l3], l2)) AS text FROM summary), q AS (SELECT session, unnest({sentences_sql('text')}) AS s FROM p) SELECT session, {_SESSION_CASE} AS category, count(DISTINCT s) AS sentences FROM q GROUP BY 1, 2")
def a21(spark: SparkSession, sf: str) -> DataFrame:
    return O.session_sentences(session_memories(spark, sf)).groupBy("session", "category").agg(F.count("*").alias("sentences"))


@query("a21_summary_of_summaries", f"WITH abstracts AS (WITH {_TURNS}, {SUMMARY_SQL} SELECT id, l3 FROM summary), texts AS (SELECT id // 1000 AS id, string_agg(l3, '. ' ORDER BY id) AS text FROM abstracts WHERE l3 <> '' GROUP BY 1), {SUMMARY_SQL} SELECT id AS session, md5(l3) AS summary_md5 FROM summary")
def a21_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return O.session_summaries(session_memories(spark, sf)).select("session", F.md5("summary").alias("summary_md5"))


#: Observations, and the facts in them, written out by hand: line, attribute, value, expression.
_OBSERVED = [
    ("- She has tried 4 Korean restaurants.\n* nothing to see here", [(0, "korean_restaurants", "4", None)]),
    ("User switched from vim to emacs, at last", [(0, "user_switched__vim__emac", "emacs", None)]),
    ("He now owns 12 model kits\nshort", [(0, "model_kits", "12", None)]),
    ("User works at Globex, since yesterday.", [(0, "works", "Globex", None), (0, "event", "User works at Globex, since yesterday.", "yesterday")]),
    ("They went home 3 days ago with a cold.", [(0, "event", "They went home 3 days ago with a cold.", "3 days ago")]),
    ("User prefers the window seat; always", [(0, "prefers", "window seat", None)]),
]


@query("x40_observations", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {line}, {sql_text(a)}, {sql_text(v)}, {'NULL' if e is None else sql_text(e)})" for i, (_, found) in enumerate(_OBSERVED) for line, a, v, e in found) + ") t(id, line, attribute, value, expression)")
def x40(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of observations that are known."""
    return O.observed_facts(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_OBSERVED)], "id int, text string"))


_NAME = r"[a-zA-Z_][a-zA-Z0-9_]*"
_KEYWORDS = "[" + ", ".join(map(sql_text, V.CODE_KEYWORDS)) + "]"


@query(
    "x35_naming_style",
    f"""WITH i AS (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(html, '[^\\x00-\\x7F]', '.', 'g'), '\\b({_NAME})\\b', 1), lambda w: NOT list_contains({_KEYWORDS}, w) AND length(w) > 2) AS n FROM pages),
c AS (SELECT page_id, len(list_filter(n, lambda w: contains(w, '_') AND w = lower(w))) AS snake, len(list_filter(n, lambda w: NOT contains(w, '_') AND regexp_matches(w, '^[a-z]') AND regexp_matches(w, '[A-Z]'))) AS camel,
  len(list_filter(n, lambda w: NOT contains(w, '_') AND regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[a-z]'))) AS pascal, len(list_filter(n, lambda w: contains(w, '_') AND w <> lower(w) AND w = upper(w))) AS loud FROM i)
SELECT page_id, CASE WHEN greatest(snake, camel, pascal, loud) = 0 THEN 'unknown' WHEN snake = greatest(snake, camel, pascal, loud) THEN 'snake_case' WHEN camel = greatest(snake, camel, pascal, loud) THEN 'camelCase' WHEN pascal = greatest(snake, camel, pascal, loud) THEN 'PascalCase' ELSE 'SCREAMING_CASE' END AS style FROM c""",
)
def x35(spark: SparkSession, sf: str) -> DataFrame:
    """Styles of the names in pages; letters beyond ASCII stand as a full stop, which every engine takes for the end of a word."""
    p = table(spark, sf, "pages").select("page_id", P.identifiers(F.regexp_replace("html", r"[^\x00-\x7F]", ".")).alias("names"))
    return p.select("page_id", P._first_most(P.naming_counts(F.col("names")), "unknown").alias("style"))


#: Pieces of code, and their styles, written out by hand.
_CODE = [
    ('import os\nimport re\n\nfrom typing import Any\n\nimport zlib\n\ndef load_file(path: str) -> str:\n    """Read.\n\n    Args:\n        path: where.\n    """\n    try:\n        return my_name\n    except OSError:\n        raise LoadError\n', ("PascalCase", "grouped, absolute", "try/except with custom exceptions", "heavy", "google")),
    ("const maxSize = 3\nfunction getName(userName) { return userName }", ("camelCase", "none", "unknown", "none", "none")),
    ("class MyError(Exception): pass\nassert total_sum\nassert other_sum\n", ("snake_case", "none", "assertions with custom exceptions", "none", "none")),
    ("from .a import b\nfrom .c import d\nfrom .e import f\ndef go(x):\n    '''Say.\n\n    :param x: it\n    '''\n    return None\n", ("PascalCase", "alphabetical, relative", "error returns", "none", "sphinx")),
]


@query("x35_code_styles", "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(map(sql_text, s)) + ")" for i, (_, s) in enumerate(_CODE)) + ") t(id, naming, imports, errors, hints, docstrings)")
def x35_styles(spark: SparkSession, sf: str) -> DataFrame:
    return P.styles(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(_CODE)], "id int, text string")).drop("libraries")


def coded_memories(spark: SparkSession, sf: str) -> DataFrame:
    """Memories of the corpus, and pages as code."""
    m = memories(spark, sf).select("id", "content", "memory_type", "tags").withColumn("l3", F.lit(""))
    p = table(spark, sf, "pages").select((F.col("page_id") + 10_000_000).alias("id"), F.col("html").alias("content"), F.lit("code").alias("memory_type"), F.array(F.lit("review")).alias("tags"), F.lit("").alias("l3"))
    return m.unionByName(p)


_ALL = f"WITH {MEMORIES_SQL}, cm AS (SELECT id, content, memory_type, tags FROM memories UNION ALL SELECT page_id + 10000000, html, 'code', ['review'] FROM pages)"


@query("f13_code_related", _ALL + ", x AS (SELECT *, regexp_replace(content, '[^\\x00-\\x7F]', '.', 'g') AS c FROM cm) SELECT id FROM x WHERE memory_type = 'code' OR list_has_any(tags, ['code', 'snippet', 'implementation', 'programming']) OR " + " OR ".join(f"regexp_matches(c, {sql_text(p)})" for p in V.CODE_MARKS))
def f13(spark: SparkSession, sf: str) -> DataFrame:
    m = coded_memories(spark, sf)
    return m.where(P.code_related(F.col("memory_type"), F.col("tags"), F.regexp_replace("content", r"[^\x00-\x7F]", "."))).select("id")


@query("a14_themes", _ALL + ", c AS (" + " UNION ALL ".join(f"SELECT {sql_text(k)} AS theme, " + " + ".join(f"len(regexp_extract_all(content, {sql_text('(?i)' + p)}))" for p in ps) + " AS n FROM cm" for k, ps in {**V.ARCHITECTURE_THEMES, "naming consistency": V.REVIEW_THEMES["naming consistency"]}.items()) + ") SELECT theme, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY theme HAVING sum(n) >= 2")
def a14(spark: SparkSession, sf: str) -> DataFrame:
    t = coded_memories(spark, sf).select(F.col("content").alias("text"))
    return P.themes(t, {**V.ARCHITECTURE_THEMES, "naming consistency": V.REVIEW_THEMES["naming consistency"]})


@query("x36_avoided", "SELECT * FROM (VALUES (1, 'We avoid global state at all cost'), (2, 'never use mocks here please'), (4, 'Forgot it')) t(id, sentence)")
def x36(spark: SparkSession, sf: str) -> DataFrame:
    """Of sentences of which it is known: too short ones, ones that begin alike and neutral ones don't count."""
    rows = [(1, "We avoid global state at all cost. Fine!", [], ""), (2, "I hate it\nnever use mocks here please", [], ""), (3, "we avoid global state at all cost", [], ""), (4, "All is well", ["mistake"], "Forgot it")]
    return P.avoided(spark.createDataFrame(rows, "id int, content string, tags array<string>, l3 string")).select("id", "sentence")


@query("a13_libraries", f"WITH p AS (SELECT page_id, list_distinct(list_filter(list_transform(regexp_extract_all(html, '(?:from|import)\\s+([\\w.]+)', 1), lambda x: replace(lower(string_split(x, '.')[1]), '-', '_')), lambda x: length(x) > 1)) AS l FROM pages), u AS (SELECT unnest(l) AS library FROM p) SELECT library, count(*) AS frequency FROM u GROUP BY library ORDER BY frequency DESC, library LIMIT 30")
def a13_libraries(spark: SparkSession, sf: str) -> DataFrame:
    """Libraries that pages seem to import; no page installs or requires any."""
    m = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"), F.lit("code").alias("memory_type"))
    return P.library_frequency(m).select("library", "frequency")


@query("p20_profile")
def p20(spark: SparkSession, sf: str) -> DataFrame:
    """All sections; the tests hold them against written-out cases."""
    return P.build(coded_memories(spark, sf))


#: What people say of themselves, and the cards that it makes, written out by hand: kind, attribute, value, open.
_SAID = [
    ("[user]: I prefer dark roast, always. My bike color is deep red.", [("preference", "dark_roast", "dark roast", True), ("fact", "bike_color", "deep red", False)]),
    ("My bike color is green!", [("fact", "bike_color", "green!", True)]),
    ("User has tried 120 soups. I own it.", [("preference", "tried_120_soups", "tried 120 soups", True), ("fact", "soups", "120", True)]),
    ("User works at Globex", [("fact", "globex", "Globex", True)]),
]


@query("x39_fact_cards", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {sql_text(k)}, {sql_text(a)}, {sql_text(v)}, {str(o).lower()})" for i, (_, cs) in enumerate(_SAID) for k, a, v, o in cs) + ") t(id, kind, attribute, value, open)")
def x39(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_SAID)], "id int, text string").withColumn("at", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(days=F.col("id")))
    return C.with_history(C.extract(d)).select("id", "kind", "attribute", "value", F.col("valid_until").isNull().alias("open"))


@query("x39_cards_of_texts")
def x39_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of the whole corpus."""
    m = memories(spark, sf).select("id", F.col("content").alias("text"), F.col("created_at").alias("at"))
    return C.with_history(C.extract(m)).select("id", "seq", "kind", "attribute", "value", F.col("valid_until").isNull().alias("open"))


_TASKS = "t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'open' ELSE 'blocked' END AS status, [o_orderkey - 1, o_orderkey + 1] AS b FROM orders), d AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 1)"


@query(
    "d10_completed",
    f"WITH {_TASKS}, x AS (SELECT id, unnest(b) AS u FROM t WHERE status = 'blocked'), l AS (SELECT x.id, count(d.id) AS freed, list_sort(list(x.u) FILTER (d.id IS NULL)) AS rest FROM x LEFT JOIN d ON x.u = d.id GROUP BY x.id) SELECT t.id, CASE WHEN d.id IS NOT NULL THEN 'done' WHEN coalesce(freed, 0) > 0 AND len(coalesce(rest, [])) = 0 THEN 'open' ELSE status END AS status, array_to_string(CASE WHEN coalesce(freed, 0) > 0 THEN coalesce(rest, []) ELSE b END, ',') AS blocked_by FROM t LEFT JOIN d ON t.id = d.id LEFT JOIN l ON t.id = l.id",
)
def d10_completed(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "open").otherwise("blocked")
    k = F.col("o_orderkey")
    tasks = o.select(k.alias("id"), status.alias("status"), F.array(k - 1, k + 1).alias("blocked_by"))
    return B.complete(tasks, o.where(k % 3 == 1).select(k.alias("id"))).select("id", "status", F.array_join(F.transform("blocked_by", lambda x: x.cast("string")), ",").alias("blocked_by"))


@query("d10_claims", "SELECT user_id AS task_id, 'a' || arg_min(event_id % 5, event_id) AS agent, count(*) - 1 AS failed FROM events WHERE event_type = 'click' GROUP BY user_id")
def d10_claims(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'click'")
    return B.claims(e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("agent")))


@query("r15_touched", _M + ", a AS (SELECT user_id AS id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id) SELECT m.id, CAST(access_count + coalesce(n, 0) AS INT) AS access_count, strftime(greatest(last_accessed, last), '%Y-%m-%d %H:%M:%S') AS last_accessed FROM memories m LEFT JOIN a ON m.id = a.id")
def r15(spark: SparkSession, sf: str) -> DataFrame:
    log = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return Q.touched(memories(spark, sf), log).select("id", "access_count", stamp("last_accessed").alias("last_accessed"))


@query("st8_reflection_cursor", "SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_id <= 1000)")
def st8(spark: SparkSession, sf: str) -> DataFrame:
    """What came after the cursor that a first round over the events up to 1,000 left."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    _, after = W.since(e.where("event_id <= 1000"), -1, "event_id")
    return W.since(e, after(), "event_id")[0]


_NO_TOPIC = "[" + ", ".join(map(sql_text, sorted(set(K.STOP_WORDS) | set(K.NO_TOPICS)))) + "]"
#: Look-behinds stand as what must come before a run of names.
CONTEXT_SQL = f"""
cw AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z][a-z0-9]{{2,}}$') AND NOT list_contains({_NO_TOPIC}, w)) AS w FROM texts),
cc AS (SELECT id, w, count(*) AS n, min(i) AS i FROM (SELECT id, unnest(w) AS w, unnest(range(len(w))) AS i FROM cw) GROUP BY id, w),
ct AS (SELECT id, list(w ORDER BY n DESC, i)[1:3] AS t FROM cc GROUP BY id),
cf AS (
  SELECT id, text, regexp_extract_all(text, '((^|[^.!?\n])\\s|\\S)([A-Z][a-z]+(\\s+[A-Z][a-z]+)+)', 3)
    || list_filter(flatten(list_transform(string_split_regex(text, '[.!?\n]+'), lambda s: list_transform(string_split_regex(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ')[2:], lambda w: regexp_replace(w, '[^A-Za-z'']', '', 'g')))),
      lambda w: regexp_matches(w, '^[A-Z].') AND NOT list_contains({_NO_TOPIC}, lower(w))) AS f
  FROM texts
),
cn AS (SELECT id, text, list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i)[1:3] AS n FROM cf),
cp AS (
  SELECT cn.id, text, CASE WHEN len(t) > 0 THEN 'Discussion about ' || array_to_string(t, ', ') || CASE WHEN len(n) > 0 THEN ' involving ' || array_to_string(n, ', ') ELSE '' END || '.'
    WHEN len(n) > 0 THEN 'Mentions ' || array_to_string(n, ', ') || '.' ELSE '' END AS prefix
  FROM cn LEFT JOIN ct ON cn.id = ct.id
)"""


@query("x5_context_prefix", f"WITH {TEXTS_SQL}, {CONTEXT_SQL} SELECT id, prefix, md5(prefix || CASE WHEN prefix <> '' AND text <> '' THEN ' ' ELSE '' END || text) AS whole_md5 FROM cp WHERE text IS NOT NULL")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    d = texts(spark, sf).where("text IS NOT NULL")
    return d.select("id", prefix(F.col("text")).alias("prefix"), F.md5(with_context("text")).alias("whole_md5"))


@query("p25_previews", _M + "SELECT id, md5(substr(trim(regexp_replace(substr(content, 1, 300), '(?s)<private>(.*?)</private>', '', 'g')), 1, 200)) AS preview_md5, round(priority / 3.0, 4) AS score FROM memories")
def p25(spark: SparkSession, sf: str) -> DataFrame:
    d = O.previews(memories(spark, sf).withColumn("score", F.col("priority") / 3.0))
    return d.select("id", F.md5("content_preview").alias("preview_md5"), "score")


@query("p7_known_answer", "SELECT * FROM (VALUES (0, '4'), (1, 'blue'), (2, 'Oslo'), (3, CAST(NULL AS VARCHAR))) t(id, answer)")
def p7_answer(spark: SparkSession, sf: str) -> DataFrame:
    facts = spark.createDataFrame([("User", "korean_restaurants", "4"), ("User", "color", "blue"), ("alice", "location", "Oslo")], "entity string, attribute string, value string")
    asked = ["How many Korean restaurants have I tried?", "What is my color?", "where did Alice move to", "who knows"]
    return spark.createDataFrame([(i, O.known_answer(facts, q)) for i, q in enumerate(asked)], "id int, answer string")


@query("x32_calendar_answer")
def x32_answer(spark: SparkSession, sf: str) -> DataFrame:
    """Questions about the conversations; the tests hold each kind against written-out answers."""
    c = table(spark, sf, "conversations").withColumn("session_date", hours_after(F.col("conv_id") * 24))
    events = build(c, fillers=False)
    asked = ["how many days between rewh and thtion?", "when did i first rewh thtion", "rewh thtion ndre in January 2024"]
    return spark.createDataFrame([(q, answer(events, q)) for q in asked], "question string, answer string")


@query("p12_event_report")
def p12(spark: SparkSession, sf: str) -> DataFrame:
    e = all_events(spark, sf)
    l3 = summaries(texts(spark, sf)).select("id", "l3")
    return O.event_report(e, l3, "bicycle or van in 2020", datetime(2024, 6, 1)).select("id", F.round("score", 9).alias("score"), F.size("events").alias("n_events"), "l3")


@query("p23_preloaded", f"WITH {MEMORIES_SQL}, {part_sql(['rewh', 'nd'], '_0', 3)}, {part_sql(['thtion'], '_1', 3)} SELECT 'rewh nd' AS topic, id, CAST(rank AS INT) AS rank FROM r_0 UNION ALL SELECT 'thtion', id, CAST(rank AS INT) FROM r_1")
def p23(spark: SparkSession, sf: str) -> DataFrame:
    lib = Q.Library(memories(spark, sf), index_of(spark, sf))
    return O.preloaded(lib, spark.createDataFrame([("rewh nd",), ("thtion",)], "topic string"), datetime(2024, 6, 1))


@query(
    "r12_content_dates",
    "SELECT * FROM (VALUES (-10, '2024-03-15', 'exact'), (-10, '2024-03-01', 'month'), (-15, '2023-05-30', 'exact'), (-15, '2023-05-30', 'exact'), (-15, '2023-06-01', 'exact'), (-15, '2024-01-01', 'month'), (-15, '2019-01-01', 'year')) t(id, date, kind)",
)
def r12(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that texts name: those of the hand-written samples, as the corpus names none."""
    return texts(spark, sf).select("id", F.explode(D.content_dates(F.col("text"))).alias("d")).select("id", F.col("d.date").cast("string").alias("date"), F.col("d.kind").alias("kind"))
