"""Text functions over the documents and hand-written samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.operators.summaries import summaries
from keepstone.plans.data import PLAIN, PLAIN_CASED, TEXTS_SQL, sql_text, texts
from keepstone.plans.registry import query
from keepstone.session import table

_STOP = "[" + ", ".join(map(sql_text, K.STOP_WORDS)) + "]"
_KEY_STOP = "[" + ", ".join(map(sql_text, K.KEY_TERM_STOP_WORDS)) + "]"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z0-9]{{2,}}$') AND NOT list_contains({_STOP}, w))"


def key_terms_sql(text: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]+$') AND NOT list_contains({_KEY_STOP}, w))))"


@query("x1_tokenize", f"WITH {TEXTS_SQL}, t AS (SELECT id, {tokens_sql('text')} AS t FROM texts) SELECT id, CAST(len(t) AS INT) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM t")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf).select("id", T.tokenize(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query(
    "x2_bigrams",
    f"WITH {TEXTS_SQL}, t AS (SELECT id, {tokens_sql('text')} AS t FROM texts) SELECT id, CAST(greatest(len(t) - 1, 0) AS INT) AS n_bigrams, md5(coalesce(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]), ' '), '')) AS bigrams_md5 FROM t",
)
def x2(spark: SparkSession, sf: str) -> DataFrame:
    b = texts(spark, sf).select("id", T.tokenize(F.col("text")).alias("t")).select("id", T.bigrams(F.col("t")).alias("b"))
    return b.select("id", F.size("b").alias("n_bigrams"), F.md5(F.array_join("b", " ")).alias("bigrams_md5"))


def sentences_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(trim({text}), '([.!?])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query("x7_sentences", f"WITH {TEXTS_SQL}, s AS (SELECT id, {sentences_sql('text')} AS s FROM texts) SELECT id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM s")
def x7(spark: SparkSession, sf: str) -> DataFrame:
    s = texts(spark, sf).select("id", T.sentences(F.col("text")).alias("s"))
    return s.select("id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


SUMMARY_SQL = f"""
s AS (SELECT id, unnest({sentences_sql('text')}) AS sentence, unnest(range(0, len({sentences_sql('text')}))) AS pos FROM texts),
w AS (SELECT id, pos, unnest({tokens_sql('sentence')}) AS w FROM s),
f AS (SELECT id, pos, count(*) OVER (PARTITION BY id, w) AS f FROM w),
m AS (SELECT id, pos, CAST(sum(f) AS DOUBLE) / count(*) AS score FROM f GROUP BY id, pos),
r AS (
  SELECT s.id, s.pos, s.sentence, count(*) OVER (PARTITION BY s.id) AS n, row_number() OVER (PARTITION BY s.id ORDER BY coalesce(m.score, 0) DESC, s.pos) AS r
  FROM s LEFT JOIN m ON s.id = m.id AND s.pos = m.pos
),
summary AS (
  SELECT id, substr(max(sentence) FILTER (r = 1), 1, 200) AS l3, list(sentence ORDER BY pos) FILTER (n <= 2 OR r <= least(5, greatest(1, n // 3))) AS l2 FROM r GROUP BY id
)"""


@query("x8_abstract", f"WITH {TEXTS_SQL}, {SUMMARY_SQL} SELECT t.id, coalesce(s.l3, substr(t.text, 1, 200)) AS l3 FROM texts t LEFT JOIN summary s ON t.id = s.id")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(texts(spark, sf)).select("id", "l3")


@query("x9_key_sentences", f"WITH {TEXTS_SQL}, {SUMMARY_SQL} SELECT t.id, CAST(coalesce(len(s.l2), 0) AS INT) AS n_facts, md5(coalesce(array_to_string(s.l2, '|'), '')) AS facts_md5 FROM texts t LEFT JOIN summary s ON t.id = s.id")
def x9(spark: SparkSession, sf: str) -> DataFrame:
    return summaries(texts(spark, sf)).select("id", F.size("l2").alias("n_facts"), F.md5(F.array_join("l2", "|")).alias("facts_md5"))


@query("x11_estimate_tokens", f"WITH {TEXTS_SQL} SELECT id, CAST(greatest(1, length(text) // 4) AS INT) AS n_tokens FROM texts")
def x11(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", T.estimate_tokens(F.col("text")).alias("n_tokens"))


def hits_sql(column: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({column}, {sql_text(p)}) AS INT)" for p in patterns) + ")"


_SCORES = ", ".join(f"{hits_sql('p', ps)} AS s_{name}" for name, ps in K.TYPE_PATTERNS.items())
_BEST = "greatest(" + ", ".join(f"s_{n}" for n in K.TYPE_PATTERNS) + ")"
_PICK = "CASE " + " ".join(f"WHEN s_{n} = {_BEST} AND s_{n} > 0 THEN '{n}'" for n in K.TYPE_PATTERNS) + " ELSE 'general' END"


@query("x12_memory_type", f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN} AS p FROM texts), s AS (SELECT id, {_SCORES} FROM p) SELECT id, {_PICK} AS memory_type FROM s")
def x12(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", T.memory_type(F.col("text")).alias("memory_type"))


@query(
    "x13_staleness",
    f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN} AS p FROM texts), s AS (SELECT id, {hits_sql('p', K.VOLATILE_PATTERNS)} AS v, {hits_sql('p', K.SEMI_STABLE_PATTERNS)} AS m FROM p) SELECT id, CASE WHEN v >= 2 THEN 'volatile' WHEN m >= 2 OR v >= 1 THEN 'semi-stable' ELSE 'stable' END AS staleness FROM s",
)
def x13(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", T.staleness_class(F.col("text")).alias("staleness"))


_TOPICS = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), {sql_text(k)})" for k in ks) + f" THEN '{t}' END" for t, ks in K.TOPIC_KEYWORDS.items()) + "]"


@query("x14_topic_tags", f"WITH {TEXTS_SQL} SELECT id, coalesce(array_to_string(list_filter({_TOPICS}, lambda t: t IS NOT NULL)[1:5], ','), '') AS tags FROM texts")
def x14(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", F.array_join(T.topic_tags(F.col("text")), ",").alias("tags"))


_PII: dict[str, list[str]] = {}
for _c, _, _p in K.SENSITIVE_PATTERNS:
    _PII.setdefault(_c, []).append(_p)


def count_sql(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {sql_text(pattern)}))"


@query("x16_sensitive_counts", f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN_CASED} AS p FROM texts) SELECT id, " + ", ".join("CAST(" + " + ".join(count_sql("p", p) for p in ps) + f" AS INT) AS n_{c}" for c, ps in _PII.items()) + " FROM p")
def x16(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", *[c.cast("int").alias(f"n_{k}") for k, c in T.sensitive_counts(F.col("text")).items()])


_REDACTED = PLAIN_CASED
for _c, _, _p in K.SENSITIVE_PATTERNS:
    _REDACTED = f"regexp_replace({_REDACTED}, {sql_text(_p)}, '[{_c.upper()}_REDACTED]', 'g')"


@query("x17_redact", f"WITH {TEXTS_SQL}, r AS (SELECT id, text, {_REDACTED} AS r FROM texts) SELECT id, CAST(length(r) AS INT) AS n_chars, CAST(len(regexp_extract_all(r, '_REDACTED\\]')) AS INT) AS n_marks FROM r")
def x17(spark: SparkSession, sf: str) -> DataFrame:
    r = texts(spark, sf).select("id", T.redact_sensitive(F.col("text")).alias("r"))
    return r.select("id", F.length("r").alias("n_chars"), F.regexp_count("r", F.lit(r"_REDACTED\]")).alias("n_marks"))


@query("a19_sensitive_summary", f"WITH {TEXTS_SQL}, p AS (SELECT id, {PLAIN_CASED} AS p FROM texts), c AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS category, " + " + ".join(count_sql("p", p) for p in ps) + " AS n FROM p" for c, ps in _PII.items()) + ") SELECT category, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_matches FROM c WHERE n > 0 GROUP BY category")
def a19(spark: SparkSession, sf: str) -> DataFrame:
    counts = T.sensitive_counts(F.col("text"))
    rows = texts(spark, sf).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), c.alias("n")) for k, c in counts.items()])).alias("c"))
    return rows.where("c.n > 0").groupBy(F.col("c.category").alias("category")).agg(F.count("*").alias("n_texts"), F.sum("c.n").alias("n_matches"))


@query("x18_key_terms", f"WITH {TEXTS_SQL} SELECT id, CAST(len({key_terms_sql('text')}) AS INT) AS n_terms, md5(array_to_string({key_terms_sql('text')}, ' ')) AS terms_md5 FROM texts")
def x18(spark: SparkSession, sf: str) -> DataFrame:
    t = texts(spark, sf).select("id", T.key_terms(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query("f9_private", f"WITH {TEXTS_SQL} SELECT id, md5(trim(regexp_replace(text, '(?s)<private>(.*?)</private>', '', 'g'))) AS stripped_md5, md5(trim(regexp_replace(text, '(?s)<private>(.*?)</private>', '[REDACTED]', 'g'))) AS redacted_md5 FROM texts")
def f9(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", F.md5(T.strip_private(F.col("text"))).alias("stripped_md5"), F.md5(T.strip_private(F.col("text"), "[REDACTED]")).alias("redacted_md5"))


@query("f8_size_guards", f"WITH {TEXTS_SQL} SELECT id, octet_length(encode(text)) <= 1000000 AS fits, length(text) >= 5 AS importable FROM texts")
def f8(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", (F.octet_length("text") <= 1_000_000).alias("fits"), (F.length("text") >= 5).alias("importable"))


_BLANK_WORDS = "string_split_regex(lower(text), '[ \\t\\n\\r\\f]+')"
_WIN = f"list_has_any({_BLANK_WORDS}, [{', '.join(map(sql_text, K.WIN_WORDS))}])"
_LOSS = f"list_has_any({_BLANK_WORDS}, [{', '.join(map(sql_text, K.LOSS_WORDS))}])"


@query("x15_outcome", f"WITH {TEXTS_SQL} SELECT id, CASE WHEN {_LOSS} THEN 'mistake' WHEN {_WIN} THEN 'win' ELSE 'observation' END AS outcome FROM texts")
def x15(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("id", T.outcome(F.col("text")).alias("outcome"))


@query("x34_week_bucket", "SELECT event_id, strftime(ts, '%Y-W%W') AS week FROM events")
def x34(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.week_bucket(F.col("ts")).alias("week"))


_FILLER = " OR ".join(f"starts_with(lower(s), {sql_text(f)})" for f in K.FILLERS)


@query("f14_meaningful_sentence", f"WITH {TEXTS_SQL}, s AS (SELECT id, unnest({sentences_sql('text')}) AS s FROM texts) SELECT id, count(*) AS n FROM s WHERE length(s) >= 15 AND len(regexp_extract_all(s, '[^ \\t\\n\\r\\f]+')) >= 4 AND NOT ({_FILLER}) GROUP BY id")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    s = texts(spark, sf).select("id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return s.where(T.meaningful(F.col("s"))).groupBy("id").agg(F.count("*").alias("n"))
