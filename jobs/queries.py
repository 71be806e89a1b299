"""The jobs as queries: each runs twice into a new folder and gives all that it has written, and the SQL that this must equal."""

from __future__ import annotations

import json
import pathlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import intake, rollup
from keepstone.functions import constants as K
from keepstone.operators.store import shared_dir
from keepstone.plans.q_text import _PICK, _SCORES, _TOPICS, hits_sql, sentences_sql
from keepstone.plans.q_text import _REDACTED as REDACTED_SQL

HERE = pathlib.Path(__file__).parent


def shipped(name: str) -> dict:
    return json.loads((HERE / f"{name}.json").read_text())


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken into a store; the second run finds nothing new."""
    at = new_folder(spark, "intake")
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/documents.parquet*", f"{at}/store", f"{at}/checkpoint", shipped("intake"))
    return intake.store(spark, f"{at}/store")


JOB1_SQL = f"""
WITH d AS (SELECT doc_id, lang, source, text AS given, trim(regexp_replace(text, '(?s)<private>(.*?)</private>', '', 'g')) AS text FROM documents),
g AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'no id' WHEN coalesce(length(text) < 5, true) THEN 'short' WHEN octet_length(encode(text)) > 1000000 THEN 'large' END AS reason FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth, min(doc_id) OVER (PARTITION BY text) AS memory_id FROM g WHERE reason IS NULL),
m AS (SELECT doc_id, lang, source, {REDACTED_SQL} AS text FROM r WHERE nth = 1),
p AS (SELECT *, lower(text) AS p FROM m),
s AS (SELECT *, {_SCORES}, {hits_sql('p', K.VOLATILE_PATTERNS)} AS v, {hits_sql('p', K.SEMI_STABLE_PATTERNS)} AS mid, len({sentences_sql('text')}) AS ns FROM p)
SELECT doc_id, 'stored' AS outcome, doc_id AS memory_id, lang AS namespace, source, {_PICK} AS memory_type,
  CASE WHEN v >= 2 THEN 'volatile' WHEN mid >= 2 OR v >= 1 THEN 'semi-stable' ELSE 'stable' END AS staleness,
  CAST(greatest(1, length(text) // 4) AS INT) AS n_tokens, CAST(len(regexp_extract_all(text, '_REDACTED\\]')) AS INT) AS n_marks,
  coalesce(array_to_string(list_filter({_TOPICS}, lambda t: t IS NOT NULL)[1:5], ','), '') AS tags,
  CAST(CASE WHEN ns = 0 THEN 1 WHEN ns <= 2 THEN ns ELSE least(5, greatest(1, ns // 3)) END AS INT) AS n_facts, CAST(length(text) AS INT) AS n_chars
FROM s
UNION ALL SELECT doc_id, 'copy', memory_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE nth > 1
UNION ALL SELECT doc_id, reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE reason IS NOT NULL
"""


def job2_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and facts of all events; the second run finds nothing above the mark."""
    at = new_folder(spark, "rollup")
    for _ in range(2):
        rollup.run(spark, f"{sf_dir}/events.parquet", at, shipped("rollup"))
    return rollup.tables(spark, at)


JOB2_SQL = """
WITH e AS (SELECT event_id, user_id, event_type AS attribute, ts AS t0, CAST(ts AS DATE) AS day, CAST(floor(value / 25) AS BIGINT) AS v FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
o AS (
  SELECT *, CASE WHEN epoch(t0) - epoch(lag(t0) OVER w) <= 1800 THEN 0 ELSE 1 END AS starts,
    CASE WHEN row_number() OVER w > 1 AND v IS DISTINCT FROM lag(v) OVER w THEN 1 ELSE 0 END AS changed,
    CASE WHEN row_number() OVER a > 1 AND v IS DISTINCT FROM lag(v) OVER a THEN 1 ELSE 0 END AS changed_ever
  FROM e WINDOW w AS (PARTITION BY day, user_id, attribute ORDER BY t0, event_id), a AS (PARTITION BY user_id, attribute ORDER BY t0, event_id)
)
SELECT 'day' AS kind, day, user_id, attribute, count(*) AS n, CAST(sum(starts) AS BIGINT) AS sessions, CAST(sum(changed) AS BIGINT) AS changes, arg_max(v, (t0, event_id)) AS value, min(t0) AS first_at, max(t0) AS last_at FROM o GROUP BY day, user_id, attribute
UNION ALL
SELECT 'fact', NULL, user_id, attribute, count(*), CAST(sum(starts) AS BIGINT), CAST(sum(changed_ever) AS BIGINT), arg_max(v, (t0, event_id)), min(t0), max(t0) FROM o GROUP BY user_id, attribute
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_intake": job1_intake, "job2_rollup": job2_rollup}


def oracle_sql() -> dict[str, str]:
    return {"job1_intake": JOB1_SQL, "job2_rollup": JOB2_SQL}
