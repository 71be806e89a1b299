"""Reports: sessions, observations, events found, what to load ahead, and answers from known facts."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.functions import constants as K
from keepstone.functions import text as T
from keepstone.operators import events as V
from keepstone.operators import search as Q
from keepstone.operators.summaries import summaries


def session_category(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.lit("learned")
    for name, words in reversed(K.SESSION_CATEGORIES.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), name).otherwise(out)
    return out


def session_sentences(memories: DataFrame) -> DataFrame:
    """session, category and sentence: the distinct sentences of abstracts and facts of (session, l3, l2)."""
    parts = memories.select("session", F.explode(F.concat(F.array("l3"), "l2")).alias("part"))
    s = parts.select("session", F.explode(T.sentences(F.col("part"))).alias("sentence"))
    return s.select("session", session_category(F.col("sentence")).alias("category"), "sentence").distinct()


def session_summaries(memories: DataFrame) -> DataFrame:
    """session and summary: the abstract of all abstracts of (session, id, l3) in the order of ids."""
    told = memories.where("l3 <> ''").groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "l3"))), lambda x: x["l3"]), ". ").alias("text"))  # of one session
    return summaries(told.withColumnRenamed("session", "id")).select(F.col("id").alias("session"), F.col("l3").alias("summary"))


def observed_facts(texts: DataFrame) -> DataFrame:
    """id, line, attribute, value and expression of each observation in the lines of (id, text).

    A count, else a change, else what a user does makes a fact; unless it was one of the first two, a line that names a time is
    an event with that expression as well.
    """
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    d = lines.select("id", "line", F.regexp_replace(F.btrim("raw", F.lit(" \t\r\f")), r"^[\-•* ]+", "").alias("l")).where(F.length("l") >= 10)
    part = lambda p, g: F.trim(F.regexp_extract("l", p, g))
    key = lambda c, n: F.substring(F.translate(F.lower(F.trim(c)), " ", "_"), 1, n)
    is_count, is_change, is_user, is_time = (F.col("l").rlike(p) for p in (K.OBSERVED_COUNT, K.OBSERVED_CHANGE, K.OBSERVED_USER, K.OBSERVED_TIME))
    fact = lambda attribute, value, expression=F.lit(None).cast("string"): F.struct(attribute.alias("attribute"), value.alias("value"), expression.alias("expression"))
    about = key(F.regexp_replace(F.substring("l", 1, 30), r"\b(from|to|the|a|an)\b", ""), 30)
    first = (
        F.when(is_count, fact(key(part(K.OBSERVED_COUNT, 2), 40), part(K.OBSERVED_COUNT, 1)))
        .when(is_change, fact(about, part(K.OBSERVED_CHANGE, 2)))
        .when(is_user, fact(F.lower(F.regexp_extract("l", r"[Uu]ser\s+(\w+)", 1)), F.substring(part(K.OBSERVED_USER, 1), 1, 60)))
    )
    event = F.when(~is_count & ~is_change & is_time, fact(F.lit("event"), F.substring("l", 1, 80), F.regexp_extract("l", K.OBSERVED_TIME, 0)))
    return d.select("id", "line", F.explode(F.array_compact(F.array(first, event))).alias("f")).select("id", "line", "f.attribute", "f.value", "f.expression")


def event_report(events: DataFrame, abstracts: DataFrame, query: str, now: datetime, limit: int = 20) -> DataFrame:
    """id, score, l3 and the events of the memories that an event search finds; abstracts: id, l3."""
    hits = V.search_events(events, query, now.date(), limit)
    told = events.join(F.broadcast(hits.select("id")), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "subject", "verb", "object", "event_date"))).alias("events"))  # of a memory, and limit of them
    return hits.join(told, "id").join(abstracts.select("id", "l3"), "id", "left").withColumn("l3", F.coalesce("l3", F.lit("")))


def preloaded(library: Q.Library, predictions: DataFrame, now: datetime, each: int = 3) -> DataFrame:
    """topic, id and rank: the first answers to each of a few predicted topics (topic)."""
    out = None
    for r in predictions.select("topic").collect():  # a handful of predictions
        found = Q.answer(library, r["topic"], now, each).select(F.lit(r["topic"]).alias("topic"), "id", "rank")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else predictions.sparkSession.createDataFrame([], "topic string, id long, rank int")


def context_hint(topics: list[str]) -> str:
    """What a user is busy with: up to three of the last five topics, the newest first."""
    recent = list(dict.fromkeys(reversed(topics[-5:])))[:3]
    return f"User is currently focused on: {', '.join(recent)}" if recent else ""


def previews(results: DataFrame) -> DataFrame:
    """Results as they are handed out: scores to four places, and 200 characters of the first 300 without private spans."""
    shown = F.substring(T.strip_private(F.substring("content", 1, 300)), 1, 200)
    return results.withColumn("content_preview", shown).withColumn("score", F.round("score", 4))


def known_answer(facts: DataFrame, query: str) -> str | None:
    """The current value that a question asks for: how many of something, what somebody's own is, or where somebody moved. facts: open ones (entity, attribute, value)."""
    q = query.lower()
    attribute = F.lower("attribute")
    user = F.lower("entity") == "user"

    def first(d: DataFrame) -> str | None:
        found = d.orderBy("attribute").select(F.col("value").cast("string").alias("v")).limit(1).collect()
        return found[0]["v"] if found else None

    if m := re.search(r"how many\s+(.+?)(?:\s+(?:have|did|do)\s+i|\?)", q):
        topic = F.lit(m[1].strip().replace(" ", "_"))
        if found := first(facts.where(user & (F.contains(attribute, topic) | F.contains(topic, attribute)))):
            return found
    if m := re.search(r"what (?:is|are) my\s+(.+?)[?]", q):
        if found := first(facts.where(user & (attribute == m[1].strip().replace(" ", "_")))):
            return found
    if m := re.search(r"where did\s+(\w+)\s+move", q):
        return first(facts.where((F.lower("entity") == m[1]) & (attribute == "location")))
    return None
