"""Events in texts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.operators import events as E
from keepstone.plans.data import sql_text
from keepstone.plans.registry import query
from keepstone.session import table

#: The day that relative dates are taken from.
TODAY = date(2024, 6, 1)
#: Texts for each form, and the events in them, written out by hand: kind, subject, verb, object, date, aliases.
TOLD = [
    ("I graduated from Ohio State on May 12, 2019. It was big.", [("action", "user", "graduated", "from Ohio State on May 12", "2019-05-12", "user got degree from Ohio State on May 12|user completed studies from Ohio State on May 12|from Ohio State on May 12 was graduated|graduated from Ohio State on May 12")]),
    ("they launched the new service!", [("action", "they", "launched", "the new service", None, "the new service launched by they|launched the new service")]),
    ("My brother bought a red bicycle in 2020, then went home", [("action", "user", "bought", "a red bicycle in 2020", "2020", "user purchased a red bicycle in 2020|user got a red bicycle in 2020|a red bicycle in 2020 was bought|bought a red bicycle in 2020")]),
    ("We work at Globex since 2021.", [("present_action", "team", "work_at", "Globex since 2021", "2021", "team employed at Globex since 2021|team job at Globex since 2021|Globex since 2021 was work at|work at Globex since 2021")]),
    ("I am a painter, mostly.", [("identity", "user", "is", "painter", None, "painter was is|is painter")]),
    ("We have a lab in the", [("have", "team", "has", "lab in", None, "lab in was has|has lab in")]),
    ("She was an engineer last year.", [("was", "she", "was", "engineer last year", "2023", "engineer last year was by she|was engineer last year")]),
    ("I enjoy long walks", [("preference", "user", "enjoy", "long walks", None, "long walks was enjoy|enjoy long walks")]),
    ("My favorite color is blue.", [("favorite", "user", "favorite_color", "blue", None, "blue was favorite color|favorite color blue")]),
    ("My dog's name is Max.", [("my_is", "user", "has_dog_named", "Max", None, "Max was has dog named|has dog named Max")]),
    ("Allergic to peanuts.", [("allergic", "user", "is_allergic_to", "peanuts", None, "peanuts was is allergic to|is allergic to peanuts")]),
    ("The team agreed to ship on Fridays", [("decision", "team", "agreed", "ship on Fridays", None, "ship on Fridays was agreed|agreed ship on Fridays")]),
    ("He moved to Paris yesterday.", [("action", "he", "moved", "to Paris yesterday", "2024-05-31", "he relocated to Paris yesterday|he went to live in to Paris yesterday|to Paris yesterday moved by he|moved to Paris yesterday")]),
    ("My hamster is named Bo", [("my_is", "user", "hamster", "named Bo", None, "named Bo was hamster|hamster named Bo")]),
    ("I sold it, I bought a van 2021-3-4", [("action", "user", "sold", "it", "2021-3-4", "it was sold|sold it"), ("action", "user", "bought", "a van 2021-3-4", "2021-3-4", "user purchased a van 2021-3-4|user got a van 2021-3-4|a van 2021-3-4 was bought|bought a van 2021-3-4")]),
    # the second sentence's match would begin where the first one's lies
    ("I won gold medals. I lost silver ones.", [("action", "user", "won", "gold medals", None, "gold medals was won|won gold medals")]),
    ("Nothing happened here.", []),
    ("I am.", []),
]
_WANTED = [(-i - 1, n, *e) for i, (_, found) in enumerate(TOLD) for n, e in enumerate(found)]


def told(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-i - 1, t) for i, (t, _) in enumerate(TOLD)], "id long, text string")


def all_events(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract_events(told(spark).unionAll(table(spark, sf, "documents").select("doc_id", "text")), TODAY)


def _row(r: tuple) -> str:
    return "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else sql_text(v) for v in r) + ")"


@query("x28_event_forms", "SELECT * FROM (VALUES " + ", ".join(map(_row, _WANTED)) + ") t(id, seq, kind, subject, verb, object, event_date, aliases)")
def x28_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Each form on texts of which the events are known."""
    e = E.extract_events(told(spark), TODAY)
    return e.select(F.col("id").cast("int").alias("id"), "seq", "kind", "subject", "verb", "object", "event_date", F.array_join("aliases", "|").alias("aliases"))


@query("x28_events")
def x28(spark: SparkSession, sf: str) -> DataFrame:
    return all_events(spark, sf).select("id", "seq", "subject", "verb", "object", "event_date", "confidence")


@query("r6_event_search")
def r6(spark: SparkSession, sf: str) -> DataFrame:
    return E.search_events(all_events(spark, sf), "bicycle or van in 2020", TODAY).select("id", F.round("score", 9).alias("score"))
