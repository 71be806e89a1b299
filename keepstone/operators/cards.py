"""Cards of facts that people tell of themselves, and what is looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.functions import profile_values as P
from keepstone.operators.timeline import supersede

#: Characters of a value.
MOST_CHARS = 100


def _forms(text: Column) -> Column:
    """All matches of all forms, in their order: (form, kind, two groups); the second group is null for forms with one."""

    def of(i: int, kind: str, pattern: str) -> Column:
        p = F.lit(f"(?iU){pattern}")
        two = pattern.replace("(?:", "").count("(") == 2
        row = lambda a, b: F.struct(F.lit(i).alias("form"), F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
        first = F.regexp_extract_all(text, p, F.lit(1))
        if two:
            return F.zip_with(first, F.regexp_extract_all(text, p, F.lit(2)), row)
        return F.transform(first, lambda a: row(a, F.lit(None).cast("string")))

    return F.concat(*[of(i, kind, pattern) for i, (kind, pattern) in enumerate(P.CARD_FORMS)])


def extract(texts: DataFrame) -> DataFrame:
    """id, seq, entity, kind, attribute, value, at and confidence of the cards of (id, text, at).

    A count has what is counted as its attribute; "my X is Y" the X; other values their first three words. Values
    of fewer than three characters and mere fillers make no card.
    """
    d = texts.select("id", "at", F.posexplode(_forms(F.regexp_replace("text", P.CARD_ROLES, ""))).alias("seq", "m")).select("id", "at", "seq", "m.kind", "m.a", "m.b")
    count = F.col("b").isNotNull() & F.col("a").rlike(r"^\d+$")
    key = lambda c: F.translate(F.lower(F.trim(c)), " ", "_")
    value = F.when(count, F.col("a")).otherwise(F.trim(F.coalesce("b", "a")))
    d = d.withColumn("value", value).where((F.length("value") >= 3) & ~F.lower("value").isin(P.CARD_NOISE)).withColumn("value", F.substring("value", 1, MOST_CHARS))
    words = F.slice(F.filter(F.split(F.lower("value"), r"\s+"), lambda w: w != ""), 1, 3)
    own = F.array_join(F.filter(words, lambda w: ~w.isin(P.CARD_NOISE)), "_")
    named = F.when(count, key(F.col("b"))).when(F.col("b").isNotNull(), key(F.col("a")))
    d = d.withColumn("attribute", F.coalesce(F.nullif(named, F.lit("")), own)).where("attribute <> ''")
    return d.select("id", "seq", F.lit("User").alias("entity"), "kind", "attribute", "value", "at", F.lit(0.6).alias("confidence"))


def with_history(cards: DataFrame) -> DataFrame:
    """cards with valid_until: a later card of the same entity and attribute with another value takes a card's place."""
    order = cards.withColumn("order", F.struct("id", "seq"))
    return supersede(order, order="order").drop("order")


def lookup(cards: DataFrame, query: str) -> DataFrame:
    """The current card that a query means, or no row.

    The newest of the first attribute whose key has the query in it; else the card with most of the query's words.
    """
    current = cards.where("valid_until IS NULL")
    key = F.concat_ws(".", F.lower("entity"), F.lower("attribute"))
    q = query.lower()
    text = F.lower(F.concat_ws(" ", "entity", "attribute", "value"))
    words = F.array(*[F.lit(w) for w in dict.fromkeys(q.split())])
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    d = current.withColumn("direct", F.contains(key, F.lit(q.replace(" ", "_")))).withColumn("hits", hits)
    first = cards.groupBy(F.lower("entity").alias("e"), F.lower("attribute").alias("a")).agg(F.min(F.struct("at", "id", "seq")).alias("began"))
    d = d.join(first, (F.lower("entity") == F.col("e")) & (F.lower("attribute") == F.col("a"))).where("direct OR hits > 0")
    best = d.orderBy(F.desc("direct"), F.when(F.col("direct"), 0).otherwise(-F.col("hits")), F.when(F.col("direct"), F.col("began")), F.when(F.col("direct"), F.unix_micros(F.col("at").cast("timestamp"))).desc(), "at", "id", "seq")
    return best.limit(1).select("entity", "attribute", "value", "at")


def all_current(cards: DataFrame, entity: str = "", attribute: str = "") -> DataFrame:
    """Current cards whose entity and attribute contain what is given."""
    return cards.where("valid_until IS NULL").where(F.contains(F.lower("entity"), F.lit(entity.lower())) & F.contains(F.lower("attribute"), F.lit(attribute.lower())))


def history(cards: DataFrame, entity: str) -> DataFrame:
    """All cards of an entity or attribute, in time."""
    e = F.lit(entity.lower())
    return cards.where(F.contains(F.lower("entity"), e) | F.contains(F.lower("attribute"), e)).orderBy("at", "id", "seq")


def snapshot(cards: DataFrame) -> str:
    """All current cards as text, by entity and attribute. Cards are streamed to the driver; the text is for a reader."""
    lines, last = ["## Current Knowledge"], None
    for c in cards.where("valid_until IS NULL").orderBy("entity", "attribute", "at", "id", "seq").toLocalIterator():
        if c["entity"] != last:
            last = c["entity"]
            lines.append(f"\n### {last}")
        lines.append(f"- {c['attribute']}: {c['value']}" + (f" [{c['at']:%Y/%m/%d}]" if c["at"] else ""))
    return "\n".join(lines)


def changes(cards: DataFrame, attribute: str = "") -> DataFrame:
    """entity, attribute, old_value, old_date, new_value, new_date of cards that another one took the place of."""
    closed = cards.where("valid_until IS NOT NULL").where(F.contains(F.lower("attribute"), F.lit(attribute.lower())))
    new = cards.groupBy(F.lower("entity").alias("e"), F.lower("attribute").alias("a"), F.col("at").alias("valid_until")).agg(F.min_by("value", F.struct("id", "seq")).alias("new_value"))
    d = closed.withColumn("e", F.lower("entity")).withColumn("a", F.lower("attribute")).join(new, ["e", "a", "valid_until"])
    return d.select("entity", "attribute", F.col("value").alias("old_value"), F.col("at").alias("old_date"), "new_value", F.col("valid_until").alias("new_date"))


def change_history(cards: DataFrame, attribute: str = "") -> str:
    """The changes as text; empty without any."""
    lines = [f"- {c['entity']}.{c['attribute']}: OLD ({c['old_date']:%Y/%m/%d}): {c['old_value']} → CURRENT ({c['new_date']:%Y/%m/%d}): {c['new_value']}" for c in changes(cards, attribute).orderBy("new_date", "entity", "attribute").toLocalIterator()]
    return "\n".join(["## Knowledge Changes Detected", *lines]) if lines else ""
