"""Differences between times, activity by period, and facts that newer ones supersede."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions import text as T


def period(ts: Column, granularity: str) -> Column:
    return T.week_bucket(ts) if granularity == "week" else F.date_format(ts, "yyyy-MM" if granularity == "month" else "yyyy-MM-dd")


def timeline(created: DataFrame, modified: DataFrame, deleted: DataFrame, granularity: str = "day", top: int = 5) -> DataFrame:
    """period, added, modified, deleted and the most frequent tags of what was added.

    Each input has ts; created has tags too. Counts are summed by period in one aggregation of
    three kinds of rows; tags are counted before the few best of each period are picked.
    """
    kinds = None
    for name, d in (("added", created), ("modified", modified), ("deleted", deleted)):
        rows = d.select(period(F.col("ts"), granularity).alias("period"), F.lit(name).alias("kind"))
        kinds = rows if kinds is None else kinds.unionByName(rows)
    counts = kinds.groupBy("period").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")])
    tags = created.select(period(F.col("ts"), granularity).alias("period"), F.explode("tags").alias("tag")).groupBy("period", "tag").agg(F.count("*").alias("n"))
    best = tags.withColumn("r", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "tag"))).where(F.col("r") <= top)
    best = best.groupBy("period").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("top_tags"))
    return counts.join(best, "period", "left")


def diff(memories: DataFrame, versions: DataFrame, deletions: DataFrame, since: Column, until: Column) -> DataFrame:
    """id and change (new, updated, deleted) within the closed interval; a row created in it isn't an update."""
    new = memories.where(F.col("created_at").between(since, until)).select("id", F.lit("new").alias("change"))
    upd = memories.where(F.col("updated_at").between(since, until) & ~F.col("created_at").between(since, until)).select("id", F.lit("updated").alias("change"))
    gone = deletions.where(F.col("ts").between(since, until)).select("id", F.lit("deleted").alias("change")).distinct()
    return new.unionByName(upd).unionByName(gone)


def rendered(changes: DataFrame, form: str = "text") -> DataFrame:
    """id and line of (id, change): + for new, ~ for updated and - for deleted rows, or JSON objects."""
    if form == "json":
        return changes.select("id", F.to_json(F.struct("id", "change")).alias("line"))
    mark = F.when(F.col("change") == "new", "+").when(F.col("change") == "updated", "~").otherwise("-")
    return changes.select("id", F.concat(mark, F.lit(" "), F.col("id").cast("string")).alias("line"))


def tag_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """added and removed: sorted distinct tags that only one side has. Sets of tags are aggregated by tag, not gathered."""
    a = before.select(F.explode("tags").alias("tag")).distinct().withColumn("old", F.lit(True))
    b = after.select(F.explode("tags").alias("tag")).distinct().withColumn("new", F.lit(True))
    return a.join(b, "tag", "full_outer").where("old IS NULL OR new IS NULL").select("tag", F.when(F.col("old").isNull(), "added").otherwise("removed").alias("change"))


def supersede(facts: DataFrame, entity: str = "entity", attribute: str = "attribute", value: str = "value", at: str = "at", order: str = "seq") -> DataFrame:
    """Facts with valid_until: the time of the next fact of the same entity and attribute (both without case) with another value.

    Repeats of a value stay open together until the value changes.
    """
    key = [F.lower(F.col(entity).cast("string")), F.lower(F.col(attribute).cast("string"))]
    w = Window.partitionBy(*key).orderBy(at, order)
    v = F.lower(F.col(value).cast("string"))
    d = facts.withColumn("_change", F.coalesce((F.lag(v).over(w) != v).cast("int"), F.lit(0)))
    # backwards, so that what has been seen grows by one row at a time
    later = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn("valid_until", F.last(F.when(F.col("_change") == 1, F.col(at)), ignorenulls=True).over(later)).drop("_change")


def current_facts(facts: DataFrame, entity: str = "entity", attribute: str = "attribute") -> DataFrame:
    """The last open fact of each entity and attribute."""
    w = Window.partitionBy(entity, attribute).orderBy(F.desc("at"), F.desc("seq"))
    return facts.where("valid_until IS NULL").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fact_changes(facts: DataFrame) -> DataFrame:
    """entity, attribute, old, new, at: closed facts with the open fact that took their place at that time."""
    new = facts.where("valid_until IS NULL").select("entity", "attribute", F.col("value").alias("new"), F.col("at").alias("valid_until"), "seq")
    new = new.groupBy("entity", "attribute", "valid_until").agg(F.min_by("new", "seq").alias("new"))
    return facts.where("valid_until IS NOT NULL").join(new, ["entity", "attribute", "valid_until"]).select("entity", "attribute", F.col("value").alias("old"), "new", F.col("valid_until").alias("at"))


def infer(facts: DataFrame, relations: DataFrame, entity: str, attribute: str, max_hops: int = 2) -> DataFrame:
    """The attribute of an entity, else of those related to it: the fewest hops first, then by name. One row or none.

    facts: entity, attribute, value (open ones); relations: source, target.
    """
    f = facts.where(F.col("attribute") == attribute).select("entity", "value")
    e = relations.select(F.col("source").alias("x"), F.col("target").alias("y")).union(relations.select("target", "source")).distinct()
    reached = None
    at = facts.sparkSession.createDataFrame([(entity, 0)], "entity string, hops int")
    seen = at
    for hop in range(1, max_hops + 1):
        at = at.join(e, at["entity"] == e["x"]).select(F.col("y").alias("entity"), F.lit(hop).alias("hops")).distinct().join(seen.select("entity"), "entity", "left_anti")
        seen = seen.unionByName(at)
    reached = seen
    return reached.join(f, "entity").orderBy("hops", "entity").limit(1).select("entity", "hops", "value")
