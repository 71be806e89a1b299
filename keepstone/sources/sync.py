"""Memories and notes kept in step: what has changed on which side since they last agreed, and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    """Of a content without the blanks around it, as notes are stripped when they are read."""
    return F.md5(F.regexp_replace(content, r"(?U)^\s+|\s+$", "").cast("binary"))


def sync_plan(base: DataFrame, notes: DataFrame, memories: DataFrame) -> DataFrame:
    """id, note, memory (what each side is since the last sync: same, changed, gone, new, absent), action and digest.

    base: id, digest, as of the last sync; notes and memories: id, digest, modified. Each has an id once. Actions:
    import (note to memory), export (memory to note), delete_note, delete_memory, forget (both gone), agree (both
    changed alike, or new alike), none. Where both sides changed differently the later modification wins, the
    memory in a tie or without times. A change goes before a deletion: what one side changed comes back on the other.
    digest is what both sides have afterwards, null where nothing is left.
    """
    b = base.select("id", F.col("digest").alias("b"), F.lit(True).alias("was"))
    n = notes.select("id", F.col("digest").alias("n"), F.col("modified").alias("n_at"), F.lit(True).alias("has_note"))
    m = memories.select("id", F.col("digest").alias("m"), F.col("modified").alias("m_at"), F.lit(True).alias("has_memory"))
    d = b.join(n, "id", "full").join(m, "id", "full")
    was, has_note, has_memory = (F.coalesce(c, F.lit(False)) for c in ("was", "has_note", "has_memory"))
    state = lambda there, x: F.when(~was, F.when(there, "new").otherwise("absent")).when(~there, "gone").when(x.eqNullSafe(F.col("b")), "same").otherwise("changed")
    d = d.withColumn("note", state(has_note, F.col("n"))).withColumn("memory", state(has_memory, F.col("m")))
    note, memory = F.col("note"), F.col("memory")
    edited = lambda s: s.isin("changed", "new")
    both = edited(note) & edited(memory)
    action = (
        F.when(both & F.col("n").eqNullSafe(F.col("m")), "agree")
        .when(both, F.when(F.coalesce(F.col("n_at") > F.col("m_at"), F.lit(False)), "import").otherwise("export"))
        .when(edited(note), "import")
        .when(edited(memory), "export")
        .when((note == "gone") & (memory == "gone"), "forget")
        .when(note == "gone", "delete_memory")
        .when(memory == "gone", "delete_note")
        .otherwise("none")
    )
    after = F.when(F.col("action") == "import", F.col("n")).when(F.col("action").isin("export", "agree"), F.col("m")).when(F.col("action") == "none", F.col("b"))
    return d.withColumn("action", action).select("id", "note", "memory", "action", after.alias("digest"))


def synced(plan: DataFrame) -> DataFrame:
    """The base of the next sync: id and digest of what both sides have after a plan was followed."""
    return plan.where(~F.col("action").isin("delete_note", "delete_memory", "forget")).select("id", "digest")


def apply(plan: DataFrame, notes: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and memories (id, content, modified) after a plan: the same contents under the same ids on both sides."""
    kept = lambda own, gone: own.join(plan.where(F.col("action").isin(*gone)).select("id"), "id", "left_anti")
    moved = lambda own, action: own.join(plan.where(F.col("action") == action).select("id"), "id", "left_semi")
    columns = ["id", "content", "modified"]
    n, m = notes.select(*columns), memories.select(*columns)
    return kept(n, ["export", "delete_note"]).unionByName(moved(m, "export")), kept(m, ["import", "delete_memory"]).unionByName(moved(n, "import"))
