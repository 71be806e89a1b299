"""Boards of tasks, handoffs and decisions, from their change rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_states(changes: DataFrame) -> DataFrame:
    """task_id, status and steps: the last change (by seq) of each task."""
    return changes.groupBy("task_id").agg(F.max_by("status", "seq").alias("status"), F.count("*").alias("steps"))


def claims(changes: DataFrame) -> DataFrame:
    """The first agent that claimed each task (task_id, seq, agent) is its owner; later claims fail."""
    return changes.groupBy("task_id").agg(F.min_by("agent", "seq").alias("agent"), (F.count("*") - 1).alias("failed"))


def blocked(tasks: DataFrame, done: str = "completed") -> DataFrame:
    """id, blocker and blocker_status for blockers of (id, status, blocked_by) that aren't done."""
    b = tasks.select(F.col("id").alias("blocker"), F.col("status").alias("blocker_status"))
    return tasks.select("id", F.explode("blocked_by").alias("blocker")).join(b, "blocker").where(F.col("blocker_status") != done)


def visible_handoffs(handoffs: DataFrame, agent: str) -> DataFrame:
    """Those to everybody or to the agent."""
    return handoffs.where(F.col("to_agent").isNull() | (F.col("to_agent") == agent))


def complete(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """tasks (id, status, blocked_by) after those of (id) ``done`` are completed: they are done, and tasks that nothing blocks any more are open."""
    finished = done.select("id").distinct().withColumn("finished", F.lit(True))
    waits = tasks.where(F.col("status") == "blocked").select("id", F.explode("blocked_by").alias("by"))
    left = waits.join(finished.toDF("by", "gone"), "by", "left").groupBy("id").agg(F.count_if("gone").alias("freed"), F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.col("by")))).alias("left"))
    d = tasks.join(finished, "id", "left").join(left, "id", "left")
    freed = F.coalesce(F.col("freed"), F.lit(0)) > 0
    status = F.when(F.col("finished"), "done").when(freed & (F.size("left") == 0), "open").otherwise(F.col("status"))
    return d.withColumn("status", status).withColumn("blocked_by", F.when(freed, F.col("left")).otherwise(F.col("blocked_by"))).drop("finished", "freed", "left")


def decide(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """tasks with the agent that claimed them first, among open ones; later claims and claims of others are passed over."""
    first = claims(changes).select(F.col("task_id").alias("id"), F.col("agent").alias("claimed_by"))
    d = tasks.join(first, "id", "left")
    free = (F.col("status") == "open") & F.col("claimed_by").isNotNull()
    return d.withColumn("assigned_to", F.when(free, F.col("claimed_by"))).withColumn("status", F.when(free, "claimed").otherwise(F.col("status"))).drop("claimed_by")


def catch_up(name: str, goal: str, members: DataFrame, tasks: DataFrame, decisions: DataFrame, handoffs: DataFrame, token_budget: int = 4000) -> dict:
    """What an agent that joins a workspace late should know, within a budget of tokens.

    The overview (members, tasks, titles of twenty decisions) is always there; details (ten handoffs and decisions) if more than
    200 tokens are left, five handoffs only if they don't fit; ids of memories of fifty handoffs if more than 100 are left.
    members: agent; tasks: id, title, status, assigned_to; decisions: seq, title, rationale, decided_by; handoffs: seq, from_agent, summary, open_questions, memory_ids.
    """
    newest = lambda d, n: d.orderBy(F.desc("seq")).limit(n)
    counts = {r["status"]: r["n"] for r in tasks.groupBy("status").agg(F.count("*").alias("n")).collect()}  # a few states
    decided = [r.asDict() for r in newest(decisions, 20).select("title", "rationale", "decided_by").collect()]
    overview = {
        "workspace": {"name": name, "goal": goal, "members": [r["agent"] for r in members.orderBy("agent").collect()]},
        "task_summary": {"total": sum(counts.values()), **{s: counts.get(s, 0) for s in ("open", "claimed", "done", "blocked")}, "tasks": [r.asDict() for r in tasks.select("id", "title", "status", "assigned_to").orderBy("id").toLocalIterator()]},
        "decision_titles": [d["title"] for d in decided],
    }
    cost = lambda x: max(1, len(json.dumps(x)) // 4)
    left = token_budget - cost(overview)
    details = None
    if left > 200:
        told = [{"from": r["from_agent"], "summary": r["summary"], "open_questions": r["open_questions"]} for r in newest(handoffs, 10).collect()]
        details = {"handoffs": told, "decisions": decided[:10]}
        if cost(details) > left:
            details = {"handoffs": [{k: h[k] for k in ("from", "summary")} for h in told[:5]]}
        left -= cost(details)
    ids = []
    if left > 100:
        ids = [r["id"] for r in newest(handoffs, 50).select(F.explode("memory_ids").alias("id")).distinct().orderBy("id").collect()]
    return {"token_budget": token_budget, "tokens_used": token_budget - left, "overview": overview, "details": details, "memory_ids": ids}
