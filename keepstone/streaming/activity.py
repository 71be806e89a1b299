"""Streams of activity: filtered sources, changes, derived queries and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keepstone.functions import constants as K

# Extensions of files that are watched, and commands that say nothing; fixed values.
WATCHED = ("py", "js", "ts", "tsx", "jsx", "rs", "go", "java", "rb", "c", "cpp", "h", "md", "json", "yaml", "yml", "toml")
NOISE = ("ls", "cd", "pwd", "clear", "exit", "history")


def file_events(events: DataFrame) -> DataFrame:
    """Events (path, ts) of watched files."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return events.where(ext.isin(*WATCHED))


def debounced(events: DataFrame, gap_seconds: float = 1.0) -> DataFrame:
    """Events of a path at least ``gap_seconds`` after the last one that was let through; the state is one time for each path and ends after ten idle minutes of event time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for pdf in parts:
            kept = []
            for t in sorted(pdf["ts"]):
                s = pd.Timestamp(t).timestamp()
                if last is None or s - last >= gap_seconds:
                    kept.append(t)
                    last = s
            if kept:
                yield pd.DataFrame({"path": [key[0]] * len(kept), "ts": kept})
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + 600_000)

    return events.withWatermark("ts", "10 minutes").groupBy("path").applyInPandasWithState(step, "path string, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def repository_changes(polls: DataFrame) -> DataFrame:
    """What polls (repo, ts, head, message, author, branch, diff_stat) of repositories tell: a new head, another branch, other changed files.

    repo, ts, type (git_commit, git_branch, git_diff), old, new, changed_files. What a repository is first seen with tells nothing; an
    empty branch or statistics leave what was known. The state is three texts a repository.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = list(state.get) if state.exists else [None, None, None]
        for pdf in parts:
            out = []
            for r in pdf.sort_values("ts").itertuples():
                for i, (kind, now) in enumerate((("git_commit", r.head), ("git_branch", r.branch), ("git_diff", r.diff_stat))):
                    if not now or now == known[i]:
                        continue
                    files = [x for line in now.split("\n") if "|" in line and (x := line.split("|")[0].strip())] if i == 2 else []
                    if known[i] is not None and (i < 2 or files):
                        out.append((key[0], r.ts, kind, known[i][:500], r.message if i == 0 else now[:500], files))
                    known[i] = now
            if out:
                yield pd.DataFrame(out, columns=["repo", "ts", "type", "old", "new", "changed_files"])
        state.update(tuple(known))

    return polls.groupBy("repo").applyInPandasWithState(step, "repo string, ts timestamp, type string, old string, new string, changed_files array<string>", "head string, branch string, diff_stat string", "append", GroupStateTimeout.NoTimeout)


def head_changes(polls: DataFrame) -> DataFrame:
    """Polls (repo, ts, head) whose head differs from the one before; a repository's first is left out."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in parts:
            out = []
            for _, r in pdf.sort_values("ts").iterrows():
                if last is not None and r["head"] != last:
                    out.append((key[0], r["ts"], last, r["head"]))
                last = r["head"]
            if out:
                yield pd.DataFrame(out, columns=["repo", "ts", "old", "new"])
        if last is not None:
            state.update((last,))

    return polls.groupBy("repo").applyInPandasWithState(step, "repo string, ts timestamp, old string, new string", "head string", "append", GroupStateTimeout.NoTimeout)


def shell_commands(lines: DataFrame) -> DataFrame:
    """command of history lines (value) without time prefixes, noise left out."""
    c = F.trim(F.regexp_replace("value", r"^: \d+:\d+;", ""))
    return lines.select(c.alias("command")).where((F.length("command") > 0) & ~F.regexp_extract("command", r"^(\S+)", 1).isin(*NOISE))


def _project(path: Column) -> Column:
    """The folder in one that holds projects, or the one that has an environment in it; else the first that isn't a home."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    n = F.size(parts)
    inside = F.transform(
        parts,
        lambda p, i: F.when(p.isin(K.PROJECT_PARENTS) & (i + 1 < n), F.get(parts, i + 1)).when(p.isin(K.PROJECT_INSIDES) & (i > 0), F.get(parts, i - 1)),
    )
    plain = F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit(".")) & ~F.contains(p, F.lit(":")))
    fallback = F.when(F.size(plain) >= 2, F.when(F.get(plain, 0).isin(K.PROJECT_HOMES), F.get(plain, 1)).otherwise(F.get(plain, 0)))
    return F.coalesce(F.get(F.array_compact(inside), 0), fallback, F.lit(""))


def _component(path: Column) -> Column:
    """The innermost folder that is a component."""
    folders = F.slice(F.split(F.translate(path, "\\", "/"), "/"), 1, F.greatest(F.size(F.split(F.translate(path, "\\", "/"), "/")) - 1, F.lit(0)))
    own = F.filter(folders, lambda p: (p != "") & ~p.isin(K.NO_COMPONENTS) & ~F.startswith(p, F.lit(".")))
    return F.coalesce(F.translate(F.get(F.reverse(own), 0), "_-", "  "), F.lit(""))


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def derived_queries(batch: DataFrame, most: int = 5) -> DataFrame:
    """place and query: what to look for after a batch of activity (seq, type, path, message, branch, changed_files, command).

    Up to two queries from files (a language, two components and the project of each project, in the order of its first file), two from
    commits, branches and changed files, and one from the terminal; equal ones once, five in all. Only these few leave the aggregation.
    """
    files = batch.where(F.col("type").isin("file_modified", "file_created")).select("seq", _project(F.col("path")).alias("project"), _component(F.col("path")).alias("component"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))
    language = F.element_at(F.create_map(*[F.lit(x) for kv in K.LANGUAGES.items() for x in kv]), F.col("ext"))
    by = files.withColumn("language", language).groupBy("project").agg(F.min("seq").alias("seq"), F.min("language").alias("language"), F.array_sort(F.collect_set(F.nullif(F.col("component"), F.lit("")))).alias("components"))
    told = F.array_join(F.filter(F.array("language", F.array_join(F.slice("components", 1, 2), " "), F.nullif(F.col("project"), F.lit("")), F.lit("patterns")), lambda x: x.isNotNull() & (x != "")), " ")
    of_files = by.select(F.lit(0).alias("kind"), "seq", told.alias("query")).where(F.length("query") > 10).orderBy("seq").limit(2)
    branch = F.translate("branch", "/-_", "   ")
    changed = F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(F.slice("changed_files", 1, 5), lambda p: F.regexp_replace(_file_name(p), r"(?<=.)\.[^.]*$", "")), lambda n: F.length(n) > 2), lambda n: F.translate(n, "_-", "  "))))
    git = F.when((F.col("type") == "git_commit") & (F.length("message") > 5), F.col("message")).when((F.col("type") == "git_branch") & ~F.col("branch").isin(K.MAIN_BRANCHES) & (F.length(branch) > 3), branch).when((F.col("type") == "git_diff") & (F.size(changed) > 0), F.array_join(F.slice(changed, 1, 3), " "))
    of_git = batch.select(F.lit(1).alias("kind"), "seq", git.alias("query")).where("query IS NOT NULL").orderBy("seq").limit(2)
    words = F.filter(F.split("command", r"\s+"), lambda w: w != "")
    rest = F.transform(
        F.filter(F.slice(words, 2, F.size(words)), lambda w: ~F.startswith(w, F.lit("-"))),
        lambda w: F.when(F.startswith(w, F.lit("/")) | F.startswith(w, F.lit("./")), F.when(F.length(_file_name(w)) > 2, _file_name(w))).when((F.length(w) > 2) & ~F.startswith(w, F.lit("{")), w),
    )
    shell = F.when(F.size(words) > 0, F.array_join(F.slice(F.concat(F.array(_file_name(F.get(words, 0))), F.array_compact(rest)), 1, 4), " "))
    of_shell = batch.where(F.col("type") == "terminal_command").select(F.lit(2).alias("kind"), "seq", shell.alias("query")).where("query IS NOT NULL").orderBy("seq").limit(1)
    every = of_files.unionByName(of_git).unionByName(of_shell).withColumn("query", F.trim("query")).where("query <> ''")  # five rows
    first = every.groupBy(F.lower("query").alias("k")).agg(F.min(F.struct("kind", "seq", "query")).alias("x"))
    w = Window.orderBy("x.kind", "x.seq", "x.query")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("place", F.col("x.query").alias("query"))


def per_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str = "3 seconds") -> DataStreamWriter:
    """A query that hands all that came within a trigger to ``handle``."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def unexpired(cache: DataFrame, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """Cached results (id, ts) that are young enough, one for each id, newest first."""
    fresh = cache.where(F.col("ts") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return fresh.groupBy("id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "id")


def cached_stream(results: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """The newest result (id, ts, tokens) of each id, kept as state that ends ``ttl_seconds`` of event time after its last change; id, ts, tokens, expired."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            ts, tokens = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "ts": [pd.Timestamp(ts, unit="us")], "tokens": [tokens], "expired": [True]})
            return
        newest = state.get if state.exists else None
        for pdf in parts:
            for r in pdf.itertuples():
                us = int(pd.Timestamp(r.ts).value // 1000)
                if newest is None or us > newest[0]:
                    newest = (us, int(r.tokens))
        state.update(newest)
        state.setTimeoutTimestamp(max(newest[0] // 1000, state.getCurrentWatermarkMs()) + 1000 * ttl_seconds)
        yield pd.DataFrame({"id": [key[0]], "ts": [pd.Timestamp(newest[0], unit="us")], "tokens": [newest[1]], "expired": [False]})

    return results.withWatermark("ts", "1 minute").groupBy("id").applyInPandasWithState(step, "id long, ts timestamp, tokens long, expired boolean", "us long, tokens long", "update", GroupStateTimeout.EventTimeTimeout)


def within_budget(fresh: DataFrame, budget: int) -> DataFrame:
    """Cached results (id, ts, tokens), newest first, until one would exceed the budget; the first always stays."""
    ranked = fresh.orderBy(F.desc("ts"), "id").limit(max(1, budget)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ts"), "id")))  # each costs a token at least
    used = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1)).drop("used")


def activity_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in tumbling windows of event time; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
