"""A developer's profile from memories: styles of code, libraries, themes and what is avoided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.functions import profile_values as P
from keepstone.operators.store import stash

#: Memories from which a profile is made.
LEAST_EVIDENCE = 5


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(_u(pattern)))


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _list(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _first_most(scores: dict[str, Column], none: str) -> Column:
    """The name with the largest score, the first on ties; ``none`` if all are 0."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.lit(none)
    for name, s in reversed(scores.items()):
        out = F.when((s == best) & (best > 0), name).otherwise(out)
    return out


def code_related(memory_type: Column, tags: Column, text: Column) -> Column:
    """Whether a memory is about code: by type, by tags, or by what stands in it."""
    marked = reduce(lambda a, b: a | b, [text.rlike(_u(p)) for p in P.CODE_MARKS])
    return (memory_type == "code") | F.coalesce(F.arrays_overlap(tags, _list(P.CODE_TAGS)), F.lit(False)) | marked


def identifiers(code: Column) -> Column:
    """Names of three letters or more that aren't words of a language."""
    found = F.regexp_extract_all(code, F.lit(_u(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b")), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(P.CODE_KEYWORDS) & (F.length(w) > 2))


def naming_counts(names: Column) -> dict[str, Column]:
    """How many names of an array are in each style."""
    n = lambda keep: F.size(F.filter(names, keep))
    under = lambda w: F.contains(w, F.lit("_"))
    upper_first = lambda w: F.substring(w, 1, 1).rlike("[A-Z]")
    return {
        "snake_case": n(lambda w: under(w) & (w == F.lower(w))),
        "camelCase": n(lambda w: ~under(w) & F.substring(w, 1, 1).rlike("[a-z]") & w.rlike("[A-Z]")),
        "PascalCase": n(lambda w: ~under(w) & upper_first(w) & w.rlike("[a-z]")),
        "SCREAMING_CASE": n(lambda w: under(w) & (w != F.lower(w)) & (w == F.upper(w))),
    }


def name_prefixes(names: Column) -> Column:
    """Prefixes of two letters or more: what stands before an underscore, or before the first capital."""
    cut = F.transform(names, lambda w: F.when(F.contains(w, F.lit("_")), F.element_at(F.split(w, "_"), 1)).when(w.rlike("^[a-z]{2,}[A-Z]"), F.regexp_extract(w, "^([a-z]+)", 1)))
    return F.filter(cut, lambda p: F.length(p) >= 2)


def import_style(code: Column) -> Column:
    """Grouped, alphabetical, relative or absolute, as far as each holds; none without imports."""
    lines = F.transform(F.split(code, r"\r?\n"), lambda x: F.btrim(x, F.lit(" \t\f\x0b")))
    imported = F.regexp_extract_all(code, F.lit(r"(?m)^(?:from\s+\S+\s+)?import\s+.+$"), F.lit(0))
    relative = F.size(F.filter(imported, lambda x: x.rlike(r"^from\s+\.")))
    absolute = F.size(imported) - relative
    starts = lambda x: F.startswith(x, F.lit("import ")) | F.startswith(x, F.lit("from "))
    block = F.transform(F.filter(lines, starts), lambda x: F.lower(x))
    groups = F.size(F.filter(lines, lambda x, i: starts(x) & ~F.coalesce((i > 0) & starts(F.get(lines, i - 1)), F.lit(False))))
    parts = F.array_compact(
        F.array(
            F.when(groups >= 3, "grouped"),
            F.when((block == F.array_sort(block)) & (F.size(block) >= 3), "alphabetical"),
            F.when(relative > absolute, "relative").when(absolute > 0, "absolute"),
        )
    )
    return F.when(F.size(imported) == 0, "none").when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("ungrouped")


def error_style(code: Column) -> Column:
    """The way to deal with errors that is met most, and the one after it."""
    scores = {k: _sum([_count(code, p) for p in ps]) for k, ps in P.ERROR_STYLES.items()}
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-s).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]), lambda x: x["n"] < 0))
    first, second = F.get(ranked, 0)["k"], F.get(ranked, 1)["k"]
    return F.coalesce(F.when(second.isNotNull(), F.concat(first, F.lit(" with "), second)), first, F.lit("unknown"))


def type_hints(code: Column) -> Column:
    """heavy, moderate, light or none, by annotations for each function."""
    functions = _count(code, P.FUNCTIONS)
    returns, parameters, variables = (_count(code, p) for p in (P.TYPED_RETURNS, P.TYPED_PARAMETERS, P.TYPED_VARIABLES))
    density = (returns + parameters + variables) / functions
    return F.when(functions == 0, "none").when(density >= 2, "heavy").when(density >= 0.5, "moderate").when((returns > 0) | (parameters > 0), "light").otherwise("none")


def docstring_style(code: Column) -> Column:
    """The style of most docstrings, plain if none is known, none without any."""
    found = F.concat(F.regexp_extract_all(code, F.lit(r'(?s)"""(.*?)"""'), F.lit(1)), F.regexp_extract_all(code, F.lit(r"(?s)'''(.*?)'''"), F.lit(1)))
    like = lambda p: F.size(F.filter(found, lambda d: d.rlike(p)))
    scores = {k: like(p) for k, p in P.DOCSTRING_STYLES.items()}
    return F.when(F.size(found) == 0, "none").otherwise(_first_most(scores, "plain"))


def libraries(text: Column) -> Column:
    """Names of libraries that a text imports, installs or requires, each once, in order; lower case with underscores."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P.LIBRARY_MENTIONS[:1]])
    found = F.filter(F.transform(found, lambda x: F.element_at(F.split(x, r"\."), 1)), lambda x: x != "__future__")
    found = F.concat(found, *[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in P.LIBRARY_MENTIONS[1:]])
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.translate(F.lower(x), "-", "_"))), lambda x: F.length(x) > 1)


def styles(code: DataFrame) -> DataFrame:
    """id, naming, imports, errors, hints, docstrings and libraries of each row of (id, text)."""
    d = code.select("id", "text", identifiers(F.col("text")).alias("names"))
    naming = _first_most(naming_counts(F.col("names")), "unknown")
    t = F.col("text")
    return d.select("id", naming.alias("naming"), import_style(t).alias("imports"), error_style(t).alias("errors"), type_hints(t).alias("hints"), docstring_style(t).alias("docstrings"), libraries(t).alias("libraries"))


def themes(texts: DataFrame, patterns: dict[str, list[str]], least: int = 2) -> DataFrame:
    """theme and n of the themes whose patterns are met at least twice in all texts (text) together."""
    counts = [F.sum(_sum([F.regexp_count(F.col("text"), F.lit(f"(?iU){p}")) for p in ps])).alias(f"n{i}") for i, ps in enumerate(patterns.values())]
    one = texts.agg(*counts)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("theme"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, k in enumerate(patterns)])).alias("x"))
    return rows.select("x.theme", "x.n").where(F.col("n") >= least)


def review_themes(memories: DataFrame) -> DataFrame:
    """Themes of memories about reviews; of all, if none is about them."""
    about = F.coalesce(F.arrays_overlap("tags", _list(P.REVIEW_TAGS)), F.lit(False)) | F.col("memory_type").isin(P.REVIEW_TYPES)
    some = memories.where(about)
    return themes((some if some.limit(1).count() else memories).select(F.col("content").alias("text")), P.REVIEW_THEMES)


def avoided(memories: DataFrame, most: int = 20) -> DataFrame:
    """Up to twenty sentences about what is avoided, and abstracts of memories tagged so, in the order of ids; the first of those that begin alike."""
    s = memories.select("id", F.posexplode(F.split("content", r"[.!?\n]")).alias("pos", "s")).where(F.col("s").rlike(_u(P.AVOIDED)))
    told = s.select("id", "pos", F.trim("s").alias("sentence")).where((F.length("sentence") > 10) & (F.length("sentence") < 200))
    tagged = memories.where(F.arrays_overlap("tags", _list(P.AVOIDED_TAGS))).select("id", F.lit(1 << 30).alias("pos"), F.trim(F.coalesce(F.nullif(F.col("l3"), F.lit("")), F.substring("content", 1, 100))).alias("sentence"))
    every = told.unionByName(tagged).where("sentence <> ''")
    first = every.groupBy(F.substring(F.lower("sentence"), 1, 50).alias("k")).agg(F.min(F.struct("id", "pos", "sentence")).alias("x"))
    return first.select("x.id", "x.pos", "x.sentence").orderBy("id", "pos").limit(most)


def library_frequency(memories: DataFrame, most: int = 30) -> DataFrame:
    """library, frequency, the types of memories that name it, and whether it is rejected somewhere; the thirty most frequent."""
    named = memories.select("memory_type", F.explode(libraries(F.col("content"))).alias("library"))
    top = named.groupBy("library").agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("memory_type")).alias("context")).orderBy(F.desc("frequency"), "library").limit(most)
    no = memories.select(F.explode(F.regexp_extract_all("content", F.lit(P.REJECTED), F.lit(1))).alias("r")).select(F.translate(F.lower("r"), "-", "_").alias("library")).distinct().withColumn("rejected", F.lit(True))
    return top.join(no, "library", "left").withColumn("rejected", F.coalesce("rejected", F.lit(False)))


def _most_common(d: DataFrame, column: str, without: str) -> Column:
    """Not an aggregate: the most frequent value of a column, the first in the alphabet on ties, as a one-row frame's column."""
    n = d.where(F.col(column) != without).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1).collect()
    return F.lit(n[0][column] if n else "unknown")


def build(memories: DataFrame) -> DataFrame:
    """section and value (JSON) of the profile of (id, content, memory_type, tags, l3); none from fewer than LEAST_EVIDENCE memories."""
    spark = memories.sparkSession
    n = memories.agg(F.count("*").alias("n"), F.count_if(F.col("memory_type").isin("code", "decision") | F.coalesce(F.arrays_overlap("tags", _list(["code", "decision"])), F.lit(False))).alias("k")).first()
    empty = spark.createDataFrame([], "section string, value string")
    if n["n"] < LEAST_EVIDENCE:
        return empty
    code = memories.where(code_related(F.col("memory_type"), F.col("tags"), F.col("content"))).select("id", F.col("content").alias("text"))
    longest = F.array_max(F.transform(F.split("text", r"\r?\n"), lambda x: F.length(x)))
    t = F.col("text")
    named = code.select("text", identifiers(t).alias("names"))
    s = named.select(*[c.alias(k) for k, c in naming_counts(F.col("names")).items()], import_style(t).alias("imports"), error_style(t).alias("errors"), type_hints(t).alias("hints"), docstring_style(t).alias("docstrings"), longest.alias("m"))
    s = stash(s, "styles")  # a few words of each text, found in one pass
    counts = s.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("snake_case", "camelCase", "PascalCase", "SCREAMING_CASE")])
    variable = counts.select(F.to_json(F.struct(_first_most({k: F.col(k) for k in counts.columns}, "unknown").alias("dominant"), *counts.columns)).alias("value"))
    line = s.agg(F.avg("m").alias("m"))
    style = line.select(
        F.to_json(
            F.struct(
                F.when(F.col("m").isNull(), "unknown").when(F.col("m") <= 80, "80").when(F.col("m") <= 100, "100").when(F.col("m") <= 120, "120").otherwise("no-limit").alias("line_length_pref"),
                _most_common(s, "imports", "none").alias("import_style"),
                _most_common(s, "docstrings", "none").alias("docstring_style"),
                _most_common(s, "hints", "none").alias("type_hints_usage"),
            )
        ).alias("value")
    )
    told = lambda d, c: d.agg(F.to_json(F.array_sort(F.collect_list(c))).alias("value"))  # noqa: E731 - at most twenty or thirty rows
    out = empty
    sections = {
        "naming_conventions": variable,
        "architecture_patterns": told(themes(memories.select(F.col("content").alias("text")), P.ARCHITECTURE_THEMES), "theme"),
        "error_handling": spark.range(1).select(F.to_json(F.struct(_most_common(s, "errors", "unknown").alias("style"))).alias("value")),
        "preferred_libraries": told(library_frequency(memories), F.struct("library", "frequency", "context", "rejected")),
        "code_style": style,
        "review_feedback": told(review_themes(memories), "theme"),
        "anti_patterns": told(avoided(memories), "sentence"),
        "confidence": spark.range(1).select(F.lit(str(round(0.6 * min(1.0, n["k"] / n["n"]) + 0.4 * min(1.0, n["n"] / 50), 2))).alias("value")),
    }
    for name, d in sections.items():
        out = out.unionByName(d.select(F.lit(name).alias("section"), "value"))
    return out
