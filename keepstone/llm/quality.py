"""Quality rules: learned decision lists over statistics of whole texts, in SQL functions only."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import stash

#: Fixed values of the base statistics.
BLANKS = "[\\x20\\x09-\\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What rules may ask about; all are doubles. Of conditions that gain as much, that on the first is taken.
FEATURES = ("symbol_rate", "mark_rate", "upper_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "mean_word", "words")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and FEATURES.

    A null text counts as empty: all are 0. Words in repeated windows are found within the row:
    window hashes (64 bits) are sorted with their places, so a text of n words takes n log n steps
    and nothing is shuffled. Each row stands for itself, repeated or not.
    """
    cols = [docs[c] for c in keep]
    names = [f"k{i}" for i in range(len(keep))]
    kept = [F.col(n) for n in names]
    d = docs.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)], F.coalesce(docs[text_col], F.lit("")).alias("t"))
    d = d.select(*kept, "t", F.array_remove(F.split("t", BLANKS), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != "").alias("lines"))
    d = d.select(
        *kept,
        F.size("w").alias("n"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup"),
        F.length(F.translate("t", BLANK_CHARS, "")).alias("chars"),
        _without(F.col("t"), SYMBOLS).alias("sym"),
        _without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"),
        _without(F.col("t"), "!?").alias("marks"),
    )
    rest = [*kept, "n", "n_lines", "dup", "chars", "sym", "upper", "marks"]
    windows = F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(*rest, F.size(F.array_distinct("h")).alias("distinct"), windows.alias("win"))
    rest.append("distinct")
    again = F.size(F.array_distinct("win")) < F.size("win")
    d = d.select(*rest, F.when(again, F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))

    def twice(x: Column, i: Column) -> Column:
        return F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))

    d = d.select(*rest, F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", twice), lambda x: x["i"]))).alias("at"))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("sum")),
        lambda acc: acc["sum"],
    )
    d = d.select(*rest, F.coalesce(covered, F.lit(0)).alias("rep"))
    n, safe = F.col("n"), F.greatest(F.col("n"), F.lit(1))
    return d.select(
        *[F.col(k).alias(c) for k, c in zip(names, keep, strict=True)],
        n.cast("long").alias("n_words"),
        F.col("chars").cast("long").alias("word_chars"),
        F.col("sym").cast("long").alias("n_symbols"),
        F.col("dup").cast("long").alias("n_dup_lines"),
        F.col("rep").cast("long").alias("n_repeat_words"),
        n.cast("double").alias("words"),
        (F.col("chars") / safe).alias("mean_word"),
        (F.col("sym") / safe).alias("symbol_rate"),
        (F.col("dup") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_rate"),
        (F.col("rep") / safe).alias("repeat_rate"),
        (F.col("upper") / F.greatest(F.col("chars"), F.lit(1))).alias("upper_rate"),
        (F.col("marks") / safe).alias("mark_rate"),
        (F.col("distinct") / safe).alias("distinct_rate"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that marks a text as poor."""

    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


class DecisionList:
    """Rules in order; the first that holds rejects, else a text is kept."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules = rules

    def number(self) -> Column:
        """The number of the first rule that holds, from 1; 0 if none does."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].column(), F.lit(1))
        for i, r in enumerate(self.rules[1:], 2):
            out = out.when(r.column(), F.lit(i))
        return out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"if {r}: reject" for r in self.rules) + "\nelse keep"


def learn(labelled: DataFrame, max_rules: int = 12, max_conditions: int = 3, quantiles: int = 24, precision: float = 0.97, least: int = 5) -> DecisionList:
    """Sequential covering on a table of FEATURES and ``poor`` boolean, ``grow`` boolean.

    Candidate thresholds are made anew for each rule, from the rows that no rule covers yet: halfway
    between quantiles of the poor and of the other ones, their least and largest values and the least
    one above zero. A rule grows on the rows with ``grow`` by the condition of the largest FOIL gain, from
    counts by feature and bin that Spark makes in one pass; conditions are pruned if the rest does as well
    on the other rows; a rule is taken if it is right for ``precision`` of the rows that it covers in
    either part, and covers ``least`` poor ones. If it is not, the next best first condition is
    tried, on each feature and side once. Rows that a rule covers are removed. What reaches the driver are counts by
    feature and bin. An empty table gives an empty list.
    """
    remaining = F.lit(True)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = labelled.where(remaining)
        cuts = _cuts(left, quantiles)
        rule, tried = None, set()
        for first, pure in _conditions(left.where("grow"), cuts, least):
            if (first.feature, first.above) in tried:
                continue
            tried.add((first.feature, first.above))
            chosen = [first]
            while not pure and len(chosen) < max_conditions:
                found = _conditions(left.where(F.col("grow") & Rule(tuple(chosen)).column()), cuts, least)
                if not found:
                    break
                chosen.append(found[0][0])
                pure = found[0][1]
            rule = _pruned(left, chosen, precision, least)
            if rule is not None:
                break
        if rule is None:
            break
        rules.append(rule)
        remaining = remaining & ~rule.column()
    return DecisionList(rules)


def _cuts(rows: DataFrame, quantiles: int) -> dict[str, list[float]]:
    """Thresholds by feature: halfway between quantiles (with both ends) of the poor rows and of the others, and above zero."""
    steps = [i / (quantiles + 1) for i in range(quantiles + 2)]
    aggs = []
    for f in FEATURES:
        aggs += [F.percentile_approx(F.when(c, F.col(f)), steps, 10_000).alias(f"{f}_{k}") for k, c in (("poor", F.col("poor")), ("rest", ~F.col("poor")))]
        aggs.append(F.min(F.when(F.col(f) > 0, F.col(f))).alias(f"{f}_least"))
    got = rows.agg(*aggs).first()
    out = {}
    for f in FEATURES:
        least = [got[f"{f}_least"]] if got[f"{f}_least"] is not None else []
        found = sorted({*(got[f"{f}_poor"] or []), *(got[f"{f}_rest"] or []), *least})
        out[f] = [(a + b) / 2 for a, b in itertools.pairwise(found)]
    return out


def _conditions(rows: DataFrame, cuts: dict[str, list[float]], least: int) -> list[tuple[Condition, bool]]:
    """The conditions that gain and cover ``least`` poor rows, the largest gain first, and whether nothing but poor rows is left under each."""
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]).cast("array<double>"), lambda c: c < F.col(f)))

    place = F.array(*[bin_of(f) for f in FEATURES])
    found = rows.select("poor", F.posexplode(place).alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("poor").alias("p"), F.count_if(~F.col("poor")).alias("n")).collect()
    total_p = sum(r["p"] for r in found if r["f"] == 0)
    total_n = sum(r["n"] for r in found if r["f"] == 0)
    if not total_p or not total_n:
        return []
    base = math.log2(total_p / (total_p + total_n))
    out = []
    for i, f in enumerate(FEATURES):
        by = {r["bin"]: (r["p"], r["n"]) for r in found if r["f"] == i}
        p = n = 0
        for k, c in enumerate(cuts[f]):
            p, n = p + by.get(k, (0, 0))[0], n + by.get(k, (0, 0))[1]
            for above, (a, b) in ((False, (p, n)), (True, (total_p - p, total_n - n))):
                if a >= least:
                    gain = a * (math.log2(a / (a + b)) - base)
                    if gain > 1e-9:
                        out.append((gain, Condition(f, above, float(c)), b == 0))
    return [x[1:] for x in sorted(out, key=lambda x: -x[0])]


def _pruned(rows: DataFrame, chosen: list[Condition], precision: float, least: int) -> Rule | None:
    """The subset of conditions that is best on the rows kept aside; None if it isn't precise enough in both parts."""
    subsets = [Rule(s) for k in range(1, len(chosen) + 1) for s in itertools.combinations(chosen, k)]
    aggs = []
    for i, r in enumerate(subsets):
        for part, cond in (("g", F.col("grow")), ("h", ~F.col("grow"))):
            aggs += [F.count_if(r.column() & cond & F.col("poor")).alias(f"{part}p{i}"), F.count_if(r.column() & cond & ~F.col("poor")).alias(f"{part}n{i}")]
    got = rows.agg(*aggs).first()
    best = None
    for i, r in enumerate(subsets):
        gp, gn, hp, hn = (got[f"{k}{i}"] for k in ("gp", "gn", "hp", "hn"))
        if gp < least or gp < precision * (gp + gn) or hp < precision * (hp + hn):
            continue
        score = (hp - hn, gp - gn, -len(r.conditions))
        if best is None or score > best[0]:
            best = score, r
    return best[1] if best else None


def label_table(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled texts that pass the base rules, with poor and grow.

    Label rows without id or quality take no part; an id labelled twice counts as poor only if all its labels say so.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg((F.max("quality") == 0).alias("poor"))
    grow = F.crc32(F.concat(F.lit("grow:"), F.col("l_id").cast("string")).cast("binary")) % 3 != 0
    return stats.where(~base_failed()).join(one, F.col("doc_id") == F.col("l_id")).select(*FEATURES, "poor", grow.alias("grow"))


def apply_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """doc_id, the base statistics, base_failed, kept and rule (0: none) for each row, and the list learned.

    Statistics are written once and read for learning and for judging. Null ids and repeated rows
    are judged like all others; columns of ``docs`` but doc_id and text are not looked at.
    """
    stats = stash(text_statistics(docs), "statistics")
    labelled = stash(label_table(stats, labels), "labelled", narrow=True)
    rules = learn(labelled)
    number = F.when(base_failed(), F.lit(0)).otherwise(rules.number())
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (number == 0)).alias("kept"), number.alias("rule"))
    return out, rules


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))[0]
