"""Extractive summaries: a sentence's score is the mean frequency of its words in the text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.functions import text as T

#: Characters of an abstract, and of the only fact of a text without sentences.
ABSTRACT, FACT = 200, 500


def scores(sentences: list[list[str]]) -> list[float]:
    """For the words of each sentence of a text the mean of how often they occur in the text; 0 without words."""
    n = Counter(w for s in sentences for w in s)
    return [sum(n[w] for w in s) / len(s) if s else 0.0 for s in sentences]


def summary(text: str | None, sentences: list[str], words: list[list[str]]) -> tuple[str, list[str]]:
    """The best sentence, cut, and a third of the sentences, one to five, in order (both of two); the first of equals is better."""
    if not sentences:
        return (text or "")[:ABSTRACT], [text[:FACT]] if text else []
    value = scores(words)
    ranked = sorted(range(len(sentences)), key=lambda i: (-value[i], i))
    kept = ranked if len(sentences) <= 2 else ranked[: min(5, max(1, len(sentences) // 3))]
    return sentences[ranked[0]][:ABSTRACT], [sentences[i] for i in sorted(kept)]


def summaries(texts: DataFrame, keep_text: bool = False) -> DataFrame:
    """id, l3 (the best sentence, 200 characters at most) and l2 (a third of the sentences, one to five, in order) of (id, text).

    Texts are cut into sentences and words by built-in functions; words are counted within a row, so nothing is shuffled. A null
    text has an empty abstract and no facts; one without sentences is its own. With keep_text the text comes along.
    """
    cut = texts.select("id", "text", T.sentences(F.col("text")).alias("s"))
    cut = cut.select("id", "text", "s", F.transform("s", lambda x: T.tokenize(x)).alias("w"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            made = [summary(t, s or [], w or []) for t, s, w in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            columns = [b.column(0), pa.array([l3 for l3, _ in made], pa.string()), pa.array([l2 for _, l2 in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + [b.column(1)] * keep_text, ["id", "l3", "l2"] + ["text"] * keep_text)

    return cut.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, l3 string, l2 array<string>" + ", text string" * keep_text)
