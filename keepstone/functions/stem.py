"""Porter's algorithm for English word stems (Program, 1980)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_VOWEL = set("aeiou")

# Endings and what takes their place, in the steps of the published algorithm.
_STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant, letter by letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in _VOWEL or (c == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    """Whether a word ends with consonant, vowel, consonant, the last one not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, endings: list[tuple[str, str]]) -> str:
    """The longest ending that fits is replaced if the rest has a measure."""
    for old, new in sorted(endings, key=lambda x: -len(x[0])):
        if word.endswith(old):
            rest = word[: -len(old)]
            return rest + new if _measure(rest) > 0 else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            rest = word[: -len(ending)]
            if word.endswith(ending) and "v" in _shape(rest):
                if rest.endswith(("at", "bl", "iz")):
                    rest += "e"
                elif _shape(rest).endswith("cc") and rest[-1] == rest[-2] and rest[-1] not in "lsz":
                    rest = rest[:-1]
                elif _measure(rest) == 1 and _short(rest):
                    rest += "e"
                word = rest
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP_2), _STEP_3)
    for ending in sorted(_STEP_4, key=len, reverse=True):
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stemmed(words: DataFrame) -> DataFrame:
    """(id, t) with the stem of each word; each distinct word of a batch is stemmed once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
            start = lists.offsets[0].as_py()
            offsets = pa.array([o - start for o in lists.offsets.to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, stems.take(coded.indices))], ["id", "t"])

    return words.select("id", "t").mapInArrow(run, f"id {words.schema['id'].dataType.simpleString()}, t array<string>")
