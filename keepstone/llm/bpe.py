"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a batch are laid end to end as one sequence of symbols with links to the
neighbours. An index maps each pair of adjacent symbols to the places where it occurs. The active
ranks wait in a heap; the lowest is applied at all its places, and the lists of the pairs that
appear are extended. A rank that becomes active later but is lower is taken next, so each word
sees its merges in the order it would see alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from keepstone.llm.common import batches, record_batch, setup

#: Words whose pieces a worker remembers before it starts anew.
CACHE_WORDS = 300_000


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _occurrences(symbols: list[int], following: list[int], active: np.ndarray, span: int) -> dict[int, list[int]]:
    """For each pair of adjacent symbols that has a rank (active, sorted) the places where it occurs, in order."""
    s, f = np.array(symbols, np.int64), np.array(following, np.int64)
    at = np.flatnonzero(f >= 0)
    pair = s[at] * span + s[f[at]]
    has = active[np.minimum(np.searchsorted(active, pair), len(active) - 1)] == pair
    at, pair = at[has], pair[has]
    order = np.argsort(pair, kind="stable")
    at, pair = at[order], pair[order]
    cuts = np.flatnonzero(np.diff(pair, prepend=-1))
    ends = [*cuts[1:].tolist(), len(at)]
    at = at.tolist()
    return {p: at[i:j] for p, i, j in zip(pair[cuts].tolist(), cuts.tolist(), ends, strict=True)} if len(at) else {}


def merge_words(words: list[list[int]], ranks: dict[int, tuple[int, int]], active: np.ndarray, span: int) -> list[list[int]]:
    """Apply merges to many words at once.

    words: the symbols of each word; ranks: first * span + second -> (rank, merged symbol); active: the keys of ranks, sorted.
    """
    symbols: list[int] = []
    following: list[int] = []
    preceding: list[int] = []
    starts = []
    for w in words:
        at, n = len(symbols), len(w)
        starts.append(at)
        symbols += w
        following += range(at + 1, at + n + 1)
        preceding += range(at - 1, at + n - 1)
        if n:
            following[-1] = -1
            preceding[at] = -1
    places = _occurrences(symbols, following, active, span)
    heap = [(ranks[p][0], p) for p in places]
    heapq.heapify(heap)
    while heap:
        _, pair = heapq.heappop(heap)
        todo = places.pop(pair, None)
        if todo is None:
            continue
        first, second = divmod(pair, span)
        merged = ranks[pair][1]
        todo.sort()
        for i in todo:
            if symbols[i] != first:
                continue
            j = following[i]
            if j < 0 or symbols[j] != second:
                continue
            symbols[i], symbols[j] = merged, -1
            following[i] = k = following[j]
            if k >= 0:
                preceding[k] = i
                right = merged * span + symbols[k]
                if (known := places.get(right)) is not None:
                    known.append(i)
                elif right in ranks:
                    places[right] = [i]
                    heapq.heappush(heap, (ranks[right][0], right))
            h = preceding[i]
            if h >= 0:
                left = symbols[h] * span + merged
                if (known := places.get(left)) is not None:
                    known.append(h)
                elif left in ranks:
                    places[left] = [h]
                    heapq.heappush(heap, (ranks[left][0], left))
    out = []
    for at, w in zip(starts, words, strict=True):
        ids = []
        i = at if w else -1
        while i >= 0:
            ids.append(symbols[i])
            i = following[i]
        out.append(ids)
    return out


class WordBPE:
    """A BPE model with word ends, read from the JSON form of a tokenizer definition.

    Takes models whose normaliser is NFC, white space to one blank, lower case; whose words are
    the matches of a pattern, in byte-level symbols; with a suffix on the last symbol of a word.
    """

    def __init__(self, definition: str) -> None:
        d = json.loads(definition)
        m = d["model"]
        self.vocab: dict[str, int] = m["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.end = m["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.span = max(self.tokens) + 1
        self.ranks = {}
        for r, pair in enumerate(m["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.vocab[a] * self.span + self.vocab[b], (r, self.vocab[a + b]))
        self.active = np.array(sorted(self.ranks), np.int64)
        self.numbers = {i: str(i) for i in self.tokens}
        self.pattern = regex.compile(d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.blank = regex.compile(r"\s+")
#: Characters that every Unicode version at hand knows alike.
        self.settled: set[str] = set()
        symbol = _byte_symbols()
        self.inner = [self.vocab[symbol[b]] for b in range(256)]
        self.final = [self.vocab[symbol[b] + self.end] for b in range(256)]
        self.definition = definition
        self.library = None
        #: word -> (pieces, ids joined by a blank, tokens joined by a blank)
        self.known: dict[str | int, tuple[int, str, str]] = {}

    def _newer(self, text: str) -> list[str]:
        """Words of a text with characters whose properties differ between Unicode versions: as the library sees them."""
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            whole = Tokenizer.from_str(self.definition)
            self.library = whole.normalizer, pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        normal, split = self.library
        return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        if not self.settled.issuperset(chars := set(text)):
            if any(c > "\uffff" or unicodedata.category(c) in ("Cn", "Co") for c in chars):
                return self._newer(text)
            self.settled |= chars
        text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens that stand in the text."""
        if "<|" not in text:
            return self.words(text)
        out: list[str | int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self.words(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet."""
        new = [w for w in words if w not in self.known]
        laid = []
        inner = self.inner.__getitem__
        for w in new:
            b = w.encode("utf-8")
            symbols = list(map(inner, b))
            symbols[-1] = self.final[b[-1]]
            laid.append(symbols)
        number, token = self.numbers.__getitem__, self.tokens.__getitem__
        for w, ids in zip(new, merge_words(laid, self.ranks, self.active, self.span), strict=True):
            self.known[w] = (len(ids), " ".join(map(number, ids)), " ".join(map(token, ids)))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: the number of ids, the ids joined by a blank, and what they decode to."""
        cut = [self.pieces(t) for t in texts]
        every = set().union(*cut)
        fresh = every - self.known.keys()
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
            fresh = every
        self.learn({w for w in fresh if isinstance(w, str)})
        for i in self.special.values():
            self.known[i] = 1, str(i), self.tokens[i]
        known = self.known.__getitem__
        for p in cut:
            n, ids, tokens = zip(*map(known, p), strict=True) if p else ((), (), ())
            yield sum(n), " ".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        """What ids stand for: without a decoder the tokens are joined by blanks; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_MODELS: dict[int, WordBPE] = {}


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, decoded: bool = True) -> DataFrame:
    """Encode whole texts and decode them again.

    Returns id, n_tokens long, ids_sha256, decoded_sha256 and, with_ids, ids array<int> and, with
    decoded too, decoded string. Null and empty texts have no tokens (the digests of the empty string). Rows
    are taken one by one: repeated rows and ids, null ids and other columns have no influence.
    No shuffle; a worker holds one bounded batch and CACHE_WORDS words.
    """
    spark = docs.sparkSession
    setup(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # the vocabulary file: a fixed size
    kind = docs.schema[id_col].dataType
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        fields += [("ids", pa.list_(pa.int32()))] + [("decoded", pa.string())] * decoded

    def run(stream):
        key = hash(shared.value)
        if key not in _MODELS:
            _MODELS.clear()
            _MODELS[key] = WordBPE(shared.value)
        model = _MODELS[key]
        for b in batches(stream):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols: dict = {n: [] for n, _ in fields}
            for n, ids, back in model.encode(texts):
                cols["n_tokens"].append(n)
                cols["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                cols["decoded_sha256"].append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    cols["ids"].append(np.array(ids.split(" "), np.int32) if ids else [])
                    if decoded:
                        cols["decoded"].append(back)
            schema = pa.schema([b.schema.field(0).with_name(id_col), *fields])
            yield record_batch(schema, cols | {id_col: b.column(0)})

    out = f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "") + (", decoded string" if with_ids and decoded else "")
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, out)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), with_ids=False)
