"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds.

A text is cut into tokens around places with digits, at signs or the word at. Every span of up to MAX_TOKENS
tokens and MAX_CHARS characters is a candidate segment with features of the whole span; a dynamic
program chooses boundaries and types of all segments together. The weights are fitted by
maximum likelihood on made-up sentences of which the entities are known.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keepstone.llm.common import batches, record_batch, setup

#: Fixed order of the kinds; the last is found by the field only.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("other", *KINDS)
MAX_TOKENS, MAX_CHARS = 14, 96
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: What _segments counts as a mark: a trigger, or at as a token by itself.
_MARK = re.compile(r"[0-9@]|(?<![A-Za-z0-9])[Aa][Tt](?![A-Za-z0-9])")
_TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|[^A-Za-z0-9\s]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign to both sides, so that long runs without one cost nothing."""
    done = 0
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        start = at
        if m:
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind, in order."""
    out = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 64 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda x: (x[0], BASE_KINDS.index(x[2])))


# Words that stand before personal data; fixed values of the features.
_CUES = {
    "email": re.compile(r"(?i)\b(e-?mail|mail|contact|write)\b"),
    "ip": re.compile(r"(?i)\b(ip|host|server|address)\b"),
    "card": re.compile(r"(?i)\b(card|visa|credit|debit)\b"),
    "phone": re.compile(r"(?i)\b(phone|tel|call|fax|mobile)\b"),
    "secret": re.compile(r"(?i)\b(token|secret|password|passwd|pwd|key|api_?key)\b"),
}
_DATE = re.compile(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}")
_OBFUSCATED = re.compile(r"(?i)[a-z0-9._+-]+ ?[\[(] ?at ?[\])] ?[a-z0-9-]+(?: ?[\[(] ?dot ?[\])] ?[a-z0-9-]+)+|[a-z0-9._+-]+ @ ?[a-z0-9-]+(?: ?\. ?[a-z]{2,})+")
_GROUPED = re.compile(r"(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]\d{2,4}){2,4}")


def _features(text: str, s: int, e: int) -> np.ndarray:
    """What is known of a whole span and the text just before it."""
    span, before, after = text[s:e], text[max(0, s - 24) : s], text[e : e + 1]
    n = len(span)
    digits = sum(map(str.isdigit, span))
    letters = sum(map(str.isalpha, span))
    plain = re.sub(r"[ .()-]", "", span)
    hexed = n >= 16 and all(c in "0123456789abcdefABCDEF" for c in span)
    mixed = n >= 16 and span.isalnum() and digits >= 3 and letters >= 3
    parts = span.split(".")
    four = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    f = [
        1.0,
        float("@" in span),
        float(bool(_OBFUSCATED.fullmatch(span))),
        float(four),
        float(plain.isdigit() and 12 <= digits <= 19),
        float(plain.isdigit() and 12 <= digits <= 19 and luhn(plain)),
        float(plain.isdigit() and 9 <= digits <= 11),
        float(bool(_GROUPED.fullmatch(span))),
        float(span.startswith(("+", "("))),
        float(hexed),
        float(mixed),
        float(bool(_DATE.fullmatch(span))),
        float(digits == 0),
        float(digits <= 4),
        float(n < 7),
        float(" " in span),
        float(bool(re.search(r"[^A-Za-z0-9@ .+()\[\]-]", span))),
        float(after.isalnum() or (before[-1:].isalnum())),
        digits / n,
        math.log(n) / 4,
    ]
    f += [float(bool(c.search(before))) for c in _CUES.values()]
    return np.array(f)


WIDTH = len(_features("a 1", 2, 3))


def _segments(text: str, lo: int, hi: int, taken: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int, int]]]]:
    """Tokens of text[lo:hi], and by the token that follows them the candidate entities (first token, start, end).

    An entity begins and ends with a letter, digit, + or bracket, has a digit or an at sign and
    doesn't touch a span in ``taken``.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
    out: dict[int, list[tuple[int, int, int]]] = {}
    blocked, k, reach = [], 0, -1  # reach: the furthest end of the taken spans that begin before a token's end
    for s, e in tokens:
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        blocked.append(reach > s)
    for i, (s, _) in enumerate(tokens):
        if blocked[i] or not (text[s].isalnum() or text[s] in "+("):
            continue
        marked = False
        for j in range(i, min(i + MAX_TOKENS, len(tokens))):
            e = tokens[j][1]
            if e - s > MAX_CHARS:
                break
            if blocked[j]:
                break
            marked = marked or bool(_TRIGGER.search(text, *tokens[j])) or text[tokens[j][0] : e].lower() == "at"
            if marked and (text[e - 1].isalnum() or text[e - 1] in ")]") and "\n" not in text[s:e]:
                out.setdefault(j + 1, []).append((i, s, e))
    return tokens, out


class SemiMarkovField:
    """Weights of span features for each label, and of pairs of adjacent labels."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def _scored(self, text: str, lo: int, hi: int, taken: list[tuple[int, int]]) -> tuple[int, dict]:
        tokens, found = _segments(text, lo, hi, taken)
        by = {}
        for j, (s, e) in enumerate(tokens, 1):
            by[j] = [(j - 1, s, e, None, None)]  # a token by itself, of no kind; its score is 0
            for i, a, b in found.get(j, ()):
                x = _features(text, a, b)
                by[j].append((i, a, b, x, self.weights @ x))
        return len(tokens), by

    def decode(self, text: str, lo: int, hi: int, taken: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best segmentation of text[lo:hi]: its entities."""
        n, by = self._scored(text, lo, hi, taken)
        k = len(LABELS)
        best = np.full((n + 1, k), -np.inf)
        best[0, 0] = 0
        back: list[list] = [[None] * k for _ in range(n + 1)]
        for j in range(1, n + 1):
            for i, s, e, x, score in by[j]:
                come = best[i][:, None] + self.pairs
                top = come.argmax(0)
                for y in (0,) if x is None else range(1, k):
                    v = come[top[y], y] + (0 if x is None else score[y - 1])
                    if v > best[j, y]:
                        best[j, y], back[j][y] = v, (i, s, e, int(top[y]))
        out = []
        j, y = n, int(best[n].argmax()) if n else 0
        while j > 0:
            i, s, e, before = back[j][y]
            if y:
                out.append((s, e, LABELS[y]))
            j, y = i, before
        return out[::-1]

    def gradient(self, text: str, gold: list[tuple[int, int, str]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of a sentence's entities and its gradient, by forward and backward sums over segmentations."""
        n, by = self._scored(text, 0, len(text), [])
        k = len(LABELS)
        f = np.full((n + 1, k), -np.inf)
        f[0, 0] = 0
        with np.errstate(divide="ignore"):
            for j in range(1, n + 1):
                for i, _, _, x, score in by[j]:
                    v = np.logaddexp.reduce(f[i][:, None] + self.pairs, axis=0)
                    if x is None:
                        f[j, 0] = np.logaddexp(f[j, 0], v[0])
                    else:
                        f[j, 1:] = np.logaddexp(f[j, 1:], v[1:] + score)
        z = np.logaddexp.reduce(f[n])
        gw, gp = np.zeros_like(self.weights), np.zeros_like(self.pairs)
        b = np.full((n + 1, k), -np.inf)
        b[n] = 0
        for j in range(n, 0, -1):
            for i, _, _, x, score in by[j]:
                s = np.full(k, -np.inf)
                if x is None:
                    s[0] = 0
                else:
                    s[1:] = score
                joint = f[i][:, None] + self.pairs + (s + b[j])[None, :]
                p = np.exp(joint - z)
                gp -= p
                if x is not None:
                    gw -= p.sum(0)[1:, None] * x[None, :]
                b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.pairs + (s + b[j])[None, :], axis=1))
        want = {(s, e): LABELS.index(y) for s, e, y in gold}
        j, before, value, chain = n, 0, 0.0, []
        while j > 0:
            hit = next((g for g in by[j] if g[3] is not None and (g[1], g[2]) in want), by[j][0])
            chain.append(hit)
            j = hit[0]
        for i, s, e, x, score in reversed(chain):
            y = 0 if x is None else want[(s, e)]
            gp[before, y] += 1
            value += self.pairs[before, y] + (0 if x is None else score[y - 1])
            if x is not None:
                gw[y - 1] += x
            before = y
        return value - z, gw, gp

    @classmethod
    def fit(cls, sentences: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> SemiMarkovField:
        """Maximum likelihood by adaptive gradient steps, in the order given."""
        field = cls(np.zeros((len(KINDS), WIDTH)), np.zeros((len(LABELS), len(LABELS))))
        field.weights[:, 0] = -2.0
        hw, hp = np.full_like(field.weights, 1e-2), np.full_like(field.pairs, 1e-2)
        for _ in range(rounds):
            for text, gold in sentences:
                _, gw, gp = field.gradient(text, gold)
                gw -= decay * field.weights
                hw += gw**2
                hp += gp**2
                field.weights += rate * gw / np.sqrt(hw)
                field.pairs += rate * gp / np.sqrt(hp)
        return field


def made_up_sentences(n: int = 160, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Short sentences with and without personal data, and the entities in them."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 7)))

    def card() -> str:
        x = r.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return r.choice([x, " ".join(x[i : i + 4] for i in range(0, 16, 4)), "-".join(x[i : i + 4] for i in range(0, 16, 4))])

    makers = {
        "email": lambda: r.choice([f"{w()}.{d(2)}@{w()}{d(1)}.com", f"{w()} (at) {w()} (dot) com", f"{w()} [at] {w()} [dot] org", f"{w()} @ {w()}.net"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([f"+1 ({d(3)}) 555-{d(4)}", f"({d(3)}) 555-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{r.randint(20, 99)} {d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(3)} {d(4)}"]),
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 64]))),
    }
    cues = {"email": ["mail", "contact", ""], "ip": ["host", "ip", ""], "card": ["card", "visa", ""], "phone": ["phone", "call", "tel.", ""], "secret": ['token = "', 'api_key: "', "secret "]}
    plain = [
        lambda: f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1990, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}",
        lambda: f"version {r.randint(1, 9)}.",
        lambda: f"{d(r.randint(1, 6))}",
        lambda: f"{d(13)} {d(r.randint(1, 2))}",
        lambda: f"page {d(2)} of {d(3)}",
        lambda: f"{d(1)},{d(3)},{d(3)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)}",
        lambda: f"{w()}@ {w()}",
        lambda: f"{w()}{d(2)}",
        lambda: f"{d(8)}",
    ]
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 2)):
            text += " ".join(w() for _ in range(r.randint(1, 3))) + " "
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                cue = r.choice(cues[kind])
                text += cue + (" " if cue and cue[-1] not in ' "' else "")
                made = makers[kind]()
                gold.append((len(text), len(text) + len(made), kind))
                text += made + ('"' if cue.endswith('"') else r.choice(["", ".", ","])) + " "
            else:
                text += r.choice(plain)() + " "
        out.append((text + w(), gold))
    return out


@cache
def default_field() -> SemiMarkovField:
    return SemiMarkovField.fit(made_up_sentences())


def _regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around marks that hold every candidate segment with one, grown to whole words."""
    lo = hi = -1
    for m in _MARK.finditer(text):
        if m.end() + MAX_CHARS <= hi:
            continue
        s, e = max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)
        while e < len(text) and text[e - 1].isalnum() and text[e].isalnum():
            e += 1
        if s <= hi:
            hi = max(hi, e)
            continue
        while s > max(hi, 0) and text[s - 1].isalnum() and text[s].isalnum():
            s -= 1
        if hi >= 0 and s > hi:
            yield lo, hi
            lo = s
        elif hi < 0:
            lo = s
        hi = e
    if hi >= 0:
        yield lo, hi


def all_spans(text: str, field: SemiMarkovField) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The spans of the fixed patterns, and with those that the field adds where no fixed pattern matched."""
    base = base_spans(text)
    if not _MARK.search(text):
        return base, base
    added = []
    k = 0
    ordered = sorted((s, e) for s, e, _ in base)
    for lo, hi in _regions(text):
        while k < len(ordered) and ordered[k][1] <= lo:
            k += 1
        taken = []
        for s, e in ordered[k:]:
            if s >= hi:
                break
            taken.append((s, e))
        added += field.decode(text, lo, hi, taken)
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal_data(docs: DataFrame, field: SemiMarkovField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of each whole text.

    Returns id, n_email, n_ip, n_card, n_phone (long, by the fixed patterns), base_sha256 of their
    spans, spans (all, by start) and n_added long. Null texts count as empty. Each row is judged
    alone: repeated rows, null ids and other columns have no influence.
    """
    spark = docs.sparkSession
    setup(spark)
    shared = spark.sparkContext.broadcast(field or default_field())  # a fixed number of weights

    def run(stream):
        for b in batches(stream):
            cols: dict = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "", shared.value)
                for k in BASE_KINDS:
                    cols[f"n_{k}"].append(sum(x[2] == k for x in base))
                cols["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols["spans"].append(_joined(every))
                cols["n_added"].append(len(every) - len(base))
            fields = [(f"n_{k}", pa.int64()) for k in BASE_KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
            yield record_batch(pa.schema([b.schema.field(0).with_name(id_col), *fields]), cols | {id_col: b.column(0)})

    out = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, out)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
