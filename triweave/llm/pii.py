"""Personal data: fixed base patterns, plus spans that a linear-chain conditional random field adds.

The field labels tokens around digits and address signs. Its features are word shapes; it is trained here by
gradient ascent on a small labelled table, and decoded by Viterbi over a batch's runs at once in numpy. Tokens
further away are fixed to "outside", so a text falls into independent runs and whole texts are covered. Besides the
four base kinds the field finds secrets: tokens, keys and passwords. A span of the field is added only if it overlaps
no base span and its kind's test holds (number of digits; a card also passes Luhn; a secret has letters and digits).

Defined results: null and empty texts have no spans. Per kind, base matches are leftmost and do not overlap; a
match that fails its test is dropped without another try. Repeated rows are each answered; no row is dropped.
Columns of any name are carried or not read. Memory is bounded by an Arrow batch, ``STEP_CHARS`` and the longest single text.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import tidy

from triweave.llm.pii_labels import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
ADDED = (*KINDS, "secret")  # kinds of the field: it also finds tokens, keys and passwords
LABELS = ("O", *(f"{p}-{k}" for k in ADDED for p in "BI"))
N_LABELS = len(LABELS)
N_FEATURES = 1 << 12
EPOCHS, RATE, DECAY = 60, 0.2, 1e-4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails at its start fails further in too, so a match may only begin with a run.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HOT = re.compile(r"[0-9@]+")
SPACES = re.compile(r"\s+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fits(kind: str, s: str) -> bool:
    """The test that a match has to pass."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    n = only_digits(s) if kind in ("card", "phone") else ""
    return kind == "email" or (kind == "card" and 12 <= len(n) <= 19 and luhn(n)) or (kind == "phone" and 9 <= len(n) <= 15)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in code points."""
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if fits(kind, m[0])]
    return out


def shape(word: str) -> str:
    """Letters as X and x, digits as 9; runs longer than two are shortened."""
    out = "".join("9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word[:64])
    return re.sub(r"(.)\1{2,}", r"\1\1", out)


def short(word: str) -> tuple[str, int]:
    """What features read of a token: its beginning, its last character and its length; caches keep no long tokens."""
    return (word if len(word) <= 64 else word[:63] + word[-1], min(len(word), 99))


@functools.lru_cache(1 << 16)
def word_features(word: str, length: int) -> tuple[str, ...]:
    n = len(only_digits(word))
    plain = not n and "@" not in word
    out = [f"s={'x' if plain else shape(word)}", f"n={min(n, 17)}", f"l={min(length, 48) // 4}"]
    if not plain:
        groups = re.findall(r"[0-9]+", word)
        out += [f"g={'-'.join(str(min(len(g), 9)) for g in groups[:5])}", f"a={word[0] if not word[0].isalnum() else '_'}", f"z={word[-1] if not word[-1].isalnum() else '_'}"]
        out += [f"c={c}" for c in set(word) if not c.isalnum()]
        turns = len(re.findall(r"[0-9][a-zA-Z]|[a-zA-Z][0-9]", word))
        out += [f"t={min(turns, 6)}", "hex" if turns and re.fullmatch(r"\W*[0-9a-f]+\W*", word) else "mix"] if turns else []
    return tuple(out)


def bucket(name: str) -> int:
    h = 2166136261
    for b in name.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % N_FEATURES


@functools.lru_cache(1 << 16)
def feature_ids(word: str, length: int, at: str) -> tuple[int, ...]:
    return tuple(bucket(at + f) for f in word_features(word, length))


@functools.lru_cache(1 << 14)
def hint_id(word: str, at: str) -> int:
    return bucket(at + re.sub(r"[\W\d]+", "", word.lower())[:16])


def token_features(words: list[str], k: int) -> list[int]:
    before, after = words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""
    out = [*feature_ids(*short(words[k]), ""), hint_id(short(words[k])[0], "v=")]
    out += [*feature_ids(*short(before), "<"), hint_id(short(before)[0], "w=")] if before else [bucket("first")]
    out += [hint_id(short(words[k - 2])[0], "u=")] if k > 1 else []
    out += [*feature_ids(*short(after), ">")] if after else [bucket("last")]
    return out


def tokens_near(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens with a digit or an address sign, the two tokens before and the one after; (start, end) of each."""
    hits = [m.start() for m in HOT.finditer(text)]
    if not hits:
        return []
    gaps = [(m.start(), m.end()) for m in SPACES.finditer(text)]
    starts = [0] + [b for _, b in gaps]
    ends = [a for a, _ in gaps] + [len(text)]
    wanted = sorted({bisect_right(starts, h) - 1 for h in hits})
    runs: list[list[int]] = []
    for w in wanted:
        lo = max(w - 2, 0)
        if runs and lo <= runs[-1][1] + 1:
            runs[-1][1] = w + 1
        else:
            runs.append([lo, w + 1])
    return [[(starts[k], ends[k]) for k in range(a, min(b, len(starts) - 1) + 1) if starts[k] < ends[k]] for a, b in runs]


class Field:
    """Weights of features and of label changes."""

    def __init__(self, unary: np.ndarray, change: np.ndarray):
        self.unary, self.change = unary, change

    def decode(self, runs: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each run of feature lists; runs move on together, longest first."""
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        size = np.array([len(runs[i]) for i in order])
        flat = [f for i in order for f in runs[i]]
        count = np.array([len(f) for f in flat])
        score = np.add.reduceat(self.unary[np.concatenate([np.array(f) for f in flat])], np.cumsum(count) - count) if flat else np.zeros((0, N_LABELS))
        first = np.cumsum(size) - size
        best = score[first].copy()
        back: list[np.ndarray] = []
        for t in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))  # runs longer than t
            path = best[:live, :, None] + self.change[None]
            back.append(path.argmax(axis=1).astype(np.int8))
            best[:live] = path.max(axis=1) + score[first[:live] + t]
        label = best.argmax(axis=1)
        out = [np.zeros(n, np.int8) for n in size]
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            for k in range(live):
                out[k][t] = label[k]
            if t:
                label[:live] = back[t - 1][np.arange(live), label[:live]]
        done: list[np.ndarray] = [None] * len(runs)  # type: ignore[list-item]
        for k, i in enumerate(order):
            done[i] = out[k]
        return done


def labelled(line: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and spans of a marked line."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(email|ip|card|phone|secret):([^\]]*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text, at = text + m[2], m.end()
    return text + line[at:], spans


@functools.lru_cache(1)
def trained() -> Field:
    """Conditional maximum likelihood on the labelled table; some seconds of numpy, the same each time."""
    data = []
    for line in EXAMPLES:
        text, spans = labelled(line)
        words_at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
        for run in tokens_near(text):
            words = [text[a:b] for a, b in run]
            gold = []
            for a, b in run:
                hit = next(((s, k) for s, e, k in spans if s < b and e > a), None)
                gold.append(0 if hit is None else LABELS.index(("B-" if not any(hit[0] < y and x < a and y > hit[0] for x, y in words_at if x < a) else "I-") + hit[1]))
            data.append(([np.array(token_features(words, k)) for k in range(len(words))], np.array(gold)))
    unary, change = np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS))
    for j, name in enumerate(LABELS):  # an inside label only follows its own kind
        if name[0] == "I":
            change[[i for i, x in enumerate(LABELS) if x[2:] != name[2:]], j] = -1e4
    square, square_c = np.full_like(unary, 1e-6), np.full_like(change, 1e-6)
    rng = np.random.default_rng(7)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(data)):
            feats, gold = data[i]
            u = np.array([unary[f].sum(axis=0) for f in feats])
            n = len(u)
            fwd, bwd = u.copy(), np.zeros_like(u)
            for t in range(1, n):
                fwd[t] += lse(fwd[t - 1][:, None] + change, 0)
            for t in range(n - 2, -1, -1):
                bwd[t] = lse(change + (u[t + 1] + bwd[t + 1])[None], 1)
            z = lse(fwd[-1], 0)
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), gold] -= 1
            for f, g in zip(feats, -p, strict=True):
                grad = g - DECAY * unary[f]
                square[f] += grad**2
                unary[f] += RATE * grad / np.sqrt(square[f])
            grad_c = np.zeros_like(change)
            for t in range(1, n):
                grad_c -= np.exp(fwd[t - 1][:, None] + change + (u[t] + bwd[t])[None] - z)
                grad_c[gold[t - 1], gold[t]] += 1
            grad_c[change < -1e3] = 0
            square_c += grad_c**2
            change += np.where(change < -1e3, 0, RATE * grad_c / np.sqrt(square_c))
    return Field(unary, change)


EDGE = " \t\r\n.,;:!?\"'<>[]{}#&%$*|="


def added_spans(text: str, runs: list[list[tuple[int, int]]], labels: list[np.ndarray], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the field that pass the tests and overlap no base span."""
    out = []
    for run, label in zip(runs, labels, strict=True):
        k = 0
        while k < len(run):
            name = LABELS[label[k]]
            if name[0] == "O":
                k += 1
                continue
            end = k + 1
            while end < len(run) and LABELS[label[end]] == "I-" + name[2:]:
                end += 1
            a, b, kind = run[k][0], run[end - 1][1], name[2:]
            k = end
            while a < b and text[a] in EDGE:
                a += 1
            while a < b and text[b - 1] in EDGE + "(":
                b -= 1
            s = text[a:b]
            n = only_digits(s)
            right = {"email": "@" in s[1:-1] and not SPACES.search(s), "ip": len(s.split(".")) == 4 and len(n) < 13 and not re.search(r"[^0-9.]", s) and fits("ip", s), "card": 12 <= len(n) <= 19 and luhn(n), "phone": 7 <= len(n) <= 15 and not re.search(r"[^\x20().0-9/+-]", s), "secret": len(s) >= 12 and n and re.search(r"[A-Za-z]", s) and not SPACES.search(s)}[kind]
            if right and not any(x < b and y > a for x, y, _ in base):
                out.append((a, b, kind))
    return out


def find_all(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Base and added spans of each text; all runs of the texts are decoded together."""
    bases = [base_spans(t) for t in texts]
    near = [tokens_near(t) for t in texts]
    feats = []
    for t, runs in zip(texts, near, strict=True):
        for run in runs:
            words = [t[a:b] for a, b in run]
            feats.append([token_features(words, k) for k in range(len(words))])
    labels = field.decode(feats) if feats else []
    out, at = [], 0
    for t, runs, base in zip(texts, near, bases, strict=True):
        out.append((base, added_spans(t, runs, labels[at : at + len(runs)], base)))
        at += len(runs)
    return out


SPANS = "array<struct<kind string, start int, end int, base boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
STEP_CHARS = 2_000_000  # of text decoded at once, one text at least


def steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts with about STEP_CHARS in all."""
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= STEP_CHARS:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _ordered(base: list, more: list) -> list[dict]:
    spans = [(a, ADDED.index(k), b, k, True) for a, b, k in base] + [(a, ADDED.index(k), b, k, False) for a, b, k in more]
    return [{"kind": k, "start": a, "end": b, "base": own} for a, _, b, k, own in sorted(spans)]


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans``: all spans by start, then kind, in code points, end exclusive."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", spans {SPANS}"
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in steps(texts):
                part = batch.slice(a, b - a)
                found = find_all(texts[a:b], field)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), pa.array([_ordered(b, m) for b, m in found], type=SPAN_TYPE)], names=[*keep, "spans"])

    return source.mapInArrow(tidy(run), schema)


def masked(text: str, base: list, more: list) -> str:
    """The text with each span, overlapping ones together, replaced by its kind."""
    out, at = [], 0
    for s in _ordered(base, more):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in ``text`` replaced by its kind; a null text stays null."""
    names = docs.columns
    at = names.index(text)
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(at).to_pylist()
            for a, b in steps(every):
                part, texts = batch.slice(a, b - a), every[a:b]
                found = find_all([t or "" for t in texts], field)
                new = pa.array([t if t is None else masked(t, own, more) for t, (own, more) in zip(texts, found, strict=True)], type=pa.string())
                yield pa.RecordBatch.from_arrays([new if k == at else part.column(k) for k in range(part.num_columns)], names=names)

    return docs.mapInArrow(tidy(run), docs.schema)
