"""Language identification by mixture inference.

Character n-gram counts of each language, over all documents to learn from, give every word a likelihood in every
language. Expectation-maximisation then estimates each document's language proportions; the set of languages is the
one with the best likelihood less ``PENALTY`` for each language, found by adding the next largest share while that
pays. The largest share of the chosen set names the document.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and if nothing was learned. Equal
shares go to the first language in order. Rows with a null language or null id are never learned from. Repeated
rows are each answered. Only the named columns are read. The model has ``BUCKETS`` counts for each language,
whatever the input; more than ``MAX_LANGUAGES`` names to learn are an error. A task looks at ``STEP_CHARS`` of text
together, one text at least, and remembers about ``KNOWN_WORDS`` words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import tidy

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SMOOTH = 0.2
PENALTY = 6.0
KNOWN_WORDS = 300_000
ROUNDS = 12
STEP_CHARS = 1_000_000  # of text looked at together, one text at least
MAX_LANGUAGES = 500
RUNS = re.compile(r"[^\W\d_]+")


def word_buckets(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets of the n-grams of all bracketed words, end to end, and how many each word has."""
    data = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # characters of the word from here on
    for n in ORDERS:
        h = np.full(max(len(data) - n + 1, 0), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ data[k : len(data) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield (h[left[: len(h)] >= n] % np.uint64(BUCKETS)).astype(np.int64), np.maximum(size - n + 1, 0)


def words_of(text: str | None) -> list[str]:
    return RUNS.findall((text or "").lower())


def learn(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log likelihood of every bucket in each (buckets x languages)."""
    source = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def settle(name: str) -> None:
            words = seen.pop(name)
            table = total.setdefault(name, np.zeros(BUCKETS))
            listed = list(words)
            for a in range(0, len(listed), 20_000):
                part = listed[a : a + 20_000]
                often = np.array([words[w] for w in part], dtype=float)
                for buckets, count in word_buckets(part):
                    table += np.bincount(buckets, weights=np.repeat(often, count), minlength=BUCKETS)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(name, Counter()).update(words_of(value.as_py()))
                if len(seen[name]) > KNOWN_WORDS:
                    settle(name)
        for name in list(seen):
            settle(name)
        for name, table in total.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at].astype(np.int64))], names=["lang", "bucket", "n"])

    if docs.where(F.col(lang).isNotNull()).select(lang).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    # a row for each language and bucket at most
    rows = source.mapInArrow(tidy(run), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    if names:
        place = {n: k for k, n in enumerate(names)}
        counts[rows.column("bucket").to_numpy(), [place[x] for x in rows.column("lang").to_pylist()]] = rows.column("n").to_numpy()
    used = max(int((counts.sum(axis=1) > 0).sum()), 1)
    return names, np.log((counts + SMOOTH) / (counts.sum(axis=0) + SMOOTH * used)).astype(np.float32)


class Scorer:
    """Word likelihoods of a task, kept while the word is common enough to be seen again."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, table.shape[1]), dtype=np.float32)

    def likelihoods(self, docs: list[list[str]]) -> np.ndarray:
        """Relative likelihood of each word of all documents, best language at 1 (words x languages)."""
        if len(self.ids) > KNOWN_WORDS:
            self.ids, self.rows = {}, self.rows[:0]
        known = self.ids
        at = np.array([known.setdefault(w, len(known)) for d in docs for w in d], dtype=np.int64)
        new = [w for w, i in known.items() if i >= len(self.rows)] if len(known) > len(self.rows) else []
        for a in range(0, len(new), 20_000):
            score = np.zeros((len(new[a : a + 20_000]), self.table.shape[1]))
            for buckets, count in word_buckets(new[a : a + 20_000]):
                sums = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.table[buckets], axis=0, dtype=np.float64)])
                end = np.cumsum(count)
                score += (sums[end] - sums[end - count]) / len(ORDERS)  # each order tells the word once
            score -= score.max(axis=1, keepdims=True)
            self.rows = np.concatenate([self.rows, np.exp(np.maximum(score, -12)).astype(np.float32)])
        return self.rows[at]


def proportions(p: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) within the allowed languages, and log likelihoods."""
    share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for _ in range(ROUNDS):
        r = np.repeat(share, size, axis=0)
        r *= p
        r /= np.einsum("ij->i", r)[:, None]
        new = np.add.reduceat(r, first) / size[:, None]
        moved = np.abs(new - share).max()
        share = new.astype(np.float32)
        if moved < 1e-3:
            break
    return share, np.add.reduceat(np.log(np.einsum("ij,ij->i", p, np.repeat(share, size, axis=0)) + 1e-30), first)


def infer(p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen language and its share for each document; size: its words, one at least."""
    first = np.cumsum(size) - size
    n_lang = p.shape[1]
    everything, _ = proportions(p, first, size, np.ones((len(size), n_lang), dtype=np.float32))
    order = np.argsort(-everything, axis=1, kind="stable")
    alone = np.add.reduceat(np.log(p + 1e-30), first)
    best = alone.argmax(axis=1)
    share, value = np.zeros((len(size), n_lang), dtype=np.float32), alone.max(axis=1) - PENALTY
    share[np.arange(len(size)), best] = 1
    open_ = np.arange(len(size))
    for k in range(2, n_lang + 1):
        # the next language can add its words' whole likelihood at best
        open_ = open_[everything[open_, order[open_, k - 1]] > 1e-3]
        if not len(open_):
            break
        allowed = np.zeros((len(open_), n_lang), dtype=np.float32)
        np.put_along_axis(allowed, order[open_, :k], 1, axis=1)
        pick = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in open_])
        s, like = proportions(p[pick], np.cumsum(size[open_]) - size[open_], size[open_], allowed)
        pays = like - k * PENALTY > value[open_]
        share[open_[pays]], value[open_[pays]] = s[pays], (like - k * PENALTY)[pays]
        open_ = open_[pays]
    best = share.argmax(axis=1)
    return best, share[np.arange(len(size)), best]


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", use: Column | None = None) -> DataFrame:
    """``doc, lang_pred, score`` (share of that language) of every row; learned from rows where ``use`` holds."""
    names, table = learn(docs.where(use) if use is not None else docs, text, lang)
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table)
        for batch in batches:
            size = np.cumsum(np.array(pc.fill_null(pc.utf8_length(batch.column(1)), 0), dtype=np.int64) + 1)
            for a, b in pairwise(np.unique(np.r_[0, np.flatnonzero(np.diff(size // STEP_CHARS)) + 1, batch.num_rows]).tolist()):
                part = batch.slice(a, b - a)
                listed = [words_of(t.as_py()) for t in part.column(1)]
                lettered = np.array([bool(names) and any(any(map(str.isalpha, w)) for w in d) for d in listed], dtype=bool)
                size = np.array([len(d) for d in listed], dtype=np.int64)[lettered]
                pred, score = np.full(len(listed), "und", dtype=object), np.zeros(len(listed))
                if len(size):
                    best, share = infer(scorer.likelihoods([d for d, y in zip(listed, lettered, strict=True) if y]), size)
                    pred[lettered], score[lettered] = np.array(names, dtype=object)[best], share
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc", "lang_pred", "score"])

    return source.mapInArrow(tidy(run), f"doc {kind}, lang_pred string, score double").withColumnRenamed("doc", doc)
