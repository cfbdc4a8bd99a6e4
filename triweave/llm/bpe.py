"""Byte-pair encoding and decoding with a pair occurrence index.

The vocabulary is a ``tokenizers`` JSON file given by path. A partition's texts are split into words; every
distinct word is laid out once in one long symbol array, and an index maps each mergeable pair to all of its
positions there. Ranks that occur are applied in ascending order over all positions at once; only the pairs next
to a merge are re-indexed. Words are independent, so this equals merging word by word.

Defined results: a null text counts as empty and gives no ids; a text of white space gives no ids (word
vocabulary); repeated rows are encoded each; no row is dropped. Only the named id columns are carried over, so
further columns of the input, whatever their names, do not matter. Memory is bounded by ``CHUNK_CHARS`` of text
plus ``MAX_WORDS`` distinct words, and by the longest single text.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re as std_re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import give_back, tidy

CHUNK_CHARS = 1_000_000
MAX_WORDS = 120_000

# Unicode White_Space, as the vocabulary files' patterns mean by \s.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
# Fixed value: the word pattern of byte-level vocabularies; its words of letters, which nothing else fits, are tried first.
BYTE_LEVEL = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def decimal_latin(text: str) -> bool:
    """Latin-1 text whose numbers are all decimal digits."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return not any(c in text for c in "²³¹¼½¾")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Vocabulary:
    """Ids, merges, text rules and added tokens of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError("only BPE vocabularies are read")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.tokens: list[str] = [""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in model["vocab"].items():
            self.tokens[i] = token
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = std_re.compile("(" + "|".join(std_re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.merge_ids = np.array([[ids[a], ids[b], ids[a + b]] for a, b in pairs], dtype=np.int32).reshape(-1, 3)
        alphabet = byte_alphabet()
        self.byte_ids = np.array([ids[c] for c in alphabet], dtype=np.int32)
        self.last_ids = np.array([ids[c + self.suffix] for c in alphabet], dtype=np.int32)
        names = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.nfc, self.lower = "NFC" in names, "Lowercase" in names
        split = [p["pattern"]["Regex"] for p in (spec["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"]
        self.keeps_all = not split
        self.pattern = (split[0] if split else BYTE_LEVEL).replace(r"\S", f"[^{WHITE}]").replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]")
        self.ascii_pattern = self.pattern.replace(r"[\p{L}]", "[A-Za-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "A-Za-z" if split else "[A-Za-z]").replace(r"\p{N}", "0-9" if split else "[0-9]")
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.token_bytes: list[bytes] | None = None
        if self.bytewise:
            back = {c: b for b, c in enumerate(alphabet)}
            special = set(self.added)
            self.token_bytes = [t.encode() if t in special else bytes(back[c] for c in t) for t in self.tokens]

    def normalise(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower() would turn a word's last capital sigma into another letter than the character rule does
        return text.replace("Σ", "σ").lower() if self.lower else text


class Places(dict):
    """Place of each word; a word that is asked for first gets the next one."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Codec:
    """Encodes and decodes texts with a vocabulary; one per task."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.v = Vocabulary(path)
        self.words_of = regex.compile(self.v.pattern).findall
        letters = self.v.ascii_pattern
        if self.v.keeps_all:
            letters = letters.replace(f"[^{WHITE}[A-Za-z][0-9]]", f"[^{WHITE}A-Za-z0-9]")
        self.ascii_words_of = std_re.compile(letters, std_re.ASCII).findall
        # where all numbers are decimal digits, the standard library's classes are the same and faster
        plain = self.v.pattern.replace(f"[^{WHITE}\\p{{L}}\\p{{N}}]", f"(?:(?![{WHITE}])[\\W_])")
        for name, same in ((r"[\p{L}]", r"[^\W\d_]"), (r"[\p{N}]", r"\d"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
            plain = plain.replace(name, same)
        self.plain_words_of = std_re.compile(plain).findall
        self.max_words = max_words
        self.forget()

    def forget(self, keep: int = 0) -> None:
        """Forget all words but those that were met most."""
        names = list(self.ids) if keep else []
        best = np.argsort(-self.uses, kind="stable")[:keep] if keep else np.zeros(0, np.int64)
        self.flat, self.size = (self.joined(best), self.size[best]) if keep else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        self.uses = self.uses[best] // 2 if keep else np.zeros(0, np.int64)
        self.ids = Places({names[k]: n for n, k in enumerate(best.tolist())})
        self.start = np.cumsum(self.size) - self.size

    def split(self, text: str) -> list[str]:
        """Words of a text in order; an added token is a word of its own, told by a leading NUL."""
        v, out = self.v, []
        parts = v.added_pattern.split(text) if any(t in text for t in v.added) else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append("\0" + part)
            elif part:
                part = v.normalise(part)
                out += self.ascii_words_of(part) if part.isascii() else self.plain_words_of(part) if decimal_latin(part) else self.words_of(part)
        return out

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text; the new words of all of them are merged together."""
        if len(self.ids) > self.max_words:
            self.forget(self.max_words // 2)
        known, before = self.ids, len(self.ids)
        listed = []
        for text in texts:
            words = self.split(text)
            listed.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        if len(known) > before:
            flat, size = self.merged(list(itertools.islice(known, before, None)))
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.start = np.cumsum(self.size) - self.size
            self.uses = np.concatenate([self.uses, np.zeros(len(known) - before, np.int64)])
        if listed:
            self.uses += np.bincount(np.concatenate(listed), minlength=len(known))
        return [self.joined(words) for words in listed]

    def joined(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.int32)
        size = self.size[words]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[words] - (ends - size), size) + np.arange(ends[-1])]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and how many each has: one symbol array for all, merged rank by rank through the index."""
        v = self.v
        raw = [b"" if w[0] == "\0" and w[1:] in v.added else w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(b) for b in raw], dtype=np.int64)
        ends, data = np.cumsum(size), np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym, n = v.byte_ids[data], len(data)
        last = ends[size > 0] - 1
        sym[last] = v.last_ids[data[last]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[last] = -1
        before[(ends - size)[size > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Index the pairs that start at these positions and can merge."""
            key = sym[at].astype(np.int64) << 32 | sym[after[at]]
            spot = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            hit = v.pair_keys[spot] == key
            rank, at = v.pair_ranks[spot[hit]], at[hit]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            edges = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, edges]].tolist(), np.split(at, edges) if len(edges) else [at], strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(part)

        add(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            a, b, c = v.merge_ids[r].tolist()
            at = found[0] if len(found) == 1 else np.concatenate(found)
            nxt = after[at]
            at = at[(sym[at] == a) & (nxt >= 0) & (sym[nxt] == b)]  # what an earlier merge took is gone
            if len(found) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair merges, from the left
                follows = np.r_[False, after[at[:-1]] == at[1:]]
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(follows, 0, k))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            sym[at], sym[gone], after[at] = c, -1, beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            left = before[at]
            add(np.unique(np.concatenate([left[left >= 0], at[has]])))
        alive = sym >= 0
        kept = np.r_[0, np.cumsum(alive)]
        flat, size = sym[alive], kept[ends] - kept[ends - size]
        special = [k for k, w in enumerate(words) if w[0] == "\0" and w[1:] in v.added]
        if special:
            flat = np.insert(flat, (np.cumsum(size) - size)[special], [v.added[words[k][1:]] for k in special])
            size[special] = 1
        return flat, size

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes put together for byte-level decoders, else the tokens with one space between."""
        if self.v.bytewise:
            return b"".join(map(self.v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), type=kind))


def chunks(column: pa.Array, chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many characters of text each."""
    ends = np.cumsum(np.array(pc.fill_null(pc.utf8_length(column), 0), dtype=np.int64))
    edges = np.flatnonzero(np.diff(ends // chars)) + 1
    return itertools.pairwise(np.unique(np.r_[0, edges, len(column)]).tolist())


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns plus ``token_ids array<int>`` and, with ``decoded``, the decoded text of those ids."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", token_ids array<int>" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        give_back()  # what the vocabulary file took to read
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in chunks(column):
                ids = codec.encode(column.slice(a, b - a).to_pylist())
                arrays = [batch.column(k).slice(a, b - a) for k in range(len(keep))] + [list_array(ids, pa.int32())]
                if decoded:
                    arrays.append(pa.array([codec.decode(x) for x in ids], type=pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "token_ids", *["decoded"] * decoded])

    return source.mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, path: str, ids: str = "token_ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns plus ``text``; null ids give the empty text."""
    source = tokens.select(*keep, F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            flat, offsets = column.flatten().to_numpy(), np.asarray(column.offsets) - column.offsets[0].as_py()
            texts = [codec.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, type=pa.string())], names=[*keep, "text"])

    return source.mapInArrow(tidy(run), schema)
