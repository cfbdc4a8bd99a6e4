"""Token ids as patched frame-of-reference blocks, written and read by Spark.

Documents are range-partitioned and sorted by id, encoded, and cut into segments of whole documents with about
``SEGMENT`` ids. A segment is one row of a Parquet data set, so any store that Spark writes to will do; its
``payload`` is

    magic "PFR1", uint32: documents, ids, block length, blocks
    uint32 ids of each document, uint32 start of each block in the block area
    blocks: uint32 minimum, uint8 width, uint8 exceptions, packed words (little-endian uint64),
            uint8 place and uint32 value of each exception

A block subtracts its minimum, packs at the width that ``PERCENTILE`` of its ids fit in, and lists the others as
exceptions, so one block can be read without its neighbours.

Defined results: a null text counts as empty and gives the end id alone; null document ids come first; repeated ids
are ordered by their texts' hash, and all are kept. An empty table gives an empty data set. Only the id and text
columns are read. A segment holds at least one whole document, so memory is bounded by the longest single text. Long
runs of blanks or line feeds are one word of their length.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.llm.common import tidy

from triweave.llm import bpe

SEGMENT = 262_144
BLOCK = 128
PERCENTILE = 0.9
MAX_WORDS = 400_000  # distinct words that a worker remembers
STEP = 4_096  # words asked for at once
CHARS = 1_000_000  # of text encoded at once
MAGIC = b"PFR1"


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float32 if x.size and x.max() < 1 << 24 else np.float64))[1].astype(np.uint8)  # bit length of non-negative integers


def pack(d: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values under 2**width as rows of uint64 words."""
    out = np.zeros(((BLOCK * width + 63) // 64, len(d)), dtype=np.uint64)
    columns = np.ascontiguousarray(d.T, dtype=np.uint64)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(words), BLOCK), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = (x & mask).astype(np.uint32)
    return out


def write_segment(docs: list[np.ndarray]) -> bytes:
    """Payload of a run of documents' ids."""
    ids = np.concatenate([*docs, np.zeros(0, np.uint32)]).astype(np.uint32)
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)
    full[: len(ids)] = ids
    blocks = full.reshape(n, BLOCK)
    low = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    d = blocks - low[:, None]
    need = _bits(d)
    width = np.partition(need, int(np.ceil(PERCENTILE * BLOCK)) - 1, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1] if n else np.zeros(0, np.uint8)
    odd = need > width[:, None]
    count = odd.sum(axis=1)
    packed = packed_bytes(width)
    size = 6 + packed + 5 * count
    starts = np.cumsum(size) - size
    area = np.zeros(int(size.sum()), np.uint8)
    area[starts[:, None] + np.arange(4)] = low.astype("<u4")[:, None].view(np.uint8)
    area[starts + 4], area[starts + 5] = width, count
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        words = pack(np.where(odd[at], 0, d[at]), w).astype("<u8").view(np.uint8)
        area[(starts[at] + 6)[:, None] + np.arange(words.shape[1])] = words
    k, place = np.nonzero(odd)
    to, value_to = exceptions(starts + 6 + packed, count)
    area[to] = place
    area[value_to[:, None] + np.arange(4)] = d[k, place].astype("<u4")[:, None].view(np.uint8)
    head = MAGIC + struct.pack("<IIII", len(docs), len(ids), BLOCK, n)
    return head + np.array([len(x) for x in docs], dtype="<u4").tobytes() + starts.astype("<u4").tobytes() + area.tobytes()


def packed_bytes(width: np.ndarray) -> np.ndarray:
    return (BLOCK * width.astype(np.int64) + 63) // 64 * 8


def exceptions(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where the places, and where the values, of all exceptions stand; ``start``: where a block's list does."""
    count = count.astype(np.int64)
    before = np.cumsum(count) - count
    n = np.arange(int(count.sum()))
    return np.repeat(start - before, count) + n, np.repeat(start + count - 4 * before, count) + 4 * n


def read_segment(payload: bytes) -> list[np.ndarray]:
    """Ids of each document of a payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_ids, _, n = struct.unpack_from("<IIII", payload, 4)
    sizes = np.frombuffer(payload, "<u4", n_docs, 20)
    starts = np.frombuffer(payload, "<u4", n, 20 + 4 * n_docs).astype(np.int64)
    area = np.frombuffer(payload, np.uint8, offset=20 + 4 * n_docs + 4 * n)
    byte = lambda k: area[starts + k]
    low = sum(byte(k).astype(np.uint32) << np.uint32(8 * k) for k in range(4)) if n else np.zeros(0, np.uint32)
    width, count = (byte(4), byte(5)) if n else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw = area[(starts[at] + 6)[:, None] + np.arange((BLOCK * w + 63) // 64 * 8)]
        out[at] = unpack(np.ascontiguousarray(raw).view("<u8"), w)
    at, value_at = exceptions(starts + 6 + packed_bytes(width), count)
    values = np.ascontiguousarray(area[value_at[:, None] + np.arange(4)]).view("<u4")[:, 0] if len(at) else np.zeros(0, np.uint32)
    out[np.repeat(np.arange(n), count), area[at]] = values
    flat = (out + low[:, None]).ravel()[:n_ids]
    return np.split(flat, np.cumsum(sizes)[:-1]) if n_docs else []


class LibraryCodec(bpe.Codec):
    """Ids as the ``tokenizers`` library gives them; it is asked once for each distinct word of a task."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path, MAX_WORDS)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.token_sizes = np.array([len(b) for b in self.v.token_bytes], dtype=np.int64) if self.v.bytewise else None  # in bytes, if ids spell all bytes

    def side_by_side(self, words: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each begin with the only blank in them, end to end, and how many each has."""
        if self.token_sizes is None:
            out = self.library.encode(words, add_special_tokens=False)
            return np.array(out.ids, dtype=np.int32), np.bincount(np.array(out.word_ids, dtype=np.int64), minlength=words.count(" "))
        ids = np.array(self.library.encode_batch_fast([words], add_special_tokens=False)[0].ids, dtype=np.int32)
        starts = np.flatnonzero(np.frombuffer(words.encode(), np.uint8) == ord(" "))
        ends = np.cumsum(self.token_sizes[ids])
        return ids, np.diff(np.searchsorted(ends, starts, side="right"), append=len(ids))

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w[1:] if w[0] == "\0" and w[1:] in self.v.added else w for w in words]
        joins = np.fromiter((w[0] == " " and w[1:].isalpha() for w in plain), bool, len(plain))
        size, found = np.zeros(len(plain), np.int64), []
        for a in range(0, len(plain), STEP):  # the library's own results are large
            at = np.flatnonzero(joins[a : a + STEP]) + a
            # words of a blank and letters stay words side by side, so one call does for many
            ids_of, size[at] = self.side_by_side("".join(map(plain.__getitem__, at.tolist())))
            rest = np.flatnonzero(~joins[a : a + STEP]) + a
            ids = [e.ids for e in self.library.encode_batch_fast([plain[k] for k in rest.tolist()], add_special_tokens=False)]
            size[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append((at, ids_of))
            found.append((rest, np.fromiter(itertools.chain.from_iterable(ids), np.int32)))
        start = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        for at, ids in found:
            n = size[at]
            flat[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size


@functools.lru_cache(1)
def library_codec(path: str) -> LibraryCodec:
    """One for a Python worker, as reading a vocabulary takes a while."""
    return LibraryCodec(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, doc: str = "doc_id", text: str = "text") -> None:
    """Write the data set: documents in ascending id order, ``end_id`` after each."""
    source = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()
    source = source.repartitionByRange("doc", "th").sortWithinPartitions("doc", "th").select("doc", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = library_codec(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.uint32)
        before = held = 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            docs_of = pa.concat_arrays(names)
            lists = pa.ListArray.from_arrays(pa.array([0, len(docs_of)], pa.int32()), docs_of)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), lists, pa.array([write_segment(ids)], pa.binary())], names=["part", "before", "n_ids", "docs", "payload"])

        for batch in batches:
            first = 0
            texts = batch.column(1)
            found = (x for a, b in bpe.chunks(texts, CHARS) for x in codec.encode(texts.slice(a, b - a).to_pylist()))
            for k, of in enumerate(found):
                x = np.concatenate([of.astype(np.uint32), end])
                ids.append(x)
                held += len(x)
                if held >= SEGMENT:
                    names.append(batch.column(0).slice(first, k + 1 - first))
                    yield flush()
                    before, held, names, ids, first = before + held, 0, [], [], k + 1
            if first < batch.num_rows:
                names.append(batch.column(0).slice(first))
        if ids:
            yield flush()

    source.mapInArrow(tidy(run), f"part int, before long, n_ids long, docs array<{kind}>, payload binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """``doc, start`` (ids of all documents before it), ``n_tokens, ids`` (little-endian uint32) of a data set."""
    segments = spark.read.parquet(path)
    kind = segments.schema["docs"].dataType.elementType.simpleString()
    # one row for each written partition: bounded by their number, whatever the input
    bases = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = bases.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    segments = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "docs", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = read_segment(batch.column(2)[k].as_py())
                size = np.array([len(x) for x in parts], dtype=np.int64)
                start = batch.column(0)[k].as_py() + np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([batch.column(1)[k].values, pa.array(start), pa.array(size), pa.array([x.astype("<u4").tobytes() for x in parts], pa.binary())], names=[doc, "start", "n_tokens", "ids"])

    return segments.mapInArrow(tidy(run), f"`{doc}` {kind}, start long, n_tokens long, ids binary")
