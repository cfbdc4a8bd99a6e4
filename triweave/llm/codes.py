"""Vector codes: equal parts of a vector, each replaced by an entry of the part's codebook, found by equal-average search.

Components become integers, ``floor(SCALE * x)``. The codebook of a part position starts as that part of the
``ENTRIES`` smallest kept ids; each of ``ROUNDS`` rounds assigns every part to its nearest entry and moves entries to
the floored mean of their parts. Nothing is sampled but the start: every round sums over all vectors, inside the tasks
first, so that a task hands over at most a row for each entry. The driver holds the codebooks only, ``ENTRIES`` vectors
for each length of vector.

*Equal-average search.* A squared distance is at least the squared gap of the component sums over the dimension. The
entries stand sorted by sum; a part looks at the entries on both sides of its own sum, the nearer first, until the gap's
bound is strictly above the best distance. Entries whose bound equals it are still looked at, so ties go to the lower
index as in a full search.

Defined results: vectors that are null or hold null or non-finite components are left out. Vectors of another length
have codebooks of their own, and a length that four does not divide gives parts that differ by one component; more
than ``LENGTHS`` lengths are an error. Integers beyond ``LIMIT`` either way count as ``LIMIT``, as distances must fit
64 bits. Rows that share an id are all coded, and in the start they stand in order of their integers; null ids come
last. With fewer than ``ENTRIES`` vectors all of them start the codebook. Null labels are one label. An empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import cut, tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
LENGTHS = 64
BLOCK = 4096  # vectors looked at together

Books = dict[int, list[np.ndarray]]  # length of vector: codebook of each part


def bounds(d: int) -> list[tuple[int, int]]:
    """First and last place of each part of a vector of d components."""
    return [(d * k // PARTS, d * (k + 1) // PARTS) for k in range(PARTS)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, and its squared distance, by equal-average search."""
    n, w = x.shape
    if not w:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums, book = sums[order], book[order]
    own = x.sum(axis=1)
    hi = np.searchsorted(sums, own)
    lo = hi - 1
    best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, len(book))
    live, far = np.arange(n), 1 << 40
    while len(live):
        down = np.where(lo[live] >= 0, own[live] - sums[np.maximum(lo[live], 0)], far)
        up = np.where(hi[live] < len(sums), sums[np.minimum(hi[live], len(sums) - 1)] - own[live], far)
        gap = np.minimum(down, up)
        # gap * gap / w > best, in whole numbers; a side that has ended is beyond every bound
        more = (gap < far) & (gap * gap // w + (gap * gap % w > 0) <= best[live])
        live, below = live[more], (down <= up)[more]
        at = np.where(below, lo[live], hi[live])
        lo[live[below]] -= 1
        hi[live[~below]] += 1
        gone = x[live] - book[at]
        apart = np.einsum("ij,ij->i", gone, gone)
        better = (apart < best[live]) | ((apart == best[live]) & (order[at] < index[live]))
        best[live[better]], index[live[better]] = apart[better], order[at[better]]
    return index, best


def integers(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and integer components of the kept vectors of a batch, by length."""
    lists = b.column(at)
    flat = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    size = np.array(lists.value_lengths().fill_null(0))
    ends = np.cumsum(size)
    known = np.array(lists.is_valid())
    for d in np.unique(size[known]).tolist():
        rows = np.flatnonzero(known & (size == d))
        for k in range(0, len(rows), BLOCK):
            some = rows[k : k + BLOCK]
            x = flat[(ends[some] - d)[:, None] + np.arange(d)] if d else np.zeros((len(some), 0))
            fine = np.isfinite(x).all(axis=1)
            yield d, some[fine], np.clip(np.floor(SCALE * x[fine]), -LIMIT, LIMIT).astype(np.int64)


def start(rows: DataFrame) -> Books:
    """Codebooks of the smallest kept ids of each length; ``rows``: ``vec, label, e``."""
    kind = rows.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple]] = {}
        for b in batches:
            for d, some, x in integers(b, 2):
                ids = b.column(0).take(pa.array(some)).to_pylist()
                new = [((i is None, i), row) for i, row in zip(ids, x.tolist(), strict=True)]
                new.sort(key=lambda r: (r[0][0], 0 if r[0][0] else r[0][1], r[1]))
                kept[d] = sorted([*kept.get(d, []), *new[:ENTRIES]], key=lambda r: (r[0][0], 0 if r[0][0] else r[0][1], r[1]))[:ENTRIES]
        got = [(i[1], d, x) for d, some in kept.items() for i, x in some]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], b.schema.field(0).type), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.list_(pa.int64()))], names=["vec", "d", "x"])

    firsts = cut(rows.mapInArrow(tidy(run), f"vec {kind}, d int, x array<long>"))
    lengths = sorted(r.d for r in firsts.select("d").distinct().limit(LENGTHS + 1).collect())
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    books = {}
    for d in lengths:
        some = firsts.where(F.col("d") == d).orderBy(F.col("vec").asc_nulls_last(), "x").limit(ENTRIES).collect()
        x = np.array([r.x for r in some], dtype=np.int64).reshape(len(some), d)
        books[d] = [x[:, a:z] for a, z in bounds(d)]
    return books


def moved(rows: DataFrame, books: Books) -> Books:
    """Codebooks after one round: each entry the floored mean of the parts that are assigned to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {d: [np.zeros(len(c), np.int64) for c in own] for d, own in books.items()}
        sums = {d: [np.zeros(c.shape, np.int64) for c in own] for d, own in books.items()}
        for b in batches:
            for d, _, x in integers(b, 2):
                for p, (a, z) in enumerate(bounds(d)):
                    index, _ = nearest(x[:, a:z], books[d][p])
                    counts[d][p] += np.bincount(index, minlength=len(counts[d][p]))
                    np.add.at(sums[d][p], index, x[:, a:z])
        got = [(d, p, k, int(n), sums[d][p][k].tolist()) for d in books for p in range(PARTS) for k, n in enumerate(counts[d][p]) if n]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], names=["d", "part", "entry", "n", "x"])

    got = rows.mapInArrow(tidy(run), "d int, part int, entry int, n long, x array<long>")
    got = got.select("d", "part", "entry", "n", F.posexplode_outer("x").alias("place", "x")).groupBy("d", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    new = {d: [c.copy() for c in own] for d, own in books.items()}
    for r in got.where("place is not null").collect():  # a row for each component of the codebooks
        new[r.d][r.part][r.entry, r.place] = r.x // r.n
    return new


def sha(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in books for v in c.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Books]:
    """``vec, label, code, error, codebooks_sha256`` of every kept vector, and the codebooks by length of vector."""
    rows = vectors.select(F.col(vec).alias("vec"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    books = start(rows)
    for _ in range(ROUNDS):
        books = moved(rows, books)
    digest = {d: sha(own) for d, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, some, x in integers(b, 2):
                found = [nearest(x[:, a:z], books[d][p]) for p, (a, z) in enumerate(bounds(d))]
                code = [bytes(c).hex() for c in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
                error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(code, pa.string()), pa.array(error), pa.array([digest[d]] * len(some), pa.string())], names=["vec", "label", "code", "error", "codebooks_sha256"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec", "label")]
    return rows.mapInArrow(tidy(run), f"vec {kinds[0]}, label {kinds[1]}, code string, error long, codebooks_sha256 string"), books


def decode(code: str, books: list[np.ndarray]) -> np.ndarray:
    """Vector that a code stands for, in the original scale."""
    return np.concatenate([c[int(code[2 * p : 2 * p + 2], 16)] for p, c in enumerate(books)]) / SCALE


def report(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec, code, error, label_error, codebooks_sha256`` of every kept vector; errors that exceed 64 bits in sum are null."""
    coded = cut(encode(vectors, vec, embedding, label)[0])
    # Written first: its size is then known, and a large one is joined by label with skewed parts split.
    sums = cut(coded.groupBy(F.col("label").alias("_l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_s")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l")), "left")
    return out.select(F.col("vec").alias(vec), "code", "error", F.col("_s").try_cast("long").alias("label_error"), "codebooks_sha256")
