"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

``ROTATIONS`` rotations are learned, each from its own random start, on at most ``FIT_ROWS`` vectors (those with
the smallest hashes), centred; each gives a balanced binary code of one bit a dimension, without a projection to fewer
dimensions first. The codes together are cut into chunks of ``CHUNK`` bits.

1. Equal vectors of a label are one node with a count, so copies are never paired.
2. Nodes of a label that agree in a chunk meet in its table; by the pigeonhole principle all do whose codes differ in
   fewer bits than there are chunks. A table entry of many nodes is dealt to tiles of about ``TILE`` nodes a side, so
   that no task holds a hot entry. A pair counts in the first chunk that it agrees in, and nowhere else.
3. A pair is retrieved if its codes differ in at most ``radius`` bits: as many as those of a pair at the threshold are
   expected to, and ``SLACK`` deviations more. Nodes with such a partner meet again with their original vectors, and
   the cosine decides in double precision.
4. A tile gives a row for each of its nodes: how many others it links with, and the smallest node that it reaches in
   the tile. So the rows grow with the nodes and not with the links.

Recall against brute force is 1.0 in the tests: planted pairs from 0.98 up, and all rows of ``embeddings``.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and vectors without a
label, link with nothing. Vectors of other lengths than the most common one are coded by their leading components
or zeros, and link only with vectors of their own length. Repeated ids keep their rows. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import cut, tidy
from triweave.llm.graph import components

FIT_ROWS = 4_000
ROTATIONS = 6
ROUNDS = 30
CHUNK = 16  # bits; a chunk is read as one 16-bit number
SLACK = 6.0
TILE = 2048  # nodes on a side of a tile, about
PAIRS = 200_000  # pairs looked at together


def learn(sample: np.ndarray, seed: int) -> np.ndarray:
    """Rotation that brings the centred sample close to the corners of the cube."""
    d = sample.shape[1]
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    for _ in range(ROUNDS if len(sample) else 0):
        v = sample @ r
        u, _, wt = np.linalg.svd(np.where(v >= 0, 1.0, -1.0).T @ sample)
        r = (u @ wt).T
    return r


def unit_rows(vectors: DataFrame, vec: str, embedding: str, label: str) -> DataFrame:
    """``vec, label, unit`` (doubles as bytes; null where the vector links with nothing) of every row."""
    source = vectors.select(F.col(vec).alias("vec"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("e"))
    kinds = [source.schema[c].dataType.simpleString() for c in ("vec", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            flat = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
            size = np.array(lists.value_lengths().fill_null(0))
            ends = np.cumsum(size)
            known = np.array(b.column(1).is_valid())
            units: list[bytes | None] = [None] * b.num_rows
            for d in np.unique(size[known]).tolist():
                at = np.flatnonzero(known & (size == d))
                x = flat[(ends[at] - d)[:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    norm = np.linalg.norm(x, axis=1)
                    unit = x / norm[:, None] + 0.0  # no negative zeros
                fine = np.isfinite(norm) & (norm > 0) & np.isfinite(unit).all(axis=1)
                for k, u in zip(at[fine].tolist(), unit[fine], strict=True):
                    units[k] = u.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.binary())], names=["vec", "label", "unit"])

    return source.mapInArrow(tidy(run), f"vec {kinds[0]}, label {kinds[1]}, unit binary")


def learned(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, rotations side by side, and the typical length of a centred vector, from a bounded sample."""
    fit = [np.frombuffer(r.unit) for r in nodes.select("unit").orderBy(F.xxhash64("unit")).limit(FIT_ROWS).collect()]
    sizes = [len(x) for x in fit]
    d = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
    sample = np.array([x for x in fit if len(x) == d]) if sizes else np.zeros((0, d))
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    inner = float(np.sqrt(((sample - mean) ** 2).sum(axis=1)).mean()) if len(sample) else 1.0
    return mean, np.concatenate([learn(sample - mean, k) for k in range(ROTATIONS)], axis=1), inner


def radius(bits: int, cosine: float, inner: float) -> int:
    """Bits that the codes of a pair at the threshold may differ in.

    A bit differs with the share of the angle; centred vectors have a wider one, as their common part is gone. The
    rotations see the same vectors, so their bits may all err together.
    """
    p = min(0.5, 2 * math.asin(min(1.0, math.sqrt(max(0.0, (1 - cosine) / 2)) / max(inner, 1e-6))) / math.pi)
    return min(bits, math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)) * math.sqrt(ROTATIONS)))


def coded(nodes: DataFrame, mean: np.ndarray, rotation: np.ndarray) -> DataFrame:
    """``node, label, code`` (bytes), ``keys`` (number and bits of each chunk) of every node."""
    d, bits = rotation.shape
    chunks = -(-bits // CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, d))
            for k, u in enumerate(b.column(2).to_pylist()):
                v = np.frombuffer(u)[:d]
                x[k, : len(v)] = v
            sign = np.zeros((b.num_rows, -(-chunks // 4) * 64), dtype=bool)
            sign[:, :bits] = (x - mean) @ rotation >= 0
            code = np.packbits(sign, axis=1)
            keys = code.view(np.uint16)[:, :chunks].astype(np.int64) + (np.arange(chunks, dtype=np.int64) << CHUNK)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * chunks, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), lists], names=["node", "label", "code", "keys"])

    kind = nodes.schema["label"].dataType.simpleString()
    return nodes.select("node", "label", "unit").mapInArrow(tidy(run), f"node long, label {kind}, code binary, keys array<long>")


def dealt(codes: DataFrame) -> DataFrame:
    """``label, key, ta, tb, side, node, code``: the tiles that each node stands in; a node alone in an entry is in none."""
    at = codes.select("label", "node", "code", F.explode("keys").alias("key"))
    sizes = at.groupBy("label", "key").agg(F.count("*").alias("c")).where("c > 1")
    at = at.join(sizes, ["label", "key"]).withColumn("blocks", F.ceil(F.col("c") / TILE)).withColumn("side", F.pmod(F.xxhash64("node"), "blocks"))
    at = at.select("label", "key", "side", "node", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return at.select("label", "key", F.least("side", "other").alias("ta"), F.greatest("side", "other").alias("tb"), "side", "node", "code")


GROUP = ("label", "key", "ta", "tb")


def in_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "node")


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole tiles, and the tile number of each row."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        table = pa.Table.from_batches(held + ([b] if b is not None else [])) if held or b is not None else None
        if table is None or not table.num_rows:
            continue
        names = [table.column(k).combine_chunks() for k in range(4)]
        new = np.zeros(table.num_rows, dtype=bool)
        for c in names:
            same = pc.equal(c.slice(1), c.slice(0, len(c) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
            new[1:] |= ~same
        tile = np.cumsum(new)
        end = table.num_rows if b is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if end:
            yield table.slice(0, end), tile[:end]
        held = table.slice(end).combine_chunks().to_batches() if end < table.num_rows else []


def retrieved(table: pa.Table, tile: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows that meet in this tile and nowhere before, and whose codes differ in at most ``limit`` bits."""
    ta, tb, side = (table.column(c).to_numpy() for c in ("ta", "tb", "side"))
    chunk = table.column("key").to_numpy() >> CHUNK
    code = np.frombuffer(b"".join(table.column("code").to_pylist()), dtype=np.uint64).reshape(len(tile), -1)
    parts = code.view(np.uint16)
    first, stop = np.searchsorted(tile, tile, "left"), np.searchsorted(tile, tile, "right")
    others = np.array([np.count_nonzero(x) for x in np.split(side < tb, np.flatnonzero(np.diff(tile)) + 1)])
    row = np.arange(len(tile))
    lo = np.where(ta == tb, row + 1, first + np.repeat(others, np.bincount(tile - tile[0])))
    count = np.where((ta == tb) | (side == ta), stop - lo, 0)
    edges = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum() + PAIRS, PAIRS), "left") + 1
    for a, b in zip(np.r_[0, edges[:-1]].tolist(), edges.tolist(), strict=True):
        n = count[a:b]
        i = np.repeat(row[a:b], n)
        j = np.repeat(lo[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        apart = np.bitwise_count(code[i] ^ code[j]).sum(axis=1)
        near = apart <= limit
        i, j = i[near], j[near]
        here = (parts[i] == parts[j]).argmax(axis=1) == chunk[i]
        yield i[here], j[here]


def smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows reaches by links (i, j)."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        new = low.copy()
        for at in (i, j, low[i], low[j]):
            np.minimum.at(new, at, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    return low


def near_duplicates(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.98) -> DataFrame:
    """``vec, n_links, component_id, kept`` of every row; links are within a label, with at least the cosine."""
    rows = cut(unit_rows(vectors, vec, embedding, label))
    nodes = rows.where("unit is not null").groupBy("label", "unit").agg(F.count("*").alias("copies"), F.min("vec").alias("low"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    mean, rotation, inner = learned(nodes)
    limit = radius(rotation.shape[1], cosine, inner)
    codes = cut(coded(nodes, mean, rotation))
    kind = nodes.schema["label"].dataType.simpleString()

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tile in whole_tiles(batches):
            hit = np.zeros(table.num_rows, dtype=bool)
            for i, j in retrieved(table, tile, limit):
                hit[i] = hit[j] = True
            if hit.any():
                yield from table.select([*GROUP, "side", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    met = cut(in_tiles(dealt(codes)).mapInArrow(tidy(partners), f"label {kind}, key long, ta long, tb long, side long, node long"))
    full = met.join(codes.select("node", "code"), "node").join(nodes.select("node", "unit", "copies"), "node").select(*GROUP, "side", "node", "code", "unit", "copies")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, tile in whole_tiles(batches):
            units, copies, node = table.column("unit").to_pylist(), table.column("copies").to_numpy(), table.column("node").to_numpy()
            size = np.array([len(u) for u in units])
            ends = np.cumsum(size) // 8
            flat = np.frombuffer(b"".join(units))
            others, ii, jj = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in retrieved(table, tile, limit):
                keep = size[i] == size[j]
                for n in np.unique(size[i[keep]]).tolist():
                    spot = np.flatnonzero(keep & (size[i] == n))
                    for a in range(0, len(spot), PAIRS // 8):
                        some = spot[a : a + PAIRS // 8]
                        u, v = (flat[(ends[x[some]] - n // 8)[:, None] + np.arange(n // 8)] for x in (i, j))
                        keep[some] = np.einsum("ij,ij->i", u, v) >= cosine
                i, j = i[keep], j[keep]
                others += np.bincount(i, weights=copies[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(node)).astype(np.int64)
                ii.append(i), jj.append(j)
            low = smallest(len(node), np.concatenate(ii), np.concatenate(jj))
            some = others > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(others[some]), pa.array(node[low][some])], names=["node", "others", "reach"])

    links = cut(in_tiles(full).mapInArrow(tidy(linked), "node long, others long, reach long"))
    roots = cut(components(links, "node", "reach"))
    counts = links.groupBy("node").agg(F.sum("others").alias("others"))
    classes = nodes.join(counts, "node", "left").join(roots, "node", "left")
    classes = classes.select("label", "unit", "low", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "node").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component"))
    classes = classes.join(lows, "root").select(F.col("label").alias("_l"), F.col("unit").alias("_u"), "n", "component")
    out = rows.join(classes, (F.col("label") == F.col("_l")) & (F.col("unit") == F.col("_u")), "left")
    out = out.select(F.col("vec").alias(vec), F.coalesce("n", F.lit(0)).alias("n_links"), F.when(F.col("unit").isNull(), F.col("vec")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(vec) == F.col("component_id"), F.lit(False)))
