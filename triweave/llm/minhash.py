"""MinHash near-duplicate classes by tensored banding, every link confirmed on full shingle sets.

Two small hash collections, left and right, hold ``m`` sub-keys each, a sub-key being ``ROWS`` min-hashes. A table
key is a pair (left sub-key, right sub-key): ``m * m`` tables from ``2 * m * ROWS`` min-hashes, about the square
root of what as many separate bands would compute. ``m`` follows from the threshold so that a pair just at it is
missed with a chance of at most ``2 * MISS``.

1. One pass over the texts: size of the shingle set, a 128-bit fingerprint of it, sub-keys, and a bitmap of the
   classes that its shingles fall in.
2. Equal sets become one node, however many copies there are.
3. Table rows: every pair of a left and a right sub-key of a node that other nodes hold too, hashed to one table key; a
   pair that two nodes share is made of sub-keys that they share, so no meeting is lost. Each table entry of several
   nodes has a pivot, the node that meets most others; a node is linked, if confirmed, to at most ``STARS`` of its
   pivots, so near copies mostly join through their original, and the work is linear in the nodes.
4. Nodes of one table entry that are in different components after that are paired by their rarest shingles (``rare_pairs``),
   each pair of nodes once, unless their bitmaps prove that too few shingles can be shared; the others are confirmed.
5. Components of all confirmed links.

Defined results: null and empty texts and texts of white space have no shingles, are linked with nothing and form
their own class. Fewer words than ``words`` make one shingle of the whole sequence. Repeated rows stay repeated and
share a class. A null id is never a class id while the class has another. An empty table gives an empty result.
Only the id and text columns are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.llm.common import cut, tidy
from triweave.llm.graph import components

ROWS = 4
MISS = 1e-5
STARS = 32
CHUNK_BYTES = 1_000_000
WORDS = 16  # of 64 classes each in a bitmap
SEED = 0x7E57


def tables_for(percent: int) -> int:
    """Sub-keys in each collection."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED + salt))


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, end to end, and how many each text has."""
    joined = b" ".join(texts).lower() + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(size)
    inside = ~SPACE[data]
    start = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    stop = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    length = stop - start
    first = np.cumsum(length) - length
    at = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    salt = stream(int(length.max()), 1)
    word = mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * salt[at], first))
    lo = np.searchsorted(start, ends - size)
    hi = np.searchsorted(start, ends)
    weight = stream(words, 2)
    n = len(word) - words + 1
    runs = mix(sum((word[k : k + n] * weight[k] for k in range(words)), np.zeros(max(n, 0), np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    parts = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        if b - a >= words:
            parts.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            parts.append(mix(np.array([(word[a:b] * weight[: b - a]).sum() + np.uint64(b - a)], dtype=np.uint64)))
        else:
            parts.append(np.zeros(0, np.uint64))
    return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


def sub_keys(values: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """2 * m sub-keys of each set that starts at ``first``; left collection first."""
    a, b = stream(2 * m * ROWS, 3) | np.uint64(1), stream(2 * m * ROWS, 4)
    fold = stream(ROWS, 5) | np.uint64(1)
    out = np.empty((len(first), 2 * m), dtype=np.uint64)
    for t in range(2 * m):
        key = np.full(len(first), t + 1, dtype=np.uint64)
        for r in range(ROWS):
            j = t * ROWS + r
            key = mix(key + fold[r] * np.minimum.reduceat(values * a[j] + b[j], first))
        out[:, t] = key
    return out


def bitmaps(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """WORDS words a set: a bit for each class that has a shingle of it."""
    bits = np.zeros((len(count), WORDS * 64), dtype=bool)
    bits[np.repeat(np.arange(len(count)), count), (values % np.uint64(WORDS * 64)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def most_shared(x: str, y: str) -> F.Column:
    """Upper bound of the shingles that two sets share: each class of one that the other lacks costs one at least."""
    lacks = lambda a, b: "+".join(f"bit_count({a}_bits[{k}] & ~{b}_bits[{k}])" for k in range(WORDS))
    return F.expr(f"least({x}_n - ({lacks(x, y)}), {y}_n - ({lacks(y, x)}))")


def text_chunks(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Row offset and UTF-8 bytes of runs of texts with about CHUNK_BYTES in all."""
    start, held, size = 0, [], 0
    for k, t in enumerate(column.cast(pa.binary()).to_pylist()):
        held.append(t or b"")
        size += len(held[-1])
        if size >= CHUNK_BYTES:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def signatures(docs: DataFrame, doc: str, text: str, words: int, m: int) -> DataFrame:
    """``doc, th (hash of the text), n_shingles, fp, keys, bits`` of every row; no fp where there is no shingle."""
    source = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("_text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch.column(2)):
                values, count = shingle_sets(texts, words)
                full = count > 0
                first = (np.cumsum(count) - count)[full]
                fp, keys, bits = np.empty((len(first), 2), np.uint64), np.empty((0, 2 * m), np.uint64), np.empty((0, WORDS), np.int64)
                if len(first):
                    fp[:, 0] = np.add.reduceat(mix(values ^ stream(1, 6)), first)
                    fp[:, 1] = np.add.reduceat(mix(values ^ stream(1, 7)), first) ^ count[full].astype(np.uint64)
                    keys, bits = sub_keys(values, first, m), bitmaps(values, count[full])
                raw = fp.tobytes()
                spot = np.cumsum(full) - 1
                fps = [raw[16 * s : 16 * s + 16] if f else None for s, f in zip(spot.tolist(), full.tolist(), strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(full * w)].astype(np.int32)), pa.array(x.ravel().view(np.int64))) for w, x in ((2 * m, keys), (WORDS, bits))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), batch.column(1).slice(start, len(texts)), pa.array(count), pa.array(fps, type=pa.binary()), *lists],
                    names=["doc", "th", "n_shingles", "fp", "keys", "bits"],
                )

    return source.mapInArrow(tidy(run), f"doc {kind}, th long, n_shingles long, fp binary, keys array<long>, bits array<long>")


def set_table(docs: DataFrame, wanted: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """``node, shingles`` (sorted hashes) of the wanted nodes, from one text of each."""
    source = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    source = source.join(wanted, (source._th == wanted.th) & source._doc.eqNullSafe(wanted.doc)).select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_chunks(batch.column(1)):
                values, count = shingle_sets(texts, words)
                offsets = np.r_[0, np.cumsum(count)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], names=["node", "shingles"])

    return source.mapInArrow(tidy(run), "node long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, both`` of distinct pairs, from their full sets."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))


def table_rows(nodes: DataFrame, m: int) -> DataFrame:
    """``key, node, c`` of table keys, pairs of a left and a right sub-key, that ``c`` > 1 nodes hold."""
    held = nodes.select("node", F.posexplode("keys").alias("at", "key"))
    often = held.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    subs = cut(held.join(often, "key").select("key", "node", "at"))
    side = F.collect_list(F.when(F.col("at") < m, F.col("key"))), F.collect_list(F.when(F.col("at") >= m, F.col("key")))  # at most m each
    sides = subs.groupBy("node").agg(side[0].alias("left"), side[1].alias("right"))
    rows = sides.select("node", "right", F.explode("left").alias("x")).select("node", "x", F.explode("right").alias("y")).select(F.xxhash64("x", "y").alias("key"), "node")
    return cut(rows.join(rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"))


def rare_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """``x, y`` of the pairs of ``node, root, shingles`` with different roots that can link, each once; no such pair is missed.

    Shingles that no other root holds come first in an order of all shingles, then the others by how many nodes hold them.
    Sets that link share a shingle among the first ``n - ceil(n * percent / 100) + 1`` of both, and enough can be left
    behind their first shared one. So a node that holds more of its own than a link allows meets nothing, however large its group.
    """
    each = nodes.select("node", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s", "c")
    held = each.join(often, "s")
    order = Window.partitionBy("node").orderBy(F.desc("c"), F.desc("s"))  # from the end: shingles from this one on, itself included
    first = cut(held.withColumn("rest", F.row_number().over(order)).where(100 * F.col("rest") >= percent * F.col("n")).select("s", "node", "root", "n", "rest"))
    # of two nodes with different roots one is outside the shingle's largest component
    sizes = first.groupBy("s", "root").agg(F.count("*").alias("c"))
    major = sizes.groupBy("s").agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.count("*").alias("roots")).where("roots > 1").select("s", "major")
    met = cut(first.join(major, "s"))
    x, y = (met.select("s", "major", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "root", "n", "rest")]) for side in "xy")
    once = (F.col("y_root") == F.col("major")) | (F.col("x_node") < F.col("y_node"))
    enough = (100 + percent) * F.least("x_rest", "y_rest") >= percent * (F.col("x_n") + F.col("y_n"))
    pairs = x.where("x_root <> major").join(y.drop("major"), "s").where((F.col("x_root") != F.col("y_root")) & once & enough)
    return cut(pairs.select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y")).distinct())


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``doc, n_shingles, component_id, kept`` of every row, linking sets with Jaccard similarity of at least ``percent``/100.

    ``component_id`` is the smallest id of the class; ``kept`` marks the row that has it.
    """
    m = tables_for(percent)
    linked = 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))
    may_link = 100 * most_shared("x", "y") >= percent * (F.col("x_n") + F.col("y_n") - most_shared("x", "y"))
    rows = cut(signatures(docs, doc, text, words, m))
    # equal sets: one node each, with one text to read the set from
    nodes = rows.where("fp is not null").groupBy("fp").agg(F.min("doc").alias("low"), F.min(F.struct("doc", "th")).alias("d"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("n_shingles").alias("n"))
    nodes = cut(nodes.select("fp", "low", "d.doc", "d.th", "keys", "bits", "n", F.monotonically_increasing_id().alias("node")))
    sketch = {s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")) for s in "xy"}
    shared = table_rows(nodes, m)
    # the pivot of a table entry is its node that meets most others: near copies meet their original most
    degree = shared.groupBy("node").agg(F.sum("c").alias("degree"))
    pivot = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("p"))
    spokes = shared.join(pivot, "key").where("p.node <> node").select("node", "p").distinct()
    spokes = spokes.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p")))).where(F.col("r") <= STARS)  # m * m rows of a node at most
    star = spokes.select(F.least("p.node", "node").alias("x"), F.greatest("p.node", "node").alias("y")).distinct()
    star = cut(star.join(sketch["x"], "x").join(sketch["y"], "y").where(may_link).select(F.col("x").alias("a"), F.col("y").alias("b")))
    alive = shared.select("node").distinct()
    sets = cut(set_table(docs, nodes.join(alive, "node").select("node", "doc", "th"), doc, text, words).dropDuplicates(["node"]))
    links = cut(confirm(star, sets).where(linked).select("a", "b"))
    roots = cut(components(links, "a", "b"))
    # nodes of one table entry in different components
    label = shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = label.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = sizes.groupBy("key").agg(F.count("*").alias("roots")).where("roots > 1").select("key")
    apart = cut(label.join(several, "key").select("node", "root").distinct())
    pairs = rare_pairs(apart.join(sets, "node"), percent)
    pairs = pairs.join(sketch["x"], "x").join(sketch["y"], "y").where(may_link).select(F.col("x").alias("a"), F.col("y").alias("b")).join(star, ["a", "b"], "left_anti")
    more = cut(confirm(pairs, sets).where(linked).select("a", "b"))
    if not more.isEmpty():
        roots = cut(components(links.union(more), "a", "b"))
    classes = nodes.join(roots, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lows, "root").select(F.col("fp").alias("of"), "component_id")
    out = rows.select("doc", "n_shingles", "fp").join(classes, F.col("fp") == F.col("of"), "left")
    out = out.select(F.col("doc").alias(doc), "n_shingles", F.when(F.col("fp").isNull(), F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc) == F.col("component_id"), F.lit(False)))
