"""Source divergence audit: how much the term shares of each source differ from those of others and of its language.

1. *Vocabulary.* Terms are counted in their documents, and those in at least ``IN_DOCUMENTS`` documents of a language
   are kept. The kept terms are sorted over the cluster; each task builds minimal acyclic transducers of up to ``SHARD``
   terms of its range. A shard's first ordinal is the number of terms before it, so ordinals are the places in the
   whole sorted vocabulary of a language.
2. *Recount.* Texts stream through the transducers: every distinct term of a piece of text is walked once, and what
   comes out, group and ordinal, is counted. Transducers go to the tasks in packs of about ``PACK`` bytes; a larger
   vocabulary takes more passes over the texts, not more memory.
3. *Divergence.* Terms are dealt to blocks of ``BLOCK`` ordinals. A task sees whole terms, so zero counts need no rows:
   it fills a table of a block's terms by the language's sources and sums over it, in whole numbers. Sums of blocks
   are added; of a block's terms each source keeps its first ``TOP``, ordinals breaking ties, which is the order of
   the terms themselves.

No step holds a language, a source or a vocabulary in one task. The driver holds a row for each shard (name, first term,
sizes) and one pack of transducers at a time. A result has a row for each pair of sources of a language, as asked for.

Defined results: null texts, languages and sources are empty ones. Every row is a document, also if ids repeat; ids are
not read. A group without terms has all its shares equal; a language without kept terms gives pairs of value 0 and
no terms. Long texts are read whole. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.llm.bpe import chunks
from triweave.llm.common import cut, tidy
from triweave.llm.transducer import Transducer

IN_DOCUMENTS = 3
SHARE = 1000  # three times: shares are parts of 10 ** 9
TOP = 200
SHARD = 65_536  # terms of a transducer
PACK = 48_000_000  # bytes of transducers that a task holds
BLOCK = 512  # terms of a block of counts
STEP_CHARS = 4_000_000  # of text looked at together, one text at least

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_TERM = np.zeros(256, bool)  # letters A-Z and a-z, and all bytes of other characters
IS_TERM[0x41:0x5B] = IS_TERM[0x61:0x7B] = IS_TERM[0x80:] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text that each is of.

    Bytes decide: those that no term holds are single characters, so a run of the others is a run of whole characters.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    inside = IS_TERM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    begin = np.unique(offsets[:-1] - offsets[0])
    begin = begin[begin < len(data)]
    start[begin] = inside[begin]
    places = np.flatnonzero(start)
    own = LOWER[data[inside]]
    first = np.cumsum(inside, dtype=np.int32)[places] - 1
    ends = np.append(first, len(own)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(own))
    return terms, np.searchsorted(offsets - offsets[0], places, "right") - 1


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Rows of a few million characters, their terms, and the row that each term is of."""
    for b in batches:
        for a, z in chunks(b.column(b.num_columns - 1), STEP_CHARS):
            part = b.slice(a, z - a)
            terms, row = terms_of(part.column(part.num_columns - 1))
            yield part, terms.dictionary_encode(), row


def counted(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of two codes, the second below n, and how often they occur."""
    both, often = np.unique(a.astype(np.int64) * max(n, 1) + b, return_counts=True)
    return both // max(n, 1), both % max(n, 1), often


def plain(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))])


def vocabulary(rows: DataFrame) -> DataFrame:
    """``lang, term`` of the kept terms; ``rows``: ``lang, source, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, terms, row in pieces(batches):
            n = len(terms.dictionary)
            langs = part.column(0).dictionary_encode()
            doc, code, _ = counted(row, terms.indices.to_numpy(), n)
            lang, code, often = counted(langs.indices.to_numpy()[doc], code, n)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), terms.dictionary.take(pa.array(code)), pa.array(often)], names=["lang", "term", "n"])

    found = rows.select("lang", "text").mapInArrow(tidy(run), "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= IN_DOCUMENTS).select("lang", "term")


def shards(kept: DataFrame) -> DataFrame:
    """``lang, first, n, size, keys, to, skip, final, root``: transducers of ranges of a language's sorted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((lang, term.encode()) for b in batches for lang, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for lang, run in itertools.groupby(rows, key=lambda r: r[0]):
            terms = (t for _, t in run)
            while some := list(itertools.islice(terms, SHARD)):
                t = Transducer.build(some)
                parts = [x.tobytes() for x in (t.keys, t.to, t.skip, t.final)]
                columns = [lang, some[0].decode(), len(some), sum(map(len, parts)), *parts, t.root]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["lang", "first", "n", "size", "keys", "to", "skip", "final", "root"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32()]
    tasks = max(1, -(-kept.count() // SHARD))
    ordered = kept.repartitionByRange(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(tidy(run), "lang string, first string, n long, size long, keys binary, `to` binary, skip binary, final binary, root int")


class Pack:
    """Transducers of some ranges, ready to walk."""

    def __init__(self, rows: list, offsets: list[int]):
        kinds = (np.int64, np.int32, np.int64, bool)
        parts = [Transducer(*[np.frombuffer(r[c], k) for c, k in zip(("keys", "to", "skip", "final"), kinds, strict=True)], r["root"]) for r in rows]
        self.whole, self.roots = Transducer.joined(parts)
        self.offsets = np.array(offsets, np.int64)
        self.sizes = np.array([r["n"] for r in rows], np.int64)
        self.of = {lang: (k := [j for j, r in enumerate(rows) if r["lang"] == lang], np.array([rows[j]["first"].encode() for j in k], object)) for lang in {r["lang"] for r in rows}}

    def ordinals(self, lang: str, terms: pa.StringArray) -> np.ndarray:
        """Ordinal of each term in its language, -1 if this pack does not have it."""
        if lang not in self.of or not len(terms):
            return np.full(len(terms), -1, np.int64)
        own, firsts = self.of[lang]
        at = np.searchsorted(firsts, np.array([t.encode() for t in terms.to_pylist()], object), "right") - 1 if len(own) > 1 else np.zeros(len(terms), np.int64)
        shard = np.array(own)[np.maximum(at, 0)]
        data = terms.buffers()[2]
        ends = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset : terms.offset + len(terms) + 1]
        found = self.whole.ordinals(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends, self.roots[shard])
        return np.where((found >= 0) & (at >= 0), found + self.offsets[shard], -1)

    def term(self, lang: str, ordinal: int) -> str | None:
        for j in self.of.get(lang, ((), None))[0]:
            if self.offsets[j] <= ordinal < self.offsets[j] + self.sizes[j]:
                return self.whole.term(ordinal - int(self.offsets[j]), int(self.roots[j])).decode()
        return None


class Vocabulary:
    """Written transducers of all languages, given out in packs."""

    def __init__(self, kept: DataFrame):
        self.table = cut(shards(kept))
        names = sorted(self.table.select("lang", "first", "n", "size").collect(), key=lambda r: (r.lang, r["first"].encode()))
        self.spark = kept.sparkSession
        self.packs: list[list[tuple]] = []
        passed, lang, held = 0, None, 0
        for r in names:
            passed = passed if r.lang == lang else 0
            if not self.packs or held + r["size"] > PACK:
                self.packs.append([])
                held = 0
            self.packs[-1].append((r.lang, r["first"], passed))
            passed, lang, held = passed + r.n, r.lang, held + r["size"]

    def each(self) -> Iterator:
        """Broadcast packs; each is about ``PACK`` bytes, or one shard."""
        for names in self.packs:
            (a, b, _), (c, d, _) = names[0], names[-1]
            at = F.struct("lang", "first")
            rows = self.table.where((at >= F.struct(F.lit(a), F.lit(b))) & (at <= F.struct(F.lit(c), F.lit(d)))).collect()
            rows = {(r["lang"], r["first"]): r.asDict() for r in rows}
            yield self.spark.sparkContext.broadcast(([rows[x[:2]] for x in names], [x[2] for x in names]))


def recounted(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """``lang, source, ordinal, n`` of every kept term that occurs in a group."""
    out = rows.sparkSession.createDataFrame([], "lang string, source string, ordinal long, n long")
    for pack in words.each():

        def run(batches: Iterator[pa.RecordBatch], pack=pack) -> Iterator[pa.RecordBatch]:
            walked = Pack(*pack.value)
            for part, terms, row in pieces(batches):
                n = len(terms.dictionary)
                langs, sources = (part.column(k).dictionary_encode() for k in (0, 1))
                source = sources.indices.to_numpy().astype(np.int64)
                many = len(sources.dictionary)
                group, code, often = counted((langs.indices.to_numpy() * many + source)[row], terms.indices.to_numpy(), n)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    own = np.flatnonzero(group // max(many, 1) == k)
                    used, back = np.unique(code[own], return_inverse=True)
                    ordinal = walked.ordinals(lang, terms.dictionary.take(pa.array(used)))[back]
                    own, ordinal = own[ordinal >= 0], ordinal[ordinal >= 0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), sources.dictionary.take(pa.array(group[own] % max(many, 1))), pa.array(ordinal), pa.array(often[own])], names=["lang", "source", "ordinal", "n"])

        out = out.unionByName(rows.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, source string, ordinal long, n long"))
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * count / total)`` by long division, so that nothing exceeds 64 bits."""
    out, rest = np.divmod(count, total)
    for _ in range(3):
        step, rest = np.divmod(rest * SHARE, total)
        out = out * SHARE + step
    return 1 + out


def block_values(names: list[str], total: np.ndarray, v: int, at: np.ndarray, ordinal: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """``source, other, ordinal, value`` of one block: sums for pairs of sources, and first terms of each source.

    ``names`` and ``total``: sources of the language and their occurrences of kept terms; ``v``: kept terms of the
    language; ``at, ordinal, n``: source, term and count of the block's cells.
    """
    terms, row = np.unique(ordinal, return_inverse=True)
    count = np.zeros((len(terms), len(names)), np.int64)
    count[row, at] = n
    p = share(count + 1, total + v) if len(terms) else np.zeros((0, len(names)), np.int64)
    for k, name in enumerate(names):
        own = p[:, k : k + 1]
        sums = ((own - p) ** 2 // p).sum(axis=0)
        yield from ((name, other, None, int(s)) for j, (other, s) in enumerate(zip(names, sums.tolist(), strict=True)) if j != k)
    q = share(count.sum(axis=1) + 1, total.sum() + v) if len(terms) else np.zeros(0, np.int64)
    for k, name in enumerate(names):
        good = np.flatnonzero((count[:, k] > 0) & (p[:, k] > q))
        value = (p[good, k] - q[good]) ** 2 // q[good]
        first = np.lexsort((terms[good], -value))[:TOP]
        yield from ((name, None, int(terms[good][j]), int(value[j])) for j in first)


def values(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, other, ordinal, value``: partial sums for pairs (ordinal null) and candidate terms (other null).

    ``groups``: ``lang, source, total, v``. Every term of a language below v occurs somewhere, so the blocks' cells name them all.
    """
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / BLOCK))
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(0).alias("kind"), "source", F.lit(None).cast("long").alias("ordinal"), F.col("total").alias("n"), "v")
    cells = counts.select("lang", F.floor(F.col("ordinal") / BLOCK).alias("block"), F.lit(1).alias("kind"), "source", "ordinal", "n", F.lit(None).cast("long").alias("v"))
    dealt = heads.unionByName(cells).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "source")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in itertools.chain(batches, [None]):
            table = pa.Table.from_batches([*held, *([b] if b is not None else [])]) if held or b is not None else None
            if table is None or not table.num_rows:
                continue
            lang, block = (table.column(k).combine_chunks() for k in (0, 1))
            new = np.ones(table.num_rows, bool)
            new[1:] = ~(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)).to_numpy(zero_copy_only=False) & (np.diff(block.to_numpy()) == 0))
            edges = [*np.flatnonzero(new).tolist(), *([table.num_rows] if b is None else [])]
            for a, z in itertools.pairwise(edges):
                yield table.slice(a, z - a)
            held = table.slice(edges[-1]).combine_chunks().to_batches() if b is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            kind = table.column("kind").to_numpy()
            heads = int((kind == 0).sum())
            source, n = table.column("source").combine_chunks(), table.column("n").to_numpy()
            names = source.slice(0, heads)
            at = pc.index_in(source.slice(heads), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            ordinal = table.column("ordinal").combine_chunks().slice(heads).to_numpy(zero_copy_only=False).astype(np.int64)
            got = block_values(names.to_pylist(), n[:heads].astype(np.int64), table.column("v")[0].as_py(), at, ordinal, n[heads:])
            lang = table.column("lang")[0].as_py()
            while some := list(itertools.islice(got, 50_000)):
                columns = [pa.array([lang] * len(some), pa.string()), *[pa.array([s[k] for s in some], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "other", "ordinal", "value"])

    return dealt.mapInArrow(tidy(run), "lang string, source string, other string, ordinal long, value long")


def named(rows: DataFrame, words: Vocabulary) -> DataFrame:
    """``rows`` with the ``item`` of their ``lang, ordinal``, read backwards from the transducers."""
    columns = [c for c in rows.columns if c != "ordinal"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", item string"
    out = None
    for pack in words.each():

        def run(batches: Iterator[pa.RecordBatch], pack=pack) -> Iterator[pa.RecordBatch]:
            walked = None
            for b in batches:
                walked = walked or Pack(*pack.value)
                item = pa.array([walked.term(x, o) for x, o in zip(b.column("lang").to_pylist(), b.column("ordinal").to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), item], names=[*columns, "item"]).filter(item.is_valid())

        part = rows.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return rows.drop("ordinal").withColumn("item", F.lit("")).where("false") if out is None else out


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: divergence of each source from the others and from its language."""
    rows = plain(docs, text, lang, source)
    kept = cut(vocabulary(rows))
    words = Vocabulary(kept)
    counts = cut(recounted(rows, words))
    size = words.table.groupBy("lang").agg(F.sum("n").alias("v")).withColumnRenamed("lang", "_l")
    total = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(total, ["lang", "source"], "left").join(size, F.col("lang") == F.col("_l"), "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "v")]))
    found = cut(values(groups, counts))
    pairs = found.where("other is not null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = found.where("ordinal is not null").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= TOP)
    terms = named(cut(terms.select("lang", "source", "ordinal", "value", "rank")), words)
    of = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return of(pairs, "pair").unionByName(of(terms, "term"))
