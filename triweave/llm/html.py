"""Main text of web pages: the difference to the nearest page by URL, and the structure of the page itself.

1. One pass reads every page into lines, its blocks of text, and keeps a hash for each line.
2. Pages of a host with the very same lines are copies; one of them, the first by path, stands for all. Copies are no
   evidence of what a site repeats. These pages are range-partitioned by host and path; each meets the page before and
   the page after it, those of neighbouring partitions included, so results do not depend on the partitioning.
3. Of both neighbours in the host the nearer one by URL path is taken (more leading path parts in common, else the one
   before). A longest common subsequence of the two pages' lines finds what the site repeats.
4. Every line is judged, first by the difference: a repeated line is deleted, unless it stands inside an article or
   main element, where differencing would delete a sentence that two articles share. Lines that are not repeated are
   kept, but those inside menus, headers, footers, sidebars, forms, notices, adverts or comments, which have no
   neighbour to show that the site repeats them.

Defined results: null and empty pages give the empty text. Pages without a host form one host of their own; a page
without another in its host is compared with nothing. Unclosed elements end with their parent; a tag that is never
closed by ``>`` is text. Repeated rows and copies get one text. No row is dropped and no text is capped. A task holds
an Arrow batch; the largest page bounds it, in space and, but for the subsequence of two large pages, in time.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.llm.common import cut, tidy

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>\"']*+)>")  # a tag without quotes
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)")
NEXT = re.compile("[>\"']")
RAW = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")}
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
# HTML elements that begin a block, that hold no main text, and that have no end tag.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav header footer aside form button select option head menu dialog noscript object embed".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words in class, id and role names that mark what is not main text, and beginnings of names that only say what a block has.
BAD_NAME = re.compile(r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|menu|modal|nav\w*|newsletter|notice|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget|masthead|pagination|complementary|contentinfo|search)", re.I)
HEADS = frozenset(("header", "masthead"))
FRAME = frozenset("site main page top bottom left right primary secondary global list box block container wrap wrapper area section inner links buttons item".split())
MODIFIERS = frozenset(("with", "has", "have", "no", "not", "without", "is"))
SPACE = re.compile(r"\s+")
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())


def named_zone(attributes: str, zone: str) -> str:
    """Zone of an element by its class, id and role: outside if all words of a name are bad, open if only some are."""
    new = zone
    for found in NAMED.findall(attributes):
        for name in next((x for x in found if x), "").lower().split():
            words = [w for w in re.split("[_-]+", name) if w]
            if not words or words[0] in MODIFIERS:
                continue
            words = [w for w in words if w not in FRAME] or words
            bad = [BAD_NAME.fullmatch(w) is not None and not (zone == "main" and w in HEADS) for w in words]
            if all(bad):
                return "outside"
            if any(bad):
                new = "open"
    return new


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; comments and elements without text have the empty name.

    Every search goes on from where the last one ended, so the time is linear. Quotes hide a ``>`` if they are
    closed; once one on the page is not, quotes are plain characters.
    """
    at, quoted = page.find("<"), True
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find("]]>" if page.startswith("<![CDATA[", at) else ">", at)
            end = len(page) if end < 0 else end + (3 if page.startswith("<![CDATA[", at) else 1)
            yield at, end, "", False, ""
        else:
            m = TAG.match(page, at)
            if m:
                end, closing, name, attributes = m.end(), bool(m[1]), m[2].lower(), m[3]
            else:
                m = NAME.match(page, at)
                if not m:
                    at = page.find("<", at + 1)
                    continue
                end = tag_end(page, m.end()) if quoted else page.find(">", m.end()) + 1
                if not end:
                    if not quoted or page.find(">", m.end()) < 0:
                        return  # no tag can end any more
                    quoted = False
                    continue
                closing, name, attributes = bool(m[1]), m[2].lower(), page[m.end() : end - 1]
            raw = RAW.get(name)
            if raw and not closing:
                m = raw.search(page, end)
                end = len(page) if not m else page.find(">", m.end()) + 1 or len(page)
                name = ""
            yield at, end, name, closing, attributes
        at = page.find("<", end)


def tag_end(page: str, at: int) -> int:
    """Place after the ``>`` that ends a tag, quoted ones skipped; 0 if there is none."""
    while m := NEXT.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return 0
    return 0


def lines_of(page: str) -> list[tuple[str, str]]:
    """(zone, text) of each block in page order; zone: main, outside or open."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # name, zone
    count: dict[str, int] = {}  # open elements of each name
    zone, held, done = "open", [], 0

    def flush() -> None:
        if held:
            text = SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
            if text:
                out.append((zone, text))
            held.clear()

    def pop() -> str:
        name = stack.pop()[0]
        count[name] -= 1
        return name

    for start, end, name, closing, attributes in tags(page):
        if start > done:
            held.append(page[done:start])
        done = end
        if not name:
            continue
        if closing:
            if name in BLOCK:
                flush()
            if count.get(name):
                inner = [pop()]
                while inner[-1] != name:
                    inner.append(pop())
                if not BLOCK.isdisjoint(inner):
                    flush()
                zone = stack[-1][1] if stack else "open"
            continue
        if name in BLOCK:
            flush()
        if name in ENDS_P and stack and stack[-1][0] == "p":
            pop()
            zone = stack[-1][1] if stack else "open"
        new = zone
        if name == "main":
            new = "main"
        elif zone != "outside":
            if name in OUTSIDE and not (name == "header" and zone == "main"):
                new = "outside"
            elif name in MAIN:
                new = "main"
            elif attributes and name not in ("html", "body"):
                new = named_zone(attributes, zone)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            if name not in BLOCK and new != zone:
                flush()
            stack.append((name, new))
            count[name] = count.get(name, 0) + 1
            zone = new
    if done < len(page):
        held.append(page[done:])
    flush()
    return out


WORD = 4096  # lines in a block of bits
SMALL = 1 << 22  # bits of rows kept at once


def lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``b`` and each beginning of ``a``; bits in blocks, carries between them."""
    carry, out = [0] * len(b), [np.zeros(1, np.int64)]
    for lo in range(0, len(a), WORD):
        place: dict = {}
        part = a[lo : lo + WORD]
        for k, line in enumerate(part):
            place[line] = place.get(line, 0) | 1 << k
        full = (1 << len(part)) - 1
        v = full
        for j, line in enumerate(b):  # v has a zero where the length grows
            u = v & place.get(line, 0)
            s = v + u + carry[j]
            carry[j] = s >> len(part)
            v = (s | (v - u)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(part) // 8), "little"), np.uint8), bitorder="little")[: len(part)]
        out.append(out[-1][-1] + np.cumsum(1 - bits.astype(np.int64)))
    return np.concatenate(out)


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; large inputs are halved, so space stays linear."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    ends = [*range(lo), *range(len(a) - hi, len(a))]
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    common = set(x) & set(y)
    at = [k for k, line in enumerate(x) if line in common]
    x, y = [x[k] for k in at], [line for line in y if line in common]
    if not x or not y:
        return sorted(ends)
    if len(x) * len(y) <= SMALL:
        inner = traced(x, y)
    else:
        mid = len(y) // 2
        best = lengths(x, y[:mid]) + lengths(x[::-1], y[mid:][::-1])[::-1]
        cut_at = int(best.argmax())
        inner = shared_lines(x[:cut_at], y[:mid]) + [cut_at + k for k in shared_lines(x[cut_at:], y[mid:])]
    return sorted([*ends, *(lo + at[k] for k in inner)])


def traced(a: list, b: list) -> list[int]:
    """``shared_lines`` of small inputs, from one bit row for each line of ``b``."""
    place: dict = {}
    for k, line in enumerate(a):
        place[line] = place.get(line, 0) | 1 << k
    full, v, rows = (1 << len(a)) - 1, (1 << len(a)) - 1, []
    for line in b:
        u = v & place.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out: list[int] = []
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:  # no growth at i with the first j lines
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_lines(source: DataFrame) -> DataFrame:
    """``page, uh, hh, host, path, lines``: the hash of each line of every page."""
    kind = source.schema["page"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [[line_hash(t) for _, t in lines_of(h.as_py())] for h in b.column(5)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(hashes, pa.list_(pa.int64()))], names=["page", "uh", "hh", "host", "path", "lines"])

    return source.select("page", "uh", "hh", "host", "path", "html").mapInArrow(tidy(run), f"page {kind}, uh long, hh long, host string, path string, lines array<long>")


def with_neighbours(first: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after``, the (path, lines) of the pages next to each by (host, path, page), in the host.

    Rows of a partition meet in it; the rows at its ends meet those of the partitions beside it through a table of
    two rows for each partition.
    """
    ranged = cut(first.repartitionByRange("host", "path", "page", "uh", "hh").withColumn("part", F.spark_partition_id()))
    key, seen = ("host", "path", "page", "uh", "hh"), F.struct("host", "path", "lines")
    order = F.struct(*key)
    ends = ranged.groupBy("part").agg(F.min_by(seen, order).alias("low"), F.max_by(seen, order).alias("high"))
    beside = Window.orderBy("part")  # one row for each partition
    ends = ends.select(F.col("part").alias("_part"), F.lag("high").over(beside).alias("left"), F.lead("low").over(beside).alias("right"))
    inside = Window.partitionBy("part").orderBy(*key)
    met = ranged.withColumn("before", F.lag(seen).over(inside)).withColumn("after", F.lead(seen).over(inside))
    met = met.join(ends, F.col("part") == F.col("_part"), "left")
    near = lambda x, y: F.coalesce(F.col(x), F.when(F.col(x).isNull(), F.col(y)))
    own = lambda c: F.when(c["host"] == F.col("host"), F.struct(c["path"].alias("path"), c["lines"].alias("lines")))
    return met.select(*key, "lines", own(near("before", "left")).alias("before"), own(near("after", "right")).alias("after"))


def leading_parts(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def repeated(met: DataFrame) -> DataFrame:
    """``host, lines_hash, shared``: places of the lines that the nearer neighbour has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = []
            for path, lines, before, after in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                pick = before if before and (not after or leading_parts(path, before["path"]) >= leading_parts(path, after["path"])) else after
                shared.append(shared_lines(lines, pick["lines"]) if pick else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared, pa.list_(pa.int32()))], names=["host", "lh", "shared"])

    return met.select("host", F.xxhash64("lines").alias("lh"), "path", "lines", "before", "after").mapInArrow(tidy(run), "host string, lh long, shared array<int>")


def judged(lines: list[tuple[str, str]], shared: set[int]) -> tuple[str, int, int]:
    """Kept text, lines deleted by the difference, and lines deleted by structure alone."""
    kept, repeats, outside = [], 0, 0
    for k, (zone, text) in enumerate(lines):
        if zone == "main":
            kept.append(text)
        elif k in shared:
            repeats += 1
        elif zone == "outside":
            outside += 1
        else:
            kept.append(text)
    return "\n".join(kept), repeats, outside


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page, url, text, n_chars, n_repeated, n_outside`` of every row.

    ``n_repeated`` counts the lines that the difference deleted, ``n_outside`` those that structure alone did.
    """
    source = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    source = source.select("page", F.xxhash64("url").alias("uh"), F.xxhash64("html").alias("hh"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html", "url")
    kind = source.schema["page"].dataType.simpleString()
    rows = cut(page_lines(source).withColumn("lh", F.xxhash64("lines")))
    first = rows.groupBy("host", "lh").agg(F.min(F.struct("path", "page", "uh", "hh")).alias("k"), F.first("lines").alias("lines")).select("host", "k.*", "lines")
    shared = repeated(with_neighbours(first)).where(F.size("shared") > 0)
    shared = rows.select("page", "uh", "hh", F.col("host").alias("_h"), F.col("lh").alias("_l")).distinct().join(shared, (F.col("_h") == F.col("host")) & (F.col("_l") == F.col("lh")))
    shared = shared.select(F.col("page").alias("_p"), F.col("uh").alias("_u"), F.col("hh").alias("_t"), "shared")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = [zlib.compress(h.as_py().encode("utf-8", "surrogatepass"), 1) for h in b.column(4)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(small, pa.binary())], names=["page", "url", "uh", "hh", "small"])

    # pages travel once, packed, to the few numbers that were found about them
    moving = source.select("page", "url", "uh", "hh", "html").mapInArrow(tidy(packed), f"page {kind}, url string, uh long, hh long, small binary")
    both = moving.join(shared, (F.col("hh") == F.col("_t")) & (F.col("uh") == F.col("_u")) & F.col("page").eqNullSafe(F.col("_p")), "left").select("page", "url", "small", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [judged(lines_of(zlib.decompress(h.as_py()).decode("utf-8", "surrogatepass")), set(s or ())) for h, s in zip(b.column(2), b.column(3).to_pylist(), strict=True)]
            texts = [t for t, _, _ in made]
            counts = [pa.array([len(t) for t in texts], pa.int64()), *(pa.array([m[k] for m in made], pa.int64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *counts], names=["page", "url", "text", "n_chars", "n_repeated", "n_outside"])

    out = both.mapInArrow(tidy(run), f"page {kind}, url string, text string, n_chars long, n_repeated long, n_outside long")
    return out.withColumnsRenamed({"page": page, "url": url})
