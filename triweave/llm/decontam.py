"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes tokens; numbers, names and units after numbers become typed placeholders (slots), every other word its
lower-case letters and digits. Neighbouring slots of one type are one slot, so that ``Bob`` and ``Mary Ann`` or
``1000`` and ``1 000`` have one template.

1. Windows of ``WINDOW`` template words are hashed at every place of an item and of a document. They meet in a hash
   join; each meeting is an anchor (item, document, offset).
2. An item is laid over the document at an anchor's offset. A word is the same if its template token is, there or in a
   run of ``RUN`` words at an offset up to ``SHIFTS`` words away, so inserted and dropped words cost only themselves.
   Capitalised words at sentence starts are slots if one of them is a name elsewhere in its text.
3. A document is contaminated by an item if at least ``percent`` of the item's template words are the same and its
   slots are consistent: equal values of one type in the item are equal in the document too. Slots whose values differ
   mark a re-parameterised copy.

Only windows with ``LITERALS`` plain words are looked up, since placeholders alone prove nothing; an item without such a
window is looked up by its words as written. Window hashes of the benchmark are broadcast if there are at most
``BROADCAST_WINDOWS``, anchors if at most ``BROADCAST_ANCHORS``; else both are shuffled. Window rows carry no text; the
texts of documents with an anchor are read again.

Defined results: null and empty texts, and items with fewer words than a window, match nothing. A repeated document id
gives its best match with an item; texts of millions of numbers, names or digits are read like others; rows with a null id are told apart by their text and keep the null. An empty
benchmark leaves all documents clean. Only the named columns are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import cut

WINDOW = 5
LITERALS = 3
RUN, SHIFTS = 3, 3
PERCENT = 80
BROADCAST_WINDOWS = 1_000_000
BROADCAST_ANCHORS = 200_000
# Unit words.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "watts", "volts", "hz", "mph", "kmh")

NUM, UNIT, NAME = "", "", ""
NUM_END, NAME_END = "", ""
FIRST, BLANK = "\x01", "\x03"  # sentence start, blank inside a slot
INSIDE = r"a-zA-Z0-9\p{L}\p{N}"
SEPARATORS = rf"[^{INSIDE}-]+"
SEPARATORS_WRITTEN = rf"[^{INSIDE}-\x01\x03]+"
# Each pattern begins with the rare character, so that texts are scanned fast; what stands before it is looked at then.
SENTENCE = r"(?<=(?:^|[.!?\n])\s{0,20}.)"
UPPER = rf"\p{{Lu}}(?<![{INSIDE}].)"
NAMES = rf"{UPPER}(?<!(?:^|[.!?\n])\s{{0,20}}.)\p{{Ll}}++(?![{INSIDE}])"
# Groups repeat possessively: the matcher loops over those, and recurses into others, which long texts do not survive.
NUMBERS = rf"\p{{N}}(?<![{INSIDE}].)\p{{N}}*+(?:[.,]\p{{N}}++(?![{INSIDE}]))*+(?![{INSIDE}])"


def slotted(text: Column, written: bool) -> Column:
    """Template words with a blank between; ``written`` slots keep their value and its end, words at a sentence start a mark.

    Characters that serve as marks are blanks in the text itself.
    """
    m = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01\x03-]", " ")
    m = F.regexp_replace(F.regexp_replace(m, "İ", "I"), NAMES, f"{NAME}$0{NAME_END}" if written else NAME)
    m = F.regexp_replace(m, NUMBERS, f"{NUM}$0{NUM_END}" if written else NUM)
    if written:
        m = F.regexp_replace(m, f"({UPPER}){SENTENCE}", f"{FIRST}$1")
        m = F.regexp_replace(m, rf"({NUM}\p{{N}}++|\G\p{{N}}++)[.,](?=\p{{N}})", f"$1{BLANK}")  # from mark to mark of one number
    for slot, end in ((NAME, NAME_END), (NUM, NUM_END)):  # neighbours are one slot
        m = F.regexp_replace(m, f"{end} +{slot}", BLANK) if written else F.regexp_replace(m, f"{slot}(?: ++{slot})++", slot)
    m = F.regexp_replace(F.lower(m), rf"({NUM_END if written else NUM} *)({'|'.join(UNITS)})(?![{INSIDE}])", f"$1{UNIT}" + "$2" * written)
    return F.trim(F.regexp_replace(m, SEPARATORS_WRITTEN if written else SEPARATORS, " "))


def template(text: Column) -> Column:
    """Template of a text: its template words with a blank between."""
    return slotted(text, False)


def written_tokens(text: Column) -> Column:
    """The words of the template as written: slots behind their placeholder, words at a sentence start behind its mark."""
    return F.array_remove(F.split(slotted(text, True), " "), "")


def template_of(token: Column) -> Column:
    return F.regexp_replace(token, "^([-]).*|^\x01", "$1")


def value_of(token: Column) -> Column:
    """What stands in a slot."""
    return F.translate(token, f"{BLANK}{NUM}{UNIT}{NAME}{NUM_END}{NAME_END}{FIRST}", " ")


def window_hashes(df: DataFrame, words: str) -> DataFrame:
    """``df`` without the column ``words``, with ``at, h``: place and hash of each window of words with a blank between."""
    rest = [c for c in df.columns if c != words]
    window = f"(?<![^ ])(?=({' '.join(['[^ ]++'] * WINDOW)}))[^ ]++ ?+"  # at word starts only: a long word is passed once
    return df.select(*rest, F.posexplode(F.regexp_extract_all(words, F.lit(window), 1)).alias("at", "w")).select(*rest, "at", F.xxhash64("w").alias("h"))


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def matches(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc, item, start, n_words, n_same, n_slots, n_changed``: one row, the best, for each contaminated document and item.

    ``start`` counts template words of the document. A repeated document or item id gives its best match.
    """
    source = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), written_tokens(F.col(text)).alias("a")).where(F.size("a") >= WINDOW)
    items = cut(items.select("item", F.xxhash64("a").alias("ih"), "a", F.transform("a", template_of).alias("t")))
    slots = lambda x: F.size(F.filter(x, lambda t: t.isin(NUM, UNIT, NAME)))
    plain = WINDOW - slots(F.slice("tt", F.col("at") + 1, WINDOW))
    wanted = cut(window_hashes(items.select("item", "ih", F.col("t").alias("tt"), F.array_join("t", " ").alias("t")), "t").where(plain >= LITERALS).select("item", "ih", F.col("at").alias("item_at"), "h"))

    def anchored(words: Column, wanted: DataFrame) -> DataFrame:
        found = window_hashes(source.select("doc", "th", words.alias("t")), "t")
        met = found.join(hinted(wanted, BROADCAST_WINDOWS), "h")
        return met.select("doc", "th", "item", "ih", (F.col("at") - F.col("item_at")).alias("start")).distinct()

    anchors = anchored(template(F.col("text")), wanted)
    bare = items.join(wanted.select("ih").distinct(), "ih", "left_anti")
    if not bare.isEmpty():
        values = lambda v: F.array_join(F.transform(v, lambda x: F.replace(value_of(x), F.lit(" "), F.lit("_"))), " ")
        exact = cut(window_hashes(bare.select("item", "ih", values(F.col("a")).alias("t")), "t").select("item", "ih", F.col("at").alias("item_at"), "h"))
        anchors = anchors.union(anchored(values(written_tokens(F.col("text"))), exact)).distinct()
    anchors = cut(anchors)
    # back to the texts of documents with an anchor, which are made tokens once
    own = lambda d: (F.col("th") == F.col("_th")) & F.col("doc").eqNullSafe(F.col("_doc"))  # noqa: E731, ARG005
    few = anchors.count() <= BROADCAST_ANCHORS
    hint = F.broadcast if few else lambda d: d
    named = anchors.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"))
    texts = source.join(hint(named.distinct()), own(None), "left_semi").select("doc", "th", written_tokens(F.col("text")).alias("b"))
    texts = texts.select("doc", "th", "b", F.transform("b", template_of).alias("u"))
    placed = anchors.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "ih", F.col("item").alias("_item"), "start")
    both = texts.join(hint(placed), own(None)).join(items, ["ih"]).where(F.col("item").eqNullSafe(F.col("_item")))
    out = overlaid(both).where((100 * F.col("n_same") >= percent * F.col("n_words")) & F.col("ok"))
    best = F.max(F.struct("n_same", -F.col("n_changed"), -F.col("start"), "n_words", "n_slots")).alias("m")
    out = out.groupBy("doc", F.when(F.col("doc").isNull(), F.col("th")).alias("th"), "item").agg(best)
    return out.select(F.col("doc").alias(doc), F.col("item").alias(item), (-F.col("m.col3")).alias("start"), "m.n_words", "m.n_same", "m.n_slots", (-F.col("m.col2")).alias("n_changed"))


def overlaid(both: DataFrame) -> DataFrame:
    """``doc, th, item, start, n_words, n_same, n_slots, n_changed, ok`` of items ``a, t`` laid over documents ``b, u`` at ``start``.

    Only the stretch of the document under the item is carried on. The steps are cut, since the optimiser would put an
    array's making into the loop that reads its elements.
    """
    picked = lambda v, kind: F.array_distinct(F.transform(F.filter(v, lambda x: x.startswith(kind)), value_of))
    low = F.greatest(F.col("start") - SHIFTS, F.lit(0))
    stretch = lambda v: F.slice(v, low + 1, F.greatest(F.col("start") + F.size("t") + SHIFTS - low, F.lit(0)))
    both = both.withColumn("base", F.col("start") - low).select("doc", "th", "item", "start", "base", "a", "t", stretch("b").alias("bs"), stretch("u").alias("us"), picked("b", NAME).alias("names"))
    first = F.array_union(picked("a", FIRST), picked("bs", FIRST))
    both = cut(both.select("doc", "th", "item", "start", "base", "a", "t", "bs", "us", F.array_intersect(F.array_union("names", picked("a", NAME)), first).alias("known")))

    def same(i: Column, shift: int) -> Column:
        at = F.col("base") + shift + i
        at = F.when(at >= 0, at)
        x, y = F.get("a", i), F.get("bs", at)
        names = x.startswith(FIRST) & y.startswith(FIRST) & (F.array_contains("known", value_of(x)) | F.array_contains("known", value_of(y)))
        return F.coalesce((F.get("t", i) == F.get("us", at)) | names, F.lit(False))

    shifts = sorted(range(-SHIFTS, SHIFTS + 1), key=abs)
    name = lambda s: f"s{s + SHIFTS}"
    place = F.sequence(F.lit(0), F.size("t") - 1)
    bits = lambda s: F.array_join(F.transform(place, lambda i: F.when(same(i, s), "1").otherwise("0")), "")
    hits = {s: bits(s) for s in shifts}
    for s in shifts[1:]:  # off the anchor's own offset only runs count
        for n in range(1, RUN):
            hits[s] = F.regexp_replace(hits[s], f"(?<!1)1{{{n}}}(?!1)", "0" * n)
    both = cut(both.select("doc", "th", "item", "start", "base", "a", "t", "bs", *[h.alias(name(s)) for s, h in hits.items()]))

    def pair(i: Column) -> Column:
        shift = F.coalesce(*[F.when(F.substring(F.col(name(s)), i + 1, F.lit(1)) == "1", F.lit(s)) for s in shifts])
        x, y = F.get("a", i), F.get("bs", F.when(F.col("base") + i + shift >= 0, F.col("base") + i + shift))
        kind = F.when(x.startswith(FIRST) & (value_of(x) != value_of(y)), F.lit(NAME)).otherwise(F.get("t", i))
        return F.when(shift.isNotNull(), F.struct(kind.alias("t"), value_of(x).alias("a"), value_of(y).alias("b")))

    pairs = both.select("doc", "th", "item", "start", F.size("t").alias("n_words"), F.array_compact(F.transform(place, pair)).alias("same"))
    out = pairs.select("doc", "th", "item", "start", "n_words", F.size("same").alias("n_same"), F.filter("same", lambda x: x["t"].isin(NUM, UNIT, NAME)).alias("slots"))
    return out.select("doc", "th", "item", "start", "n_words", "n_same", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda x: x["a"] != x["b"])).alias("n_changed"), consistent(F.col("slots")).alias("ok"))


def consistent(slots: Column) -> Column:
    """Equal item values of one type go to equal document values: as many distinct pairs as distinct item slots."""
    left = F.array_distinct(F.transform(slots, lambda s: F.struct(s["t"], s["a"])))
    return F.size(F.array_distinct(slots)) == F.size(left)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that no item contaminates; rows with a null id are judged by no one and stay."""
    name = f"_dirty_{uuid.uuid4().hex}"
    dirty = matches(docs, benchmark, doc=doc, text=text, percent=percent).select(F.col(doc).alias(name)).distinct()
    return docs.join(dirty, F.col(doc) == F.col(name), "left_anti")
