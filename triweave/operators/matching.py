"""Dedupe inside a feed, blocking joins between feeds, pair scores, and the identity test."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.functions.money import currency_conflict, near_gross, plain_currency
from triweave.functions.numbers import alnum_length, counterparty_ids, known_number, norm_reference, norm_tax_id, raw_tokens, token_contains
from triweave.functions.records import completeness
from triweave.schema import OWN_TAX_ID, SOURCES, canonical_key
from triweave.storage import Cuts, cut

MIN_THRESHOLD, MAX_THRESHOLD = 50, 100  # blocks are complete from 41 up
PARTS = 4  # of a dedupe, for each core
SLOT_PAIRS = ((0, 1), (0, 2), (1, 2))
KEY_PASSES = (1, 2, 2)  # over the lists of ``join_keys``
SCORE_PASSES = 4  # that pairs are scored in, over each of their sides
SCORED = ("id", "rank", "ref", "num", "tokens", "len", "ids", "seller", "gross", "day", "cur", "cur_text")  # what scores and links read


def dedupe_key() -> Column:
    """Key of duplicates inside a feed; null where a record has nothing to be compared by."""
    number = known_number(F.col("invoice_number"))
    one, two = (F.when(F.trim(c) != "", F.col(c)) for c in ("seller_tax_id", "buyer_tax_id"))
    any_id = one.isNotNull() | two.isNotNull()
    ids = F.concat_ws(",", F.least(one, two), F.when(one.isNotNull() & two.isNotNull(), F.greatest(one, two)))
    known = F.col("issue_date").isNotNull() | F.col("gross_amount_minor").isNotNull() | any_id
    date = F.when(F.col("gross_amount_minor").isNull() & ~any_id, F.coalesce(F.col("issue_date").cast("string"), F.lit(""))).otherwise("")
    text = F.concat(F.lit("inv:"), number, F.lit("|date:"), date, F.lit("|gross:"), F.coalesce(F.col("gross_amount_minor"), F.lit(0)).cast("string"), F.lit("|cur:"), F.coalesce("currency", F.lit("")), F.lit("|tax:"), ids)
    ref = F.trim("ksef_reference")
    return F.when((F.col("source") == "ksef") & (ref != ""), F.concat(F.lit("ksef:"), ref)).otherwise(F.when(known, text))


def dedupe(feed: DataFrame) -> DataFrame:
    """One record of each key: the most complete, then the first by content. Records without a key all stay.

    Keys are dealt to several parts for each core, as a task sorts its part with the contents written out.
    """
    conf, context = feed.sparkSession.conf, feed.sparkSession.sparkContext
    parts = max(PARTS * context.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    # records without a key are dealt by their hash, and stand apart from each other's keys; a feed is read once
    keyed = feed.withColumn("_key", dedupe_key()).withColumn("_alone", F.when(F.col("_key").isNull(), F.xxhash64(*feed.columns)))
    order = Window.partitionBy("_key", "_alone").orderBy(completeness().desc(), canonical_key())
    best = keyed.repartition(parts, "_key", "_alone").withColumn("_n", F.row_number().over(order)).where("_key is null or _n = 1")
    return best.drop("_key", "_alone", "_n")


def deduped(feed: DataFrame, work: Cuts) -> tuple[DataFrame, DataFrame]:
    """``dedupe`` of a feed, and the cut of ``work`` that it is in. Only records whose key another one may have (by its hash) are dealt and sorted."""
    keyed = feed.withColumn("_key", dedupe_key())
    whole = work.cut(keyed.select(*feed.columns, F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).alias("_hash")))
    often = work.cut(whole.where("_hash is not null").groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    if often.isEmpty():
        work.drop(often)
        return whole.drop("_hash"), whole
    alone = whole.join(often, "_hash", "left_anti").drop("_hash")
    out = work.cut(alone.unionByName(dedupe(whole.join(often, "_hash", "left_semi").drop("_hash"))))
    work.drop(whole, often)
    return out, out


def duplicate_groups(feed: DataFrame) -> DataFrame:
    """``key, n, invoice_number, content_hashes, kept``: keys with several records, hashes in order."""
    keyed = feed.withColumn("key", dedupe_key()).where("key is not null")
    rank = F.struct(completeness().alias("s"), F.col("content_hash").alias("h"))
    out = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("invoice_number").alias("invoice_number"), F.array_sort(F.collect_list("content_hash")).alias("content_hashes"), F.max(rank).alias("m"))
    return out.where("n > 1").select("key", "n", "invoice_number", "content_hashes", F.col("m.h").alias("kept"))


def prepare(feed: DataFrame, own: str = OWN_TAX_ID, number: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """The comparable columns of a feed, computed once: what all blocks, scores and the assignment read.

    With the column ``number`` of ``numbered`` records go by that, not by their contents.
    """
    ident, rank = (F.col("content_hash"), canonical_key()) if number is None else (F.col(number), F.col(number))
    number = F.coalesce(F.nullif(F.col("invoice_number"), F.lit("")), F.lit(""))
    return feed.select(
        F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int").alias("slot"), ident.alias("id"), rank.alias("rank"),
        norm_reference(F.col("ksef_reference")).alias("ref"), known_number(F.col("invoice_number")).alias("num"), raw_tokens(number).alias("tokens"), alnum_length(number).alias("len"),
        counterparty_ids(F.col("seller_tax_id"), F.col("buyer_tax_id"), own).alias("ids"), norm_tax_id(F.col("seller_tax_id")).alias("seller"), F.col("gross_amount_minor").alias("gross"),
        F.col("issue_date").alias("day"), plain_currency(F.col("currency")).alias("cur"), F.trim(F.col("currency")).alias("cur_text"), *also,
    )


def numbered(feed: DataFrame) -> DataFrame:
    """Records with a ``number`` in content order, to be written once and read back; pairs and links then travel as numbers."""
    dealt = feed.repartitionByRange(canonical_key()).withColumn("_content", canonical_key())  # contents are written out behind the shuffle
    return dealt.sortWithinPartitions("_content").select(*feed.columns, F.monotonically_increasing_id().alias("number"))


def shared_id(a: str, b: str) -> Column:
    return F.arrays_overlap(f"{a}.ids", f"{b}.ids")


def score(a: str, b: str, own: str = OWN_TAX_ID) -> tuple[Column, Column]:
    """Score 0..100 and its reasons for two prepared records."""
    x, y = (lambda c, t=t: F.col(f"{t}.{c}") for t in (a, b))
    exact = F.coalesce(x("num") == y("num"), F.lit(False))
    inside = F.coalesce(token_contains(x("tokens"), y("tokens")), F.lit(False)) & x("num").isNotNull() & y("num").isNotNull()
    days = F.abs(F.datediff(x("day"), y("day")))
    gross_ok = ~currency_conflict(x("cur"), y("cur")) & near_gross(x("gross"), y("gross"))
    parts = [
        (F.coalesce(x("ref") == y("ref"), F.lit(False)), 100, "ksef_reference exact"),
        (exact, 45, "invoice_number exact"),
        (~exact & inside & (F.least(x("len"), y("len")) >= 8), 45, "invoice_number embedded exact"),
        (~exact & inside & (F.least(x("len"), y("len")) < 8), 25, "invoice_number partial"),
        (F.coalesce(shared_id(a, b), F.lit(False)), 20, "tax_id match"),
        (F.coalesce((x("seller") == y("seller")) & (x("seller") != own), F.lit(False)), 5, "seller_tax_id same position"),
        (gross_ok & (x("gross") == y("gross")), 20, "gross_amount exact"),
        (gross_ok & (x("gross") != y("gross")), 17, "gross_amount near"),
        (F.coalesce(days == 0, F.lit(False)), 10, "issue_date exact"),
        (F.coalesce(days.between(1, 7), F.lit(False)), 4, "issue_date near"),
        (F.coalesce(F.upper(x("cur_text")) == F.upper(y("cur_text")), F.lit(False)), 5, "currency match"),
    ]
    conflict = F.coalesce(x("ref") != y("ref"), F.lit(False))
    points = F.least(F.lit(100), reduce(lambda s, p: s + F.when(p[0], p[1]).otherwise(0), parts, F.lit(0)))
    reasons = F.array_compact(F.array(*[F.when(c, t) for c, _, t in parts]))
    # points stand in no branch, where what they share would be worked out again for each of them
    return points * F.when(conflict, 0).otherwise(1), F.when(conflict, F.array(F.lit("ksef_reference conflict"))).otherwise(reasons)


def identity(a: str, b: str) -> Column:
    """Same invoice whatever its score: references decide where both have one, else number and id, or number and gross."""
    x, y = (lambda c, t=t: F.col(f"{t}.{c}") for t in (a, b))
    by_amount = ~currency_conflict(x("cur"), y("cur")) & near_gross(x("gross"), y("gross"))
    by_number = F.coalesce(x("num") == y("num"), F.lit(False)) & F.when((F.size(x("ids")) > 0) & (F.size(y("ids")) > 0), F.arrays_overlap(x("ids"), y("ids"))).otherwise(by_amount)
    return F.when(x("ref").isNotNull() & y("ref").isNotNull(), x("ref") == y("ref")).otherwise(by_number)


def runs(tokens: Column) -> Column:
    """All contiguous runs of a token list, joined by ``/``."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(tokens, i, k), "/")))))


#: Without a shared id or a near amount no pair scores more, nor with both of them but no number that agrees.
UNNUMBERED_SCORE, UNDATED_SCORE, NEAR_DATE_SCORE = 60, 50, 54
WEEK = 8  # days; dates up to seven days apart lie in neighbouring stretches
SHORT = 8  # characters; a run of fewer is a partial match
TILE = 2048  # records on a side of a tile, about
BUCKET = 16  # minor units; near amounts lie in one bucket or in neighbouring ones


def blocked_pairs(left: DataFrame, right: DataFrame, threshold: int = MIN_THRESHOLD) -> DataFrame:
    """``left, right`` ids of all pairs that can qualify: equi-joins, no pair twice.

    What can qualify follows from the points. Equal references always do. Numbers that agree (equal, or one token list
    inside the other) need a shared counterparty id or a near amount to get beyond 60, and so do short token lists, such
    as a bare year, to get to 41: that is part of their join key, so a common number meets only what it can pair with.
    Without a number a pair needs a shared id and a near amount and gets 60 at most, over 50 only with near dates, over
    54 only with equal ones, so dates are in the key. Near amounts are met by exploding the five offsets of one side.
    """
    if threshold > UNNUMBERED_SCORE:
        return reduce(DataFrame.union, keyed_pairs(left, right)).distinct()
    pick = lambda j: j.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"))
    a, b = left.select("id", "ref").alias("a"), right.select("id", "ref").alias("b")
    found = [pick(a.join(b, F.col("a.ref") == F.col("b.ref")))]

    def met(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
        both = x.alias("a").join(y.alias("b"), reduce(lambda c, k: c & (F.col(f"a.{k}") == F.col(f"b.{k}")), keys, F.lit(True)))
        return pick(both)

    near = lambda d: d.where("gross <> 0").withColumn("g", F.explode(F.sequence(F.col("gross") - 2, F.col("gross") + 2)))
    exact = lambda d: d.where("gross <> 0").withColumn("g", F.col("gross"))
    by_id = lambda d: d.withColumn("one", F.explode("ids"))
    number = lambda d: d.select("id", "len", "ids", "gross", F.col("num").alias("block")).where("block <> ''")
    full = lambda d: d.select("id", "len", "ids", "gross", F.array_join("tokens", "/").alias("block")).where("block <> ''")
    part = lambda d: d.select("id", "ids", "gross", F.explode(runs(F.col("tokens"))).alias("block")).withColumn("len", alnum_length(F.col("block")))
    found.append(met(number(left), number(right), "block"))  # a number of eight characters suffices
    for x, y, by_x, by_y in ((part(left), full(right), exact, near), (full(left), part(right), near, exact)):
        found.append(met(x.where("len >= 8"), y.where("len >= 8"), "block"))
        x, y = x.where("len < 8"), y.where("len < 8")
        found += [met(by_id(x), by_id(y), "block", "one"), met(by_x(x), by_y(y), "block", "g")]  # whole numbers take the offsets, their runs are many
    x, y = (by_id(d.select("id", "ids", "gross", "day", "seller", "cur_text")) for d in (left, right))
    found += [pick(j) for j in unnumbered(x, near(x), exact(y), y, threshold)]
    return reduce(DataFrame.union, found).distinct()


def keyed_pairs(left: DataFrame, right: DataFrame) -> Iterator[DataFrame]:
    """``blocked_pairs`` above a score of 60 in passes over the keys; a pair may come in several.

    All that counts there is one key or another, so records travel as ids under the hashes of their keys. Each kind of
    key meets its own kind only, and those of runs, of which there are most, are halved.
    """
    for kind, passes in enumerate(KEY_PASSES):
        for n in range(passes):
            sides = ((left, "left", join_keys(left, True, kind)), (right, "right", join_keys(right, False, kind)))
            a, b = (keys.where(F.pmod("key", F.lit(passes)) == n).select(F.col("id").alias(c), "key") for _, c, keys in sides)
            yield a.join(b, "key").select("left", "right").distinct()


def join_keys(d: DataFrame, left: bool, kind: int) -> DataFrame:
    """``id, key``: hashes of what a record can meet others by, its reference, or its number with an id or a near amount.

    In three kinds: references and numbers, runs of the left side, runs of the right side. Numbers are met as wholes, and
    those of one side in the runs of the other; whole numbers of the right side equal to left ones are met as runs of the
    left. Amounts are in buckets: a whole number stands in both that it is near, the runs, of which there are many, in
    their own. A short run needs a shared id to get beyond 60, so it is met by ids only. Numbers are taken apart by
    exploding them, which is compiled; functions over arrays are not.
    """
    near = left if kind == 0 else left == (kind == 2)
    own = F.floor(F.col("gross") / BUCKET)
    buckets = F.array_distinct(F.array(F.floor((F.col("gross") - 2) / BUCKET), F.floor((F.col("gross") + 2) / BUCKET))) if near else F.array(own)
    none = F.array().cast("array<bigint>")
    by_id = F.transform("ids", lambda i: F.xxhash64(F.lit(0), i))
    by_amount = F.when(F.coalesce(F.col("gross") != 0, F.lit(False)), F.transform(buckets, lambda g: F.xxhash64(F.lit(1), g))).otherwise(none)
    if kind == 0:
        keys = F.transform(F.concat(by_id, by_amount), lambda k: F.xxhash64(F.lit(kind), "num", k))
        ref = F.when(F.col("ref").isNotNull(), F.array(F.xxhash64("ref"))).otherwise(none)
        return d.select("id", F.explode(F.concat(ref, F.when(F.col("num") != "", keys).otherwise(none))).alias("key"))
    d = d.select("id", "tokens", F.size("tokens").alias("_n"), by_id.alias("_ids"), F.concat(by_id, by_amount).alias("_all")).where("_n > 0")
    if near:
        text = F.array_join("tokens", "/")
    else:
        d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i")).select("*", F.explode(F.sequence(F.lit(1), F.col("_n") - F.col("_i") + 1)).alias("_k"))
        d = d if kind == 1 else d.where("_k < _n")
        text = F.array_join(F.slice("tokens", F.col("_i"), F.col("_k")), "/")
    d = d.select("id", F.xxhash64(F.lit(kind), text).alias("_run"), (F.length(F.translate(text, "/", "")) < SHORT).alias("_short"), "_ids", "_all")
    d = d.select("id", "_run", F.explode(F.when(F.col("_short"), F.col("_ids")).otherwise(F.col("_all"))).alias("_with"))
    return d.select("id", F.xxhash64("_run", "_with").alias("key"))


def unnumbered(x: DataFrame, near_x: DataFrame, exact_y: DataFrame, y: DataFrame, threshold: int) -> list[DataFrame]:
    """Joins ``a, b`` of records that share an id and a near amount, as close in time as the threshold asks for.

    An id with one amount over and over, a monthly fee, is dealt to tiles: its pairs are the result, and spread.
    """
    if threshold > NEAR_DATE_SCORE:
        return [in_tiles(near_x, exact_y, "one", "g", "day")]
    week = lambda d: d.where("day is not null").withColumn("w", F.floor(F.unix_date("day") / WEEK))
    weeks = week(near_x).withColumn("w", F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)))
    out = [in_tiles(weeks, week(exact_y), "one", "g", "w").where(F.abs(F.datediff("a.day", "b.day")) < WEEK)]
    if threshold <= UNDATED_SCORE:
        same = lambda d: d.where("gross <> 0 and seller = one").withColumn("cur", F.upper("cur_text"))
        out.append(in_tiles(same(x), same(y), "one", "gross", "cur"))  # fifty points only with all of these
    return out


def in_tiles(x: DataFrame, y: DataFrame, *keys: str) -> DataFrame:
    """Inner join ``a, b`` on keys, where a key with many records on both sides is dealt to tiles of about ``TILE`` a side.

    Counts are aggregated inside the tasks first. Hot keys are a written table, joined to both sides; of their records
    each stands in one strip of its side and meets every strip of the other.
    """
    counts = [d.groupBy(*keys).agg(F.count("*").alias(f"n{k}")) for k, d in enumerate((x, y))]
    hot = counts[0].join(counts[1], list(keys)).where((F.col("n0") > TILE) & (F.col("n1") > TILE))
    hot = cut(hot.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.ceil(F.col(f"n{k}") / TILE).alias(f"_s{k}") for k in (0, 1)]))
    on = lambda d: reduce(lambda c, k: c & (d[k] == hot[f"_{k}"]), keys, F.lit(True))
    same = lambda *more: reduce(lambda c, k: c & (F.col(f"a.{k}") == F.col(f"b.{k}")), (*keys, *more), F.lit(True))
    cold = [d.join(hot, on(d), "left_anti").alias(n) for d, n in ((x, "a"), (y, "b"))]
    strips = [d.join(hot, on(d)).withColumn(f"_t{k}", F.pmod(F.xxhash64("id"), f"_s{k}")).withColumn(f"_t{1 - k}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_s{1 - k}") - 1))) for k, d in enumerate((x, y))]
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number, as few bytes go in and many pairs come out
    dealt = [d.select(*own.columns, "_t0", "_t1").repartition(tasks, *keys, "_t0", "_t1").alias(n) for d, own, n in zip(strips, (x, y), "ab", strict=True)]
    # Both sides name their columns alike here, so that the two joins can stand below each other.
    joined = [c[0].join(c[1], same(*more)).select(*[F.struct(*[F.col(f"{n}.{f}").alias(f) for f in d.columns]).alias(n) for n, d in (("a", x), ("b", y))]) for c, more in ((cold, ()), (dealt, ("_t0", "_t1")))]
    return joined[0].union(joined[1])


def candidates(feeds: dict[str, DataFrame], threshold: int = 70, own: str = OWN_TAX_ID, made: Cuts | None = None) -> DataFrame:
    """Qualifying pairs of the three feeds: ``lslot, lid, lrank, rslot, rid, rrank, pass, score``; pass 0 reference, 1 identity, 2 score.

    Pairs are found, then scored, and each of both steps is written before the next, so that no more is on the disks at a time.
    The result stands in cuts of ``made``.
    """
    if not MIN_THRESHOLD <= threshold <= MAX_THRESHOLD:
        raise ValueError(f"threshold must be {MIN_THRESHOLD}..{MAX_THRESHOLD}")
    out = []
    for i, j in SLOT_PAIRS:
        left, right = feeds[SOURCES[i]], feeds[SOURCES[j]]
        work = Cuts(left.sparkSession)
        made = made or Cuts(left.sparkSession)
        pairs = work.cut_all(keyed_pairs(left, right) if threshold > UNNUMBERED_SCORE else [blocked_pairs(left, right, threshold)])
        met = work.cut_by((with_left(pairs, left, n) for n in range(SCORE_PASSES)), "_pass", SCORE_PASSES)
        work.drop(pairs)
        out.append(made.cut_all(scored(met, right, (i, j), threshold, own, work)))
    return reduce(DataFrame.union, out)


def score_pass(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SCORE_PASSES))


def with_left(pairs: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """``right, a`` of the pairs of a pass, told by their left records, with those, and the pass of the right one.

    Both records travel with a pair, so all at once are wide; each record is dealt once in all passes.
    """
    full = pairs.where(score_pass("left") == n).distinct().join(left.where(score_pass("id") == n).alias("a"), F.col("left") == F.col("a.id"))
    return full.select("right", F.struct(*[F.col(f"a.{c}").alias(c) for c in left.columns if c in SCORED]).alias("a"), score_pass("right").alias("_pass"))


def scored(met: list[DataFrame], right: DataFrame, slots: tuple[int, int], threshold: int, own: str, work: Cuts) -> Iterator[DataFrame]:
    """The qualifying ones of the pairs, pass by pass of their right records; what a pass has read goes."""
    points, _ = score("a", "b", own)
    kind = F.when(F.col("a.ref") == F.col("b.ref"), 0).when(identity("a", "b"), 1).when(points >= threshold, 2)
    side = lambda t, p, slot: (F.lit(slot).alias(f"{p}slot"), F.col(f"{t}.id").alias(f"{p}id"), F.col(f"{t}.rank").alias(f"{p}rank"))
    for n, pairs in enumerate(met):
        full = pairs.join(right.where(score_pass("id") == n).alias("b"), F.col("right") == F.col("b.id"))
        full = full.where(F.coalesce(F.col("a.ref") == F.col("b.ref"), F.lit(True)))
        yield full.select(*side("a", "l", slots[0]), *side("b", "r", slots[1]), kind.alias("pass"), points.alias("score")).where("pass is not null")
        work.drop(pairs)
