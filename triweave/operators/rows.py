"""Three-way rows: building, status, merge of duplicates, display record, summary, keys."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.functions.money import plain_currency
from triweave.functions.numbers import alnum_length, canonical_number, counterparty_ids, is_valid_number, known_number, norm_reference, norm_tax_id, raw_tokens
from triweave.functions.records import OVERRIDE_PREFIX, WEIGHTS, useful_party
from triweave.operators.assignment import assign
from triweave.operators.matching import candidates, deduped, numbered, prepare, score
from triweave.schema import COLUMNS, OWN_TAX_ID, SOURCES
from triweave.storage import Cuts

# Status by presence of mail, registry and ledger.
STATUS = {(1, 1, 1): "in_all_three", (1, 1, 0): "gmail_ksef_missing_saldeo", (1, 0, 1): "gmail_saldeo_missing_ksef", (1, 0, 0): "gmail_only", (0, 1, 1): "ksef_saldeo_missing_gmail", (0, 1, 0): "ksef_only", (0, 0, 1): "saldeo_only", (0, 0, 0): "empty"}
PAIRS = (("mail", "ksef"), ("mail", "saldeo"), ("ksef", "saldeo"))
PASSES = 4  # that whole records are shuffled in; the disks hold the shuffle files of one of them


def status() -> Column:
    out = F.lit("empty")
    for have, name in STATUS.items():
        cond = F.lit(True)
        for s, h in zip(SOURCES, have, strict=True):
            cond &= F.col(s).isNotNull() if h else F.col(s).isNull()
        out = F.when(cond, name).otherwise(out)
    return out


def with_scores(rows: DataFrame, own: str = OWN_TAX_ID) -> DataFrame:
    """Adds status and the scores of the members' pairs to rows of three record structs."""
    # nothing in a branch but the last step: what a branch works out is worked out again wherever it is read
    out = rows.select("*", *[F.struct(*[x.alias(c) for c, x in _prepared(s, own).items()]).alias(f"_{s}") for s in SOURCES])
    for a, b in PAIRS:
        both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 0)
        out = out.withColumn(f"{a}_score_to_{b}", score(f"_{a}", f"_{b}", own)[0] + both)
    return out.withColumn("status", status()).drop(*[f"_{s}" for s in SOURCES])


def _prepared(s: str, own: str) -> dict[str, Column]:
    """The columns of ``matching.prepare`` for a record struct."""
    c = lambda n: F.col(f"{s}.{n}")
    number = F.coalesce(c("invoice_number"), F.lit(""))
    return {
        "ref": norm_reference(c("ksef_reference")), "num": known_number(c("invoice_number")), "tokens": raw_tokens(number), "len": alnum_length(number),
        "ids": counterparty_ids(c("seller_tax_id"), c("buyer_tax_id"), own), "seller": norm_tax_id(c("seller_tax_id")), "gross": c("gross_amount_minor"),
        "day": c("issue_date"), "cur": plain_currency(c("currency")), "cur_text": F.trim(c("currency")),
    }


def in_pass(n: int, key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PASSES)) == n


def build_rows(ids: DataFrame, feeds: dict[str, DataFrame], work: Cuts, own: str = OWN_TAX_ID) -> DataFrame:
    """``_row``, its three record structs and ``_key`` of rows of record numbers.

    The records of a feed are given their row, and the feed is deleted; then the records of a row meet. So a record
    moves twice, however many others its row has. What is placed lies apart by pass, and goes once its pass is written.
    """
    placed = {}
    for s in SOURCES:
        records = feeds[s].select("number", F.struct(*COLUMNS).alias(s))
        of = ids.select("_row", F.col(s).alias("number")).join(records, "number").select("_row", s, F.pmod(F.xxhash64("_row"), F.lit(PASSES)).alias("_pass"))
        placed[s] = work.cut_by(of, "_pass", PASSES)
        work.drop(feeds[s])

    def joined() -> Iterator[DataFrame]:
        for n in range(PASSES):
            out = ids.select("_row").where(in_pass(n, "_row"))
            for s in SOURCES:
                out = out.join(placed[s][n], "_row", "left")
            yield out.withColumn("_key", merge_key(own))
            work.drop(*[placed[s][n] for s in SOURCES])

    out = work.cut_all(joined())
    work.drop(ids)
    return out


def primary() -> Column:
    return F.coalesce(*SOURCES)


def merge_key(own: str = OWN_TAX_ID) -> Column:
    """Key of rows that may repeat one invoice: any reference, else number and counterparty ids."""
    ref = F.coalesce(*[F.when(F.trim(f"{s}.ksef_reference") != "", F.col(f"{s}.ksef_reference")) for s in ("ksef", "saldeo", "mail")])
    p = primary()
    number = canonical_number(p["invoice_number"])
    digits = F.length(F.translate(number, f"{string.ascii_uppercase}/", ""))
    ids = F.array_join(F.sort_array(counterparty_ids(p["seller_tax_id"], p["buyer_tax_id"], own)), ",")
    return F.coalesce(F.concat(F.lit("ksef:"), ref), F.when(digits >= 3, F.concat(F.lit("inv:"), number, F.lit("|tax:"), ids)))


def merge_duplicates(keyed: DataFrame, work: Cuts, own: str = OWN_TAX_ID) -> DataFrame:
    """Merges the rows of ``build_rows`` that have one key, share a source and agree on a positive amount.

    A key's rows are taken in content order (mail rows first, then by record content), so the result does not depend on
    the order of the input; a row that cannot join the latest one becomes the latest. A task streams through them and
    holds the latest row only; the records of merged rows meet in an aggregation. Only keys with several rows take part
    (told by their hashes, a key that shares one with another is folded alone); without any the rows stay where they are.
    """
    often = work.cut(keyed.where("_key is not null").groupBy(F.xxhash64("_key").alias("_hash")).agg(F.count("*").alias("n")).where("n > 1").select("_hash"))
    if often.isEmpty():
        return with_scores(keyed.select(*SOURCES), own)
    bucket = F.when(F.col("mail").isNotNull(), 0).when(F.col("ksef").isNotNull() & F.col("saldeo").isNotNull(), 1).when(F.col("ksef").isNotNull(), 2).otherwise(3)
    json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    known = lambda s: sum((F.col(f"{s}.{c}").isNotNull().cast("int") * w for c, w in WEIGHTS.items()), F.lit(0))
    # a record's rank: the better one has the smaller
    rank = lambda s: F.when(F.col(s).isNotNull(), F.concat(F.lpad((F.lit(999) - known(s)).cast("string"), 3, "0"), json(F.col(s))))
    fields = ["_key", bucket.alias("bucket"), "_row", *[rank(s).alias(s) for s in SOURCES], *[F.col(f"{s}.gross_amount_minor").alias(f"{s}_gross") for s in SOURCES]]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {"_key": None}
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                gross = lambda r: next((r[f"{s}_gross"] for s in SOURCES if r[s] is not None), None)
                shared = row["_key"] == last["_key"] and any(row[s] is not None and last[s] is not None for s in SOURCES)
                a, b = (gross(last) or 0, gross(row) or 0) if shared else (0, 0)
                if shared and not (a > 0 and b > 0 and abs(a - b) > 2):
                    for s in SOURCES:
                        if row[s] is not None and (last[s] is None or row[s] < last[s]):
                            last[s], last[f"{s}_gross"] = row[s], row[f"{s}_gross"]
                else:
                    last = row | {"head": row["_row"]}
                found.append((row["_row"], last["head"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["_row", "head"])

    def folded(n: int) -> DataFrame:
        some = keyed.where("_key is not null").withColumn("_hash", F.xxhash64("_key")).where(in_pass(n, "_hash"))
        many = some.join(often.where(in_pass(n, "_hash")), "_hash").select(*fields).repartition("_key")
        many = many.withColumn("order", F.expr(f"substring(coalesce({','.join(SOURCES)}), 4)"))  # the primary record's content, behind its rank
        return many.sortWithinPartitions("_key", "bucket", "order", "_row").mapInArrow(heads, "_row long, head long")

    of = work.cut_all(folded(n) for n in range(PASSES))
    groups = of.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    moved = work.cut(of.join(groups, "head").select("_row", "head"))
    work.drop(often, of)
    if moved.isEmpty():
        return with_scores(keyed.select(*SOURCES), own)
    headed = work.cut_all(keyed.where(in_pass(n, "_row")).join(moved.where(in_pass(n, "_row")), "_row", "left").select("head", *SOURCES) for n in range(PASSES))
    work.drop(keyed, moved)
    best = [F.min_by(s, F.when(F.col(s).isNotNull(), rank(s))).alias(s) for s in SOURCES]
    merged = work.cut_all(headed.where(F.col("head").isNotNull() & in_pass(n, "head")).groupBy("head").agg(*best).select(*SOURCES) for n in range(PASSES))
    return with_scores(headed.where("head is null").select(*SOURCES).unionByName(merged), own)


def display(row_prefix: str = "") -> Column:
    """The record shown for a row, field by field: registry, ledger, mail; a corrected ledger record comes first."""
    c = {s: F.col(row_prefix + s) for s in SOURCES}
    corrected = F.coalesce(F.exists(c["saldeo"]["warnings"], lambda w: w.startswith(OVERRIDE_PREFIX)), F.lit(False))

    def first(field: str, order: tuple, pick=lambda x: x) -> Column:
        fixed = F.coalesce(*[pick(c[s][field]) for s in ("saldeo", "ksef", "mail")])
        return F.when(corrected, fixed).otherwise(F.coalesce(*[pick(c[s][field]) for s in order]))

    meta, names = ("ksef", "saldeo", "mail"), ("ksef", "mail", "saldeo")
    lead = F.when(corrected, F.coalesce(c["saldeo"], c["mail"], c["ksef"])).otherwise(F.coalesce(c["mail"], c["ksef"], c["saldeo"]))
    own_number = lead["invoice_number"]
    fields = {f: F.coalesce(first(f, meta), lead[f]) for f in ("seller_tax_id", "buyer_tax_id", "issue_date", "sale_date", "due_date", "gross_amount_minor", "net_amount_minor", "vat_amount_minor", "currency")}
    fields["invoice_number"] = F.coalesce(first("invoice_number", meta, lambda x: F.when(is_valid_number(x), x)), F.when(is_valid_number(own_number), own_number))
    fields["ksef_reference"] = F.coalesce(lead["ksef_reference"], first("ksef_reference", meta))
    fields |= {f: first(f, names, useful_party) for f in ("seller_name", "buyer_name")}
    return F.struct(*[(fields[f] if f in fields else lead[f]).alias(f) for f in COLUMNS])


def reconcile(feeds: dict[str, DataFrame], threshold: int = 70, own: str = OWN_TAX_ID) -> DataFrame:
    """End to end: dedupe, candidates, assignment, rows, merge of duplicates.

    Each step is written and what only it read is deleted, so the disks hold a few copies of the feeds at a time.
    """
    work = Cuts(feeds["mail"].sparkSession)
    given, feeds = feeds, {}
    for s in SOURCES:
        once, written = deduped(given[s].select(*COLUMNS), work)
        feeds[s] = work.cut(numbered(once))
        work.drop(written)
    ready = {s: work.cut(prepare(feeds[s], own, "number")) for s in SOURCES}
    links = candidates(ready, threshold, own, work)
    members = work.cut(reduce(DataFrame.union, [ready[s].select("slot", "id", "ref") for s in SOURCES]))
    work.drop(*ready.values())
    ids = work.cut(assign(members, links, work, checked=True).withColumn("_row", F.monotonically_increasing_id()))
    work.drop_but(ids, *feeds.values())
    return merge_duplicates(build_rows(ids, feeds, work, own), work, own)


def summary(rows: DataFrame) -> DataFrame:
    """One row: feed counts of members, and rows of each status."""
    counts = [F.count(s).alias(f"{s}_count") for s in SOURCES]
    return rows.agg(*counts, *[F.count_if(F.col("status") == s).alias(s) for s in STATUS.values() if s != "empty"])


def source_mask() -> Column:
    """Sources of a row, ``G+K+S``; a star where the ledger record was corrected."""
    corrected = F.coalesce(F.exists("saldeo.warnings", lambda w: w.startswith(OVERRIDE_PREFIX)), F.lit(False))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(s).isNotNull(), n) for s, n in zip(SOURCES, "GKS", strict=True)])), "+")
    return F.concat(names, F.when(corrected, F.lit("*")).otherwise(F.lit("")))


def row_keys(rows: DataFrame) -> DataFrame:
    """``row_key, row_hash`` and the row: keys unique in a report and stable whatever the row order.

    Colliding keys get the tax ids, then the records' hashes, then an ordinal by row hash inside the key.
    """
    d = display()
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    hashes = F.concat(F.lit("|ids:"), text(F.col("mail.content_hash")), F.lit("/"), text(F.col("ksef.content_hash")), F.lit("/"), text(F.col("saldeo.content_hash")))
    out = rows.withColumn("_d", d).withColumn("row_hash", F.sha2(F.to_json(F.struct(*SOURCES, "status"), {"ignoreNullFields": "false"}), 256)).withColumn("_ids", hashes)
    ref = F.coalesce("ksef.ksef_reference", "mail.ksef_reference", "saldeo.ksef_reference")
    plain = F.concat(F.lit("inv:"), text(F.col("_d.invoice_number")), F.lit("|date:"), text(F.col("_d.issue_date")), F.lit("|gross:"), text(F.col("_d.gross_amount_minor")), F.lit("|cur:"), text(F.col("_d.currency")))
    out = out.withColumn("row_key", F.when(ref.isNotNull(), F.concat(F.lit("ksef:"), ref)).when(F.col("_d.invoice_number").isNull(), F.concat(plain, "_ids")).otherwise(plain))
    seller, buyer = text(F.col("_d.seller_tax_id")), text(F.col("_d.buyer_tax_id"))
    tax = F.when((seller == "") & (buyer == ""), F.lit("")).otherwise(F.concat(F.lit("|nip:"), seller, F.lit("/"), buyer))
    for suffix in (tax, F.when(F.col("row_key").contains("|ids:"), F.lit("")).otherwise(F.col("_ids"))):
        out = out.withColumn("_c", F.count("*").over(Window.partitionBy("row_key"))).withColumn("row_key", F.when(F.col("_c") > 1, F.concat("row_key", suffix)).otherwise(F.col("row_key")))
    w = Window.partitionBy("row_key")
    out = out.withColumn("_c", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy("row_hash")) - 1)
    return out.withColumn("row_key", F.when(F.col("_c") > 1, F.concat("row_key", F.lit("|n:"), F.col("_n").cast("string"))).otherwise(F.col("row_key"))).drop("_c", "_n", "_ids", "_d")
