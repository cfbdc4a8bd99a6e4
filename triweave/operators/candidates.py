"""Mail candidates: clusters of records of one invoice, merges of feeds, re-reads and cached answers.

Clusters are folds: a record joins the first kept one of its number that it matches, and the better of both stays. The
order is by content, so results do not depend on the input's. Records that agree in counterparties and amount are one
before the fold, so a number that a third of the records share reaches it with its distinct invoices only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.functions.money import amounts_inconsistent
from triweave.functions.numbers import canonical_number, counterparty_ids
from triweave.functions.records import FILENAME_NUMBER, OWN_ID_MARKS, PARSER_PREFIX, RETRY_PREFIXES, any_prefix, is_model_mark, is_placeholder, missing_core_fields, needs_retry, quality
from triweave.schema import COLUMNS, OWN_TAX_ID, canonical_key
from triweave.storage import cut

UNNUMBERED = ("invoice_number", "issue_date", "gross_amount_minor", "seller_tax_id", "buyer_tax_id", "seller_name", "buyer_name")
AMOUNTS = ("net_amount_minor", "vat_amount_minor", "gross_amount_minor")
CACHED_FIELDS = ("invoice_number", "seller_tax_id", "buyer_tax_id", "issue_date", "sale_date", "due_date", "gross_amount_minor", "net_amount_minor", "vat_amount_minor", "currency", "ksef_reference")
NAMES = ("seller_name", "buyer_name")
MESSAGE = ("source_path", "email_message_id", "email_subject", "email_from")


def _folded(rows: DataFrame) -> DataFrame:
    """``_row`` of the records that stay; ``rows``: ``num, fixed, order, _row, hash, ids, gross, quality``, fixed ones are kept first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, out = None, [], []
        for b in batches:
            for row in b.to_pylist():
                if row["num"] != number:
                    out += [k["_row"] for k in kept]
                    number, kept = row["num"], []
                at = None if row["fixed"] else next((n for n, k in enumerate(kept) if same_invoice(k, row)), None)
                if at is None:
                    kept.append(row)
                elif row["quality"] > kept[at]["quality"]:
                    kept[at] = row
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["_row"])
            out = []
        yield pa.RecordBatch.from_arrays([pa.array([k["_row"] for k in kept], pa.int64())], names=["_row"])

    return rows.repartition("num").sortWithinPartitions("num", F.desc("fixed"), "order", "_row").mapInArrow(run, "_row long")


def same_invoice(a: dict, b: dict) -> bool:
    """Records of one number are one invoice: the same file, a shared counterparty, or, where one has none, the same amount."""
    if a["hash"] and a["hash"] == b["hash"]:
        return True
    if a["ids"] and b["ids"]:
        return not set(a["ids"]).isdisjoint(b["ids"])
    return a["gross"] is not None and a["gross"] == b["gross"]


def _narrow(records: DataFrame, own: str) -> DataFrame:
    num = F.nullif(canonical_number(F.col("invoice_number")), F.lit(""))
    ids = F.array_sort(F.array_distinct(counterparty_ids(F.col("seller_tax_id"), F.col("buyer_tax_id"), own)))
    return records.select(num.alias("num"), canonical_key().alias("order"), "_row", F.nullif("content_hash", F.lit("")).alias("hash"), ids.alias("ids"), F.col("gross_amount_minor").alias("gross"), quality().alias("quality"))


def _one_of(rows: DataFrame, *key: str) -> DataFrame:
    """The best row of each key, the first by content among equals."""
    best = Window.partitionBy(*key).orderBy(F.desc("quality"), "order", "_row")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def cluster_candidates(records: DataFrame, own: str = OWN_TAX_ID) -> DataFrame:
    """One record of each invoice; records without a number are distinct on what else they say."""
    rows = cut(records.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    narrow = _narrow(rows, own)
    comparable = (F.size("ids") > 0) | F.col("gross").isNotNull()
    numbered = narrow.where("num is not null")
    met = _one_of(numbered.where(comparable), "num", "ids", "gross").unionByName(_one_of(numbered.where(~comparable), "num", "hash", "_row"))
    kept = _folded(met.withColumn("fixed", F.lit(False)))
    first = Window.partitionBy(*UNNUMBERED).orderBy(canonical_key(), "_row")
    plain = rows.where(F.coalesce(canonical_number(F.col("invoice_number")), F.lit("")) == "").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_row")
    return rows.join(kept.union(plain), "_row", "left_semi").select(*COLUMNS)


def merge_candidates(main: DataFrame, extra: DataFrame, own: str = OWN_TAX_ID) -> DataFrame:
    """Main candidates with extra ones added: not the same files again, and of one invoice the better record, main ones among equals."""
    both = main.select(*COLUMNS, F.lit(True).alias("fixed")).unionByName(extra.select(*COLUMNS, F.lit(False).alias("fixed")))
    rows = cut(both.withColumn("_row", F.monotonically_increasing_id()))
    once = Window.partitionBy("content_hash").orderBy(canonical_key(), "_row")
    fresh = rows.where(~F.col("fixed")).join(rows.where("fixed").select("content_hash").where("content_hash <> ''"), "content_hash", "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(once)).where("_n = 1 or content_hash = ''").select(*rows.columns)
    rows = rows.where("fixed").unionByName(fresh)
    narrow = _narrow(rows, own).join(rows.select("_row", "fixed"), "_row")
    numbered = narrow.where("num is not null")
    comparable = (F.size("ids") > 0) | F.col("gross").isNotNull()
    some = numbered.where(~F.col("fixed"))
    met = numbered.where("fixed").unionByName(_one_of(some.where(comparable), "num", "ids", "gross")).unionByName(some.where(~comparable))
    kept = _folded(met).union(narrow.where("num is null").select("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS)


def _struct(fields: dict[str, Column], other: Column) -> Column:
    return F.struct(*[(fields[c] if c in fields else other[c]).alias(c) for c in COLUMNS])


def _inconsistent(r: Column) -> Column:
    return amounts_inconsistent(*[r[c] for c in AMOUNTS])


def _useful(name: Column) -> Column:
    return F.when(~is_placeholder(name), name)


def filled_mail(old: Column, new: Column) -> Column:
    """The old record with its gaps filled from the new one; headings in place of names are gaps."""
    fields = {c: F.coalesce(old[c], new[c]) for c in (*CACHED_FIELDS, *MESSAGE)}
    return _struct(fields | {c: F.when(old[c].isNull() | is_placeholder(old[c]), F.coalesce(_useful(new[c]), old[c])).otherwise(old[c]) for c in NAMES}, old)


def reparsed(old: Column, new: Column) -> Column:
    """The old record with what a new parse read in place of it, field by field.

    A number guessed from the file name, a heading as a name, and amounts that are inconsistent, or would be with the
    old ones, replace nothing; message fields are only filled.
    """
    fields = {c: F.coalesce(new[c], old[c]) for c in ("seller_tax_id", "buyer_tax_id", "issue_date", "sale_date", "due_date", "currency", "ksef_reference")}
    guessed = F.array_contains(new["warnings"], FILENAME_NUMBER)
    fields["invoice_number"] = F.when(new["invoice_number"].isNotNull() & (old["invoice_number"].isNull() | ~guessed), new["invoice_number"]).otherwise(old["invoice_number"])
    mixed = [F.coalesce(new[c], old[c]) for c in AMOUNTS]
    keep = ~_inconsistent(old) & (_inconsistent(new) | amounts_inconsistent(*mixed))
    fields |= {c: F.when(keep, old[c]).otherwise(m) for c, m in zip(AMOUNTS, mixed, strict=True)}
    fields |= {c: F.coalesce(_useful(new[c]), old[c]) for c in NAMES} | {c: F.coalesce(old[c], new[c]) for c in MESSAGE}
    return _struct(fields, old)


def reread_warnings(old: Column, new: Column, merged: Column, replace: Column, version: str) -> Column:
    """Warnings after a re-read: old versions, checks and failures go, new ones come, the version is stamped.

    The file-name mark follows the number that stayed.
    """
    guessed = F.array_contains(new["warnings"], FILENAME_NUMBER)
    from_parse = new["invoice_number"].isNotNull() & merged["invoice_number"].eqNullSafe(new["invoice_number"]) & (old["invoice_number"].isNull() | (replace & ~guessed))
    is_retry = lambda w: F.array_max(F.array(*[F.lower(w).startswith(p.lower()).cast("int") for p in RETRY_PREFIXES])) == 1
    stays = F.filter(old["warnings"], lambda w: ~(w.startswith(PARSER_PREFIX) | w.isin(*OWN_ID_MARKS.values()) | is_retry(w) | (from_parse & (w == FILENAME_NUMBER))))
    comes = F.filter(new["warnings"], lambda w: ~w.startswith(PARSER_PREFIX) & ~((w == FILENAME_NUMBER) & ~from_parse))
    return F.concat(stays, F.array_except(comes, stays), F.array(F.lit(PARSER_PREFIX + version)))


def reread(stored: DataFrame, parsed: DataFrame, version: str) -> DataFrame:
    """Stored mail records after re-reading documents: ``parsed`` has a record for each path that could be read again.

    Records of this version that were read well stay; of those of an older one the parse replaces values, but for
    records with a model's answer; where this version failed before, gaps are filled. A parse that fails leaves the
    record as it is.
    """
    p = parsed.where(~needs_retry()).select(F.col("source_path").alias("_path"), F.struct(*COLUMNS).alias("new"))
    p = p.groupBy("_path").agg(F.min_by("new", F.to_json("new")).alias("new"))
    rows = stored.select(F.struct(*COLUMNS).alias("old"), "source_path", "warnings")
    current = F.array_contains("warnings", PARSER_PREFIX + version)
    due = ~current | needs_retry()
    replace = ~current & ~F.exists("warnings", is_model_mark)
    old, new = F.col("old"), F.col("new")
    both = rows.withColumn("_due", due).withColumn("_replace", replace).join(p, F.col("_due") & (F.col("source_path") == F.col("_path")), "left")
    both = both.withColumn("merged", F.when(F.col("_replace"), reparsed(old, new)).otherwise(filled_mail(old, new)))
    merged = F.col("merged")
    out = _struct({"content_hash": new["content_hash"], "warnings": reread_warnings(old, new, merged, F.col("_replace"), version)}, merged)
    return both.select(F.when(new.isNotNull(), out).otherwise(old).alias("r")).select("r.*")


def reuse_cached(fresh: DataFrame, cached: DataFrame, version: str | None = None) -> DataFrame:
    """Fresh candidates with a cached answer merged in, and ``reusable``: nothing is left to ask.

    A cached record of the same file counts if a model answered it, or if this parser ``version`` (any, if null) read it
    well, and if it has every value that the fresh one has, apart from amounts and numbers that the model replaced.
    """
    model = F.exists("warnings", is_model_mark)
    read = any_prefix(F.col("warnings"), PARSER_PREFIX) if version is None else F.array_contains("warnings", PARSER_PREFIX + version)
    c = cached.where(model | (read & ~needs_retry())).select("content_hash", F.struct(*COLUMNS).alias("c"), model.alias("_model"))
    c = c.groupBy("content_hash").agg(F.max_by(F.struct("c", "_model"), F.to_json("c")).alias("x")).select(F.col("content_hash").alias("_h"), "x.c", "x._model")
    rows = fresh.select(F.struct(*COLUMNS).alias("f"), "content_hash").join(c, F.col("content_hash") == F.col("_h"), "left")
    f, k = F.col("f"), F.col("c")
    amounts = F.col("_model") & _inconsistent(f) & ~_inconsistent(k) & k["gross_amount_minor"].isNotNull()
    number = F.col("_model") & F.array_contains(f["warnings"], FILENAME_NUMBER) & ~F.array_contains(k["warnings"], FILENAME_NUMBER) & k["invoice_number"].isNotNull()
    rows = rows.withColumn("_a", F.coalesce(amounts, F.lit(False))).withColumn("_n", F.coalesce(number, F.lit(False)))
    waived = {**{a: F.col("_a") for a in AMOUNTS}, "invoice_number": F.col("_n")}
    agree = [waived.get(x, F.lit(False)) | f[x].isNull() | F.coalesce(f[x] == k[x], F.lit(False)) for x in CACHED_FIELDS]
    agree += [f[x].isNull() | is_placeholder(f[x]) | F.coalesce(f[x] == k[x], F.lit(False)) for x in NAMES]
    rows = rows.withColumn("_ok", k.isNotNull() & F.forall(F.array(*agree), lambda x: x))
    stripped = F.when(F.col("_n"), F.filter(f["warnings"], lambda w: w != FILENAME_NUMBER)).otherwise(f["warnings"])
    base = _struct({**{a: F.when(F.col("_a"), k[a]).otherwise(f[a]) for a in AMOUNTS}, "invoice_number": F.when(F.col("_n"), k["invoice_number"]).otherwise(f["invoice_number"]), "warnings": stripped}, f)
    rows = rows.withColumn("base", base)
    more = F.array_except(F.filter(k["warnings"], lambda w: ~w.isin(*OWN_ID_MARKS.values())), F.col("base")["warnings"])
    done = filled_mail(F.col("base"), k)
    rows = rows.withColumn("done", _struct({"warnings": F.concat(F.col("base")["warnings"], more)}, done))
    rows = rows.select(F.when(F.col("_ok"), F.col("done")).otherwise(f).alias("done"), "c", "_ok", "_model")
    complete = F.when(F.col("_model"), ~missing_core_fields("done.")).otherwise(~missing_core_fields("c.") & ~needs_retry("done."))
    return rows.select("done.*", F.coalesce(F.col("_ok") & complete, F.lit(False)).alias("reusable"))


def enriched_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """``changed``: records (by ``content_hash``) that differ in one of eight fields."""
    fields = ("invoice_number", "seller_tax_id", "buyer_tax_id", "seller_name", "buyer_name", "issue_date", "gross_amount_minor", "currency")
    a = before.select("content_hash", F.struct(*fields).alias("a"))
    return a.join(after.select("content_hash", F.struct(*fields).alias("b")), "content_hash").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))

