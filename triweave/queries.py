"""Registered queries of the reconciliation operators; each reads whole tables of ``sf_dir``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions import dates, money, numbers, records
from triweave.jobs import documents, mail, review
from triweave.operators import matching, rows, snapshots, survivorship, windows
from triweave.plans import uploads
from triweave.schema import COLUMNS, SOURCES, conform
from triweave.sources import feeds as sources
from triweave.storage import cut


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sources.derived_feeds(spark, sf_dir)
    return f["mail"].unionByName(f["ksef"]).unionByName(f["saldeo"])


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_feeds(spark, sf_dir).select("source", "content_hash", "invoice_number", "seller_tax_id", "buyer_tax_id", "seller_name", "issue_date", "gross_amount_minor", "currency", "ksef_reference")


def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("invoice_number")
    return all_feeds(spark, sf_dir).select("source", "content_hash", numbers.canonical_number(n).alias("canonical"), F.array_join(numbers.raw_tokens(n), "/").alias("tokens"), numbers.is_valid_number(n).alias("valid"), numbers.looks_like_filename(n).alias("filename"), numbers.clean_number(n).alias("cleaned"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    seller = F.col("seller_tax_id")
    ids = numbers.counterparty_ids(seller, F.col("buyer_tax_id"))
    return all_feeds(spark, sf_dir).select("source", "content_hash", F.when(seller.isNotNull(), numbers.tax_id_checksum(seller)).alias("seller_checksum"), F.nullif(F.array_join(ids, ","), F.lit("")).alias("counterparties"), numbers.norm_reference(F.col("ksef_reference")).alias("reference"), records.completeness().cast("int").alias("completeness"))


def money_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written as machine decimals and in the local form, read back."""
    price = F.col("l_extendedprice").cast("decimal(38,2)")
    local = F.translate(F.format_number(price, 2), ",.", ".,")
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    minor = money.decimal_to_minor(F.col("l_extendedprice").cast("decimal(38,10)").cast("string"))
    return t.select("l_orderkey", "l_linenumber", minor.alias("minor"), money.local_money_to_minor(local).alias("local_minor"), money.format_minor(minor).alias("shown"))


def date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five ways, read back; the month-first reading of ambiguous ones; the upload period."""
    d = F.to_date("o_orderdate")
    written = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "dd.MM.yyyy")).when(F.col("o_orderkey") % 5 == 2, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "d-M-yyyy"))
    read = dates.parse_text_date(F.date_format(d, "dd/MM/yyyy"), F.lit(None).cast("string"))
    p = dates.target_period(d, 1996, F.lit("1998-01-15").cast("date"))
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return t.select("o_orderkey", dates.parse_date(written).alias("parsed"), read["alternative"].alias("alternative"), F.when(p["year"].isNotNull(), F.format_string("%d-%02d", p["year"], p["month"])).alias("period"))


def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail feed with poorer copies of a quarter of its records, deduplicated."""
    mail = sources.derived_feeds(spark, sf_dir)["mail"]
    copies = mail.where("truth_key % 4 = 3").withColumn("content_hash", F.concat("content_hash", F.lit(":copy"))).withColumn("seller_name", F.lit(None).cast("string"))
    return matching.dedupe(mail.unionByName(copies).select(*COLUMNS)).select("content_hash")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = sources.derived_feeds(spark, sf_dir)["saldeo"]
    copies = ledger.where("truth_key % 4 = 1").withColumn("content_hash", F.concat(F.lit("a"), "content_hash")).withColumn("seller_name", F.lit(None).cast("string"))
    return matching.duplicate_groups(ledger.unionByName(copies).select(*COLUMNS)).select("invoice_number", "n", "kept")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {s: cut(matching.prepare(x.withColumn("number", F.monotonically_increasing_id()), number="number", also=("content_hash",))) for s, x in sources.derived_feeds(spark, sf_dir).items()}
    out = matching.candidates(f)
    for side, p in (("left", "l"), ("right", "r")):
        names = [f[s].select(F.lit(k).alias(f"{p}slot"), F.col("id").alias(f"{p}id"), F.lit(s).alias(f"{side}_source"), F.col("content_hash").alias(f"{side}_id")) for k, s in enumerate(SOURCES)]
        out = out.join(reduce(DataFrame.union, names), [f"{p}slot", f"{p}id"])
    return out.select("left_source", "left_id", "right_source", "right_id", "pass", "score")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.reconcile(sources.derived_feeds(spark, sf_dir))


def _ids() -> list:
    return [F.col(f"{s}.content_hash").alias(f"{s}_id") for s in SOURCES]


def tri_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconciled(spark, sf_dir).select(*_ids(), "status", "mail_score_to_ksef", "mail_score_to_saldeo", "ksef_score_to_saldeo")


def tri_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.summary(reconciled(spark, sf_dir))


def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reconciled(spark, sf_dir).select(*_ids(), rows.display().alias("d"), rows.source_mask().alias("mask"))
    return d.select("mail_id", "ksef_id", "saldeo_id", "d.invoice_number", "d.seller_name", "d.seller_tax_id", "d.gross_amount_minor", "mask")


def missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reconciled(spark, sf_dir).where("status <> 'in_all_three'").select("status", rows.primary().alias("p"))
    return r.groupBy("status", F.year("p.issue_date").alias("year")).agg(F.count("*").alias("n"), F.sum("p.gross_amount_minor").alias("gross"))


def year_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.coalesce("issue_date", "sale_date")
    return all_feeds(spark, sf_dir).groupBy("source", F.year(day).alias("year")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.year(day) == 1996, F.lit(True))).alias("in_year"), F.count("seller_tax_id").alias("with_id"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = all_feeds(spark, sf_dir)
    w = sources.quarter_windows(f.select(F.year("issue_date").alias("year")).distinct())
    days = w.select("year", "quarter", F.explode(F.sequence("start", F.date_sub("stop", 1))).alias("day"))  # an equi-join on days, not a range join
    return f.where("source = 'ksef'").join(days, F.col("issue_date") == F.col("day")).groupBy("year", "quarter").agg(F.count("*").alias("n"))


def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivorship.repair_items(reconciled(spark, sf_dir)).select("content_hash", "invoice_number", F.array_join("changed_fields", ",").alias("changed"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of file-name numbers; half of them are stale, their baseline is no longer the ledger's."""
    ledger = sources.derived_feeds(spark, sf_dir)["saldeo"]
    new = F.concat(F.lit("FV/"), F.col("truth_key").cast("string"), F.lit("/"), F.year("issue_date").cast("string"))
    base = F.when(F.col("truth_key") % 16 == 0, F.lit("moved on")).otherwise(F.col("invoice_number"))
    stored = ledger.where("truth_key % 8 = 0").select("content_hash", F.create_map(F.lit("invoice_number"), F.struct(new.alias("value"), base.alias("baseline"))).alias("override"))
    out = survivorship.apply_overrides(ledger.select(*COLUMNS), stored)
    return out.select("content_hash", "invoice_number", (F.size("warnings") > 0).alias("marked"))


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sources.derived_feeds(spark, sf_dir)
    f["mail"] = f["mail"].withColumn("source_path", F.concat(F.lit("mail/"), F.col("truth_key").cast("string"), F.lit(".pdf")))
    key = F.col("truth_key")
    files = f["mail"].where(key % 13 != 0).select("source_path", F.sha2("source_path", 256).alias("file_sha256"), F.lit("found").alias("own_id_check"))
    sent = f["mail"].where((key % 17 == 0) | (key % 5 == 4)).select(F.sha2("source_path", 256).alias("file_sha256"), F.when(key % 17 == 0, "unconfirmed").otherwise("uploaded").alias("state"), F.lit(1995).alias("period_year"), F.lit(6).alias("period_month"))
    return uploads.upload_plan(rows.reconcile(f), files, sent, 1996, F.lit("1998-01-15").cast("date"))


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("upload_status", "status", "content_hash", F.array_join("related_sources", "+").alias("related"), "period_year")


def upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads.upload_summary(_plan(spark, sf_dir))


def approve_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_extract("saldeo.content_hash", "saldeo:([0-9]+)$", 1).try_cast("bigint")
    r = reconciled(spark, sf_dir).select(key.alias("document_id"), F.col("mail").isNotNull().alias("has_mail"), (F.col("saldeo").isNotNull() & F.col("ksef").isNotNull() & (key % 2 == 0)).alias("pending"))
    return uploads.approve_plan(r, cap=1_000_000, require_mail=True)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = sources.derived_feeds(spark, sf_dir)
    keyed = lambda x: x.select(F.col("truth_key").cast("string").alias("row_key"), F.sha2(F.concat_ws("|", "invoice_number", "gross_amount_minor"), 256).alias("row_hash"))
    return snapshots.diff(keyed(f["saldeo"]), keyed(f["ksef"]))


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = sources.derived_feeds(spark, sf_dir)["mail"]
    early, late = "1999-01-01 00:00:00", "2000-01-01 00:00:00"
    stored = mail.where("truth_key % 3 <> 0").select(*COLUMNS, F.lit(early).cast("timestamp").alias("created_at"), F.lit(early).cast("timestamp").alias("updated_at"))
    new = mail.where("truth_key % 2 = 0").withColumn("gross_amount_minor", F.col("gross_amount_minor") + 1)
    out = snapshots.upsert(stored, conform(new), late)
    return out.select("source", "content_hash", "gross_amount_minor", (F.col("updated_at") == F.lit(late).cast("timestamp")).alias("updated"))


def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_feeds(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("gross_amount_minor").alias("gross"), F.min("issue_date").alias("first_day"), F.max("issue_date").alias("last_day"))


def latest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred latest registry records; the limit is the report."""
    f = sources.derived_feeds(spark, sf_dir)["ksef"]
    return f.orderBy(F.desc_nulls_last("issue_date"), F.desc_nulls_last("content_hash")).limit(100).select("content_hash", "issue_date")


def rate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.rate_audit(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "ts")
    return w.groupBy("group").agg(F.count("*").alias("n"), F.max("used_1000").alias("used_1s"), F.max("used_60000").alias("used_60s"), F.max("used_3600000").alias("used_1h"), F.sum("wait_ms").alias("wait_ms"))


QUERIES = {
    "feeds": feeds, "numbers": number_columns, "identities": identities, "money": money_columns, "dates": date_columns, "dedupe": dedupe, "duplicate_groups": duplicate_groups, "candidate_pairs": candidate_pairs,
    "tri_rows": tri_rows, "tri_summary": tri_summary, "display_records": display_records, "missing_rows": missing_rows, "year_filters": year_filters, "quarters": quarters, "repairs": repairs, "overrides": overrides,
    "upload_plan": upload_plan, "upload_summary": upload_summary, "approve_plan": approve_plan, "snapshot_diff": snapshot_diff, "upsert": upsert, "store_stats": store_stats, "latest_records": latest_records, "rate_audit": rate_audit,
} | documents.QUERIES | mail.QUERIES | review.QUERIES
