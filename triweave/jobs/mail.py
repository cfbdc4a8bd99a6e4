"""Queries over mail derived from the order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.records import FILENAME_NUMBER
from triweave.operators import candidates, mailbox
from triweave.oracle import BASE, FEEDS
from triweave.schema import COLUMNS, conform
from triweave.sources import feeds as sources


def _mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.derived_feeds(spark, sf_dir)["mail"]


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of a message tree of each order: a body, an invoice by id, a program, and an empty part."""
    k = F.col("k").cast("string")
    part = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    tree = part('{"mimeType":"multipart/mixed","filename":"","parts":[{"mimeType":"text/plain","filename":"","body":{"data":"dA"}},{"parts":[{"filename":"inv', k, '.pdf","body":{"attachmentId":"a', k, '"}},{"filename":"empty.xml","body":{}}]},{"filename":"run.exe","body":{"data":"x"}}]}')
    return mailbox.explode_attachments(sources.base(spark, sf_dir).select(k.alias("id"), tree.alias("payload"))).select("message_id", "ordinal", "filename", "data", "attachment_id")


def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail records with the headers of the message that their file name tells; some have a subject already."""
    mail, key = _mail(spark, sf_dir), F.col("truth_key")
    m = mail.withColumn("source_path", F.concat(F.lit("mail/m"), key.cast("string"), F.lit("_0_inv.pdf"))).withColumn("email_subject", F.when(key % 3 == 0, "kept").when(key % 3 == 1, " "))
    heads = mail.where(key % 2 == 0).select(F.concat(F.lit("m"), key.cast("string")).alias("message_id"), F.concat(F.lit("subject "), key.cast("string")).alias("subject"), F.lit("a@b.example").alias("sender"))
    return mailbox.join_headers(m.select(*COLUMNS), heads).select("content_hash", "email_message_id", "email_subject", "email_from")


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by year whose path and contents are both unknown."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    found = m.select(F.concat(F.lit("p"), key.cast("string")).alias("source_path"), "content_hash", F.year("issue_date").alias("year"))
    known = m.where((key % 3 == 0) | (key % 5 == 0)).select(F.when(key % 3 == 0, F.concat(F.lit("p"), key.cast("string"))).alias("source_path"), F.when(key % 5 == 0, F.col("content_hash")).alias("content_hash"))
    return mailbox.new_files(found, known).groupBy("year").agg(F.count("*").alias("n"))


def complete_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as planned attachments of their order; those of even numbers from the second on are missing in every third order."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").cast("string").alias("filename"), "l_linenumber")
    here = t.where(~((F.col("message_id") % 3 == 0) & (F.col("l_linenumber") % 2 == 0)))
    return mailbox.complete_messages(t.select("message_id", "filename"), here)


def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF records that a paid model should read and has not answered for good."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    r = m.withColumn("source_path", F.concat(key.cast("string"), F.when(key % 6 == 5, ".txt").otherwise(".PDF"))).withColumn("gross_amount_minor", F.when(key % 2 == 0, F.col("gross_amount_minor")))
    queue = mailbox.enrichment_queue(r, r.where(key % 7 == 3).select("content_hash"), paid=True)
    tried = m.where(key % 5 == 0).select("content_hash", F.lit("m1").alias("model"), F.lit("v1").alias("version"), F.when(key % 10 == 0, "transient").otherwise("rejected").alias("outcome"), F.lit("2026-01-01").cast("timestamp").alias("attempted_at"))
    return mailbox.skip_attempted(queue, tried, "m1", "v1").select("content_hash")


def company_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the own company by year, without protected files and order confirmations."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    r = m.withColumn("buyer_tax_id", F.when(key % 3 > 0, F.col("buyer_tax_id"))).withColumn("source_path", F.when(key % 7 == 3, "in/my_order.pdf").otherwise("in/inv.pdf")).withColumn("warnings", F.when(key % 13 == 0, F.array(F.lit("PDF with a password"))).otherwise(F.array().cast("array<string>")))
    return mailbox.company_candidates(r.select(*COLUMNS), "own company").groupBy(F.year("issue_date").alias("year")).agg(F.count("*").alias("n"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail with a poorer copy of some records, one of another amount, and a copy without an id whose amount differs; one of each invoice."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    m = m.where("invoice_number is not null").withColumn("seller_tax_id", F.coalesce("seller_tax_id", F.lit("7777777777")))
    poor = m.where(key % 4 == 3).withColumn("content_hash", F.concat("content_hash", F.lit(":poor"))).withColumn("currency", F.lit(None).cast("string")).withColumn("gross_amount_minor", F.col("gross_amount_minor") + 900)
    other = m.where(key % 8 == 4).withColumn("content_hash", F.concat("content_hash", F.lit(":other"))).withColumn("seller_tax_id", F.lit(None).cast("string")).withColumn("gross_amount_minor", F.col("gross_amount_minor") + 900)
    return candidates.cluster_candidates(m.unionByName(poor).unionByName(other).select(*COLUMNS)).select("content_hash")


def merged_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main candidates with a second feed: the same files, richer and equal records of the same invoices, and new ones."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    m = m.where("invoice_number is not null").withColumn("seller_tax_id", F.coalesce("seller_tax_id", F.lit("7777777777")))
    main = m.where(key % 5 > 0).withColumn("currency", F.when(key % 3 > 0, F.col("currency")))
    extra = m.withColumn("content_hash", F.when(key % 7 == 0, F.col("content_hash")).otherwise(F.concat("content_hash", F.lit(":x"))))
    return candidates.merge_candidates(main.select(*COLUMNS), extra.select(*COLUMNS)).select("content_hash")


def reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored mail of an older parser, of this one, and of this one after a failure, read again with another amount and a currency."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    base = m.withColumn("source_path", key.cast("string")).withColumn("invoice_number", F.coalesce("invoice_number", F.lit("guess-1")))
    marks = F.when(key % 3 == 0, F.array(F.lit("parser:v1"))).when(key % 3 == 1, F.array(F.lit("parser:v2"))).otherwise(F.array(F.lit("OCR failed: x"), F.lit("parser:v2")))
    stored = base.withColumn("warnings", marks).withColumn("currency", F.lit(None).cast("string"))
    parsed = base.where(key % 4 > 0).withColumn("gross_amount_minor", F.col("gross_amount_minor") + 50).withColumn("invoice_number", F.lit("guess-2")).withColumn("warnings", F.array(F.lit(FILENAME_NUMBER)))
    out = candidates.reread(stored.select(*COLUMNS), parsed.select(*COLUMNS), "v2")
    return out.select("content_hash", "gross_amount_minor", "currency", "invoice_number", F.array_join("warnings", ",").alias("marks"))


def reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh candidates with cached records of the same files: some agree, some do not, some were answered by a model."""
    m, key = _mail(spark, sf_dir), F.col("truth_key")
    m = m.where("invoice_number is not null and seller_name <> 'Nabywca'")
    fresh = m.withColumn("currency", F.lit(None).cast("string"))
    marks = F.when(key % 3 == 0, F.array(F.lit("model m1: applied"))).when(key % 3 == 1, F.array(F.lit("parser:v2"))).otherwise(F.array().cast("array<string>"))
    cached = m.withColumn("warnings", marks).withColumn("gross_amount_minor", F.col("gross_amount_minor") + F.when(key % 4 == 0, 1).otherwise(0))
    return candidates.reuse_cached(fresh.select(*COLUMNS), cached.select(*COLUMNS), "v2").select("content_hash", "currency", "reusable")


def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = conform(_mail(spark, sf_dir))
    return candidates.enriched_count(m, m.withColumn("currency", F.when(F.col("currency") == "PLN", "EUR").otherwise(F.col("currency"))))


QUERIES = {
    "attachments": attachments, "message_headers": message_headers, "new_files": new_files, "complete_messages": complete_messages, "enrichment_queue": enrichment_queue, "company_mail": company_mail,
    "clusters": clusters, "merged_mail": merged_mail, "reread": reread, "reused": reused, "enriched_records": enriched_records,
}
ORACLE = {
    "attachments": f"WITH {BASE} SELECT CAST(k AS VARCHAR) AS message_id, 0 AS ordinal, k || '_body_0.txt' AS filename, 'dA' AS data, NULL AS attachment_id FROM inv_base UNION ALL SELECT CAST(k AS VARCHAR), 1, 'inv' || k || '.pdf', NULL, 'a' || k FROM inv_base",
    "message_headers": f"WITH {FEEDS} SELECT content_hash, CASE WHEN truth_key % 2 = 0 THEN 'm' || truth_key END AS email_message_id, CASE WHEN truth_key % 3 = 0 THEN 'kept' WHEN truth_key % 2 = 0 THEN 'subject ' || truth_key END AS email_subject, CASE WHEN truth_key % 2 = 0 THEN 'a@b.example' END AS email_from FROM inv_mail",
    "new_files": f"WITH {FEEDS} SELECT year(issue_date) AS year, count(*) AS n FROM inv_mail WHERE truth_key % 3 <> 0 AND truth_key % 5 <> 0 GROUP BY 1",
    "complete_messages": "SELECT l_orderkey AS message_id, bool_and(NOT (l_orderkey % 3 = 0 AND l_linenumber % 2 = 0)) AS complete FROM lineitem GROUP BY 1",
    "enrichment_queue": f"WITH {FEEDS} SELECT content_hash FROM inv_mail WHERE truth_key % 6 <> 5 AND truth_key % 7 <> 3 AND (truth_key % 2 = 1 OR invoice_number IS NULL) AND NOT (truth_key % 5 = 0 AND truth_key % 10 <> 0)",
    "company_mail": f"WITH {FEEDS} SELECT year(issue_date) AS year, count(*) AS n FROM inv_mail WHERE truth_key % 3 <> 0 AND truth_key % 7 <> 3 AND truth_key % 13 <> 0 GROUP BY 1",
    "clusters": f"WITH {FEEDS} SELECT content_hash FROM inv_mail WHERE invoice_number IS NOT NULL UNION ALL SELECT content_hash || ':other' FROM inv_mail WHERE invoice_number IS NOT NULL AND truth_key % 8 = 4",
    "merged_mail": f"""WITH {FEEDS} SELECT CASE WHEN truth_key % 5 = 0 THEN CASE WHEN truth_key % 7 = 0 THEN content_hash ELSE content_hash || ':x' END WHEN truth_key % 7 = 0 THEN content_hash WHEN truth_key % 3 = 0 THEN content_hash || ':x' ELSE content_hash END AS content_hash FROM inv_mail WHERE invoice_number IS NOT NULL""",
    "reread": f"""WITH {FEEDS}, r AS (SELECT *, truth_key % 3 AS m, truth_key % 4 > 0 AND truth_key % 3 <> 1 AS again FROM inv_mail)
      SELECT content_hash, CASE WHEN again AND m = 0 THEN gross_amount_minor + 50 ELSE gross_amount_minor END AS gross_amount_minor, CASE WHEN again THEN currency END AS currency, coalesce(invoice_number, 'guess-1') AS invoice_number,
       CASE WHEN again THEN 'parser:v2' WHEN m = 0 THEN 'parser:v1' WHEN m = 1 THEN 'parser:v2' ELSE 'OCR failed: x,parser:v2' END AS marks FROM r""",
    "reused": f"""WITH {FEEDS} SELECT content_hash, CASE WHEN truth_key % 4 <> 0 AND truth_key % 3 <> 2 THEN currency END AS currency, truth_key % 4 <> 0 AND truth_key % 3 <> 2 AS reusable FROM inv_mail WHERE invoice_number IS NOT NULL AND seller_name <> 'Nabywca'""",
    "enriched_records": f"WITH {FEEDS} SELECT count(*) AS changed FROM inv_mail WHERE currency = 'PLN'",
}
