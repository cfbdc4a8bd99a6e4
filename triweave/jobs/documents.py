"""Queries over invoice documents and model answers, written from the order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions import records
from triweave.functions.money import amounts_inconsistent
from triweave.operators import payloads
from triweave.operators.extraction import extract_documents
from triweave.oracle import BASE, FEEDS
from triweave.schema import OWN_TAX_ID, conform
from triweave.sources import feeds as sources


def _texts(b: DataFrame) -> DataFrame:
    """A document of each order in one of four layouts: Polish text, English text in columns, XML, JSON."""
    own, k, firm = OWN_TAX_ID, F.col("k"), F.concat(F.lit("Firm "), "nip")
    day = F.date_format("d", "yyyy-MM-dd")
    price = F.col("g").cast("decimal(38,2)") / 100
    plain = F.replace(F.format_number(price, 2), F.lit(","), F.lit(""))
    polish = F.concat(F.lit("Faktura VAT nr "), "num", F.lit("\nData wystawienia: "), day, F.lit("\nSprzedawca\n"), firm, F.lit("\nNIP: "), "nip", F.lit("\nPodsuma 10,00\nRazem do zapłaty: "), F.translate(F.format_number(price, 2), ",.", " ,"), F.lit(" "), "cur", F.lit("\nNr KSeF: "), "ref")
    english = F.concat(F.lit("Invoice number: "), "num", F.lit("\nSeller:                         Buyer:\n"), F.rpad(firm, 32, " "), F.lit("Own Company Ltd\nNIP: "), F.rpad("nip", 27, " "), F.lit(f"NIP: {own}\nIssue date: "), day, F.lit("\nSubtotal: 10.00\nNet 30\nTotal: "), F.format_number(price, 2), F.lit(" "), "cur", F.lit("\nKSeF "), "ref")
    tag = lambda name, x: F.concat(F.lit(f"<n:{name}>"), x, F.lit(f"</n:{name}>"))
    xml = F.concat(F.lit('<n:Faktura xmlns:n="u">'), tag("P_1", day), tag("P_2", F.col("num")), tag("P_15", plain), tag("KodWaluty", F.col("cur")), tag("NrKSeF", F.col("ref")), tag("Podmiot1", F.concat(tag("NIP", F.col("nip")), tag("Nazwa", firm))), tag("Podmiot2", tag("NIP", F.lit(own))), F.lit("</n:Faktura>"))
    js = F.to_json(F.struct(F.col("num").alias("invoiceNumber"), day.alias("issueDate"), plain.cast("decimal(20,2)").alias("grossAmount"), F.col("cur").alias("currency"), F.col("ref").alias("ksefNumber"), F.struct(F.col("nip").alias("nip"), firm.alias("name")).alias("seller"), F.struct(F.lit(own).alias("nip")).alias("buyer")))
    text = F.when(k % 4 == 0, polish).when(k % 4 == 1, english).when(k % 4 == 2, xml).otherwise(js)
    kind = F.when(k % 4 < 2, ".txt").when(k % 4 == 2, ".xml").otherwise(".json")
    return b.select(k.cast("string").alias("content_hash"), F.concat(F.lit("docs/"), k.cast("string"), kind).alias("source_path"), text.alias("text"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four layouts, read by the extraction job."""
    out = extract_documents(_texts(sources.base(spark, sf_dir)))
    return out.select(F.col("content_hash").cast("bigint").alias("doc_key"), "invoice_number", "seller_tax_id", "buyer_tax_id", "seller_name", "issue_date", "gross_amount_minor", "currency", "ksef_reference", records.own_id_status(F.col("warnings")).alias("own_id"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without amounts after a model's answers: plain, in a channel, with a decimal comma, with a missing field, or none."""
    b, k = sources.base(spark, sf_dir), F.col("k")
    price = F.replace(F.format_number(F.col("g").cast("decimal(38,2)") / 100, 2), F.lit(","), F.lit(""))
    known = {"invoice_number": F.col("num"), "issue_date": F.date_format("d", "yyyy-MM-dd"), "gross_amount": F.when(k % 5 == 2, F.replace(price, F.lit("."), F.lit(","))).otherwise(price), "currency": F.col("cur"), "seller_name": F.col("nm")}
    fields = lambda names: F.to_json(F.struct(*[known.get(f, F.lit(None).cast("string")).alias(f) for f in names]), {"ignoreNullFields": "false"})
    whole = fields(payloads.FIELDS)
    answer = F.when(k % 5 == 1, F.concat(F.lit('<|channel>analysis it says {"x": 1}<|channel>final ```json\n'), whole, F.lit("\n```"))).when(k % 5 == 3, fields(payloads.FIELDS[:-1])).when(k % 5 != 4, whole)
    recs = conform(b.select(F.lit("mail").alias("source"), k.cast("string").alias("content_hash"), F.col("num").alias("invoice_number"), F.col("d").alias("issue_date"), F.col("nm").alias("seller_name")))
    out, outcomes = payloads.apply_payloads(recs, b.select(k.cast("string").alias("content_hash"), answer.alias("answer")), "m1")
    out = out.select("content_hash", "gross_amount_minor", "currency", F.size("warnings").alias("n_notes"))
    return out.join(outcomes.select("content_hash", "outcome"), "content_hash", "left").select(F.col("content_hash").cast("bigint").alias("doc_key"), "outcome", "gross_amount_minor", "currency", "n_notes")


def record_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests of mail records with net amounts and tax that do not always add up."""
    mail = sources.derived_feeds(spark, sf_dir)["mail"]
    key, gross = F.col("truth_key"), F.col("gross_amount_minor")
    r = mail.withColumn("net_amount_minor", F.when(key % 3 == 0, gross - 100).when(key % 3 == 1, gross + 1)).withColumn("vat_amount_minor", F.when(key % 3 == 0, 100 + key % 2))
    bad = amounts_inconsistent(F.col("net_amount_minor"), F.col("vat_amount_minor"), gross)
    return r.select("content_hash", bad.alias("inconsistent"), records.missing_core_fields().alias("missing_core"), records.missing_hard_fields().alias("missing_hard"), records.has_invoice_signal().alias("signal"), records.quality().alias("quality"), records.has_counterparty().alias("counterparty"), records.counterparty_name(F.lit("own company")).alias("shown_name"))


QUERIES = {"extracted": extracted, "model_answers": model_answers, "record_flags": record_flags}
_BAD = "CASE WHEN truth_key % 3 = 0 THEN truth_key % 2 = 1 WHEN truth_key % 3 = 1 THEN true ELSE false END"
ORACLE = {
    "extracted": f"""WITH {BASE} SELECT k AS doc_key, num AS invoice_number, nip AS seller_tax_id, CASE WHEN k % 4 <> 0 THEN '{OWN_TAX_ID}' END AS buyer_tax_id, 'Firm ' || nip AS seller_name, d AS issue_date, g AS gross_amount_minor, cur AS currency, ref AS ksef_reference, CASE WHEN k % 4 = 0 THEN 'not_found' ELSE 'found' END AS own_id FROM inv_base""",
    "model_answers": f"""WITH {BASE} SELECT k AS doc_key, CASE WHEN k % 5 < 3 THEN 'applied' WHEN k % 5 = 3 THEN 'rejected' ELSE 'transient' END AS outcome, CASE WHEN k % 5 < 3 THEN g END AS gross_amount_minor, CASE WHEN k % 5 < 3 THEN cur END AS currency, CASE WHEN k % 5 = 2 THEN 2 WHEN k % 5 < 3 THEN 1 ELSE 0 END AS n_notes FROM inv_base""",
    "record_flags": f"""WITH {FEEDS} SELECT content_hash, {_BAD} AS inconsistent, {_BAD} OR invoice_number IS NULL OR lower(seller_name) = 'nabywca' AS missing_core, {_BAD} OR invoice_number IS NULL AS missing_hard, true AS signal,
      CAST(6 + CASE WHEN invoice_number IS NULL THEN 0 ELSE 1 END + CASE WHEN seller_tax_id IS NULL THEN -1 ELSE 0 END AS INT) AS quality, lower(seller_name) <> 'nabywca' AS counterparty, CASE WHEN lower(seller_name) = 'nabywca' THEN '-' ELSE seller_name END AS shown_name FROM inv_mail""",
}
