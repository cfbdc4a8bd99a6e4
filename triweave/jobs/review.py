"""Queries over rows in conflict, the ledger and the table of a year, derived from the order tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.operators import ledger, rows, snapshots, survivorship, year_table
from triweave.oracle import BASE, FEEDS, ROWS
from triweave.plans import uploads
from triweave.schema import COLUMNS, OWN_TAX_ID, SOURCES, conform
from triweave.sources import feeds as sources
from triweave.sources.sinks import tri_report


def conflict_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Feeds in conflict: all orders of a customer have one amount, day and id, so every record of a customer can link with every other.

    For each order mail and registry have number A, registry and ledger number B, as where the same amount comes every
    month. Every third order also has a mail and two ledger records of number C, whose amounts are a cent apart.
    """
    b = sources.base(spark, sf_dir).withColumn("g", F.lit(100_000) + F.col("nip").cast("bigint") % 1000 * 100)
    k, own = F.col("k"), OWN_TAX_ID

    def record(source: str, number: str, mark: str, ref=None, more=0) -> DataFrame:
        return conform(b.select(F.lit(source).alias("source"), F.concat(F.lit(f"{source}:"), k.cast("string"), F.lit(f":{mark}")).alias("content_hash"), F.concat(F.lit(number), k.cast("string"), F.lit("/2026")).alias("invoice_number"), F.col("nip").alias("seller_tax_id"), F.lit(own).alias("buyer_tax_id"), F.lit("2026-01-15").cast("date").alias("issue_date"), (F.col("g") + more).alias("gross_amount_minor"), F.lit("PLN").alias("currency"), (F.concat("ref", F.lit(ref)) if ref else F.lit(None).cast("string")).alias("ksef_reference"), F.array().cast("array<string>").alias("warnings"), k), "k")

    third = lambda df: df.where("k % 3 = 0")
    mail = record("mail", "A", "a").unionByName(third(record("mail", "C", "c")))
    ksef = record("ksef", "A", "a", "1").unionByName(record("ksef", "B", "b", "2"))
    saldeo = record("saldeo", "B", "b").unionByName(third(record("saldeo", "C", "c0"))).unionByName(third(record("saldeo", "C", "c1", more=1)))
    return {"mail": mail, "ksef": ksef, "saldeo": saldeo}


def conflict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way rows of feeds in conflict; the two ledger records of a number C end in one row."""
    out = rows.reconcile(conflict_feeds(spark, sf_dir))
    return out.select(*[F.col(f"{s}.content_hash").alias(f"{s}_id") for s in SOURCES], "status")


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of feeds in conflict and their keys: as many of them as rows."""
    keyed = rows.row_keys(rows.reconcile(conflict_feeds(spark, sf_dir)))
    return keyed.agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("n_keys"))


def tri_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the flat report that identify a row."""
    r = tri_report(rows.reconcile(sources.derived_feeds(spark, sf_dir)))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("ksef_number") != "").alias("with_number"), F.count_if(F.col("mail_score_to_ksef") == "100").alias("full_scores"))


def ledger_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger records filled from the registry by reference."""
    f = sources.derived_feeds(spark, sf_dir)
    out = ledger.enrich_from_registry(conform(f["saldeo"]), conform(f["ksef"]))
    return out.select("content_hash", "invoice_number", "seller_name", "buyer_tax_id", F.array_join("warnings", ",").alias("marks"))


def ledger_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger records that lack basic fields filled from their parsed documents."""
    led = conform(sources.derived_feeds(spark, sf_dir)["saldeo"])
    k = F.regexp_extract("content_hash", "([0-9]+)$", 1).cast("bigint")
    parsed = led.where(k % 2 == 0).withColumn("invoice_number", F.concat(F.lit("FV/"), k.cast("string"))).withColumn("seller_name", F.lit("Parsed Name"))
    return ledger.enrich_from_documents(led, parsed).select("content_hash", "invoice_number", "seller_name")


def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger documents of each month, by pages of a day each that state the month's total."""
    b = sources.base(spark, sf_dir).select(F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), F.col("k").alias("documentId"))
    totals = b.groupBy("year", "month").agg(F.count("*").alias("total"))
    page = b.groupBy("year", "month", "day").agg(F.collect_list(F.struct("documentId")).alias("c")).join(totals, ["year", "month"])
    json = F.to_json(F.struct(F.lit("SUCCESS").alias("status"), F.struct(F.col("c").alias("resultCollection"), F.col("total").alias("totalCount")).alias("data")))
    out = ledger.check_pages(page.select("year", "month", json.alias("json")))
    return out.groupBy("year", "month").agg(F.count("*").alias("n"), F.sum(F.get_json_object("document", "$.documentId").cast("bigint")).alias("ids"))


def registry_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry records of a year that came over two ranges, each once."""
    reg = sources.derived_feeds(spark, sf_dir)["ksef"]
    twice = reg.unionByName(reg.where("truth_key % 3 = 0").withColumn("ksef_reference", F.lower("ksef_reference")))
    return sources.registry_of_year(conform(twice), 1996).groupBy(F.month("issue_date").alias("month")).agg(F.count("*").alias("n"))


def year_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of 1996: masks, labels and what can be done, with statuses of every second document."""
    f = sources.derived_feeds(spark, sf_dir)
    f["mail"] = f["mail"].withColumn("source_path", F.concat(F.lit("mail/"), F.col("truth_key").cast("string"), F.lit(".pdf")))
    key = F.col("truth_key")
    status = f["saldeo"].where(key % 2 == 0).select(key.alias("document_id"), F.when(key % 3 == 0, True).when(key % 3 == 1, False).alias("accounting"))
    files = f["mail"].where(key % 13 != 0).select("source_path")
    table = year_table.year_table(rows.reconcile(f), 1996, F.lit("1998-01-15").cast("date"), status, status, files)
    return table.groupBy("sources", "label", "can_upload", year_table.needs_attention(F.lit(False)).alias("attention")).agg(F.count("*").alias("n"), F.count("document_id").alias("documents"))


def approve_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from triweave.queries import approve_plan

    return uploads.approve_summary(approve_plan(spark, sf_dir))


def edited_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of edited ledger records, merged into a store, by the number of fields they hold."""
    led = conform(sources.derived_feeds(spark, sf_dir)["saldeo"])
    k = F.regexp_extract("content_hash", "([0-9]+)$", 1).cast("bigint")
    after = led.withColumn("currency", F.when(k % 2 == 0, "CHF").otherwise(F.col("currency"))).withColumn("gross_amount_minor", F.when(k % 5 == 0, F.col("gross_amount_minor") + 1).otherwise(F.col("gross_amount_minor")))
    new = survivorship.override_from_edit(led, after)
    old = led.where(k % 4 == 0).select("content_hash", F.create_map(F.lit("seller_name"), F.struct(F.lit("x").alias("value"), F.col("seller_name").alias("baseline"))).alias("override"))
    return survivorship.merge_overrides(old, new).groupBy(F.size("override").alias("fields")).agg(F.count("*").alias("n"))


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each year, as runs of a year, and the one before it."""
    heads = sources.base(spark, sf_dir).select(F.year("d").alias("year"), F.col("k").alias("run_id"))
    return snapshots.previous_runs(heads).join(snapshots.last_runs(heads), ["year", "run_id"]).select("year", "run_id", "previous_run_id")


QUERIES = {
    "conflict_rows": conflict_rows, "row_keys": row_keys, "tri_csv": tri_csv, "ledger_enriched": ledger_enriched, "ledger_documents": ledger_documents, "ledger_pages": ledger_pages, "registry_year": registry_year,
    "year_rows": year_rows, "approve_counts": approve_counts, "edited_overrides": edited_overrides, "last_runs": last_runs,
}
_DONE = f"WITH {FEEDS}, e AS (SELECT s.*, k.buyer_tax_id AS kb, k.invoice_number AS kn, k.seller_name AS ks, k.content_hash AS kh FROM inv_saldeo s LEFT JOIN inv_ksef k ON s.ksef_reference = k.ksef_reference)"
ORACLE = {
    "conflict_rows": f"""WITH {BASE} SELECT 'mail:' || k || ':a' AS mail_id, 'ksef:' || k || ':a' AS ksef_id, NULL AS saldeo_id, 'gmail_ksef_missing_saldeo' AS status FROM inv_base
      UNION ALL SELECT NULL, 'ksef:' || k || ':b', 'saldeo:' || k || ':b', 'ksef_saldeo_missing_gmail' FROM inv_base UNION ALL SELECT 'mail:' || k || ':c', NULL, 'saldeo:' || k || ':c0', 'gmail_saldeo_missing_ksef' FROM inv_base WHERE k % 3 = 0""",
    "row_keys": f"WITH {BASE} SELECT 2 * count(*) + count(*) FILTER (k % 3 = 0) AS n, 2 * count(*) + count(*) FILTER (k % 3 = 0) AS n_keys FROM inv_base",
    "tri_csv": f"""WITH {ROWS}, s AS (SELECT r.*, CASE WHEN r.mail IS NOT NULL AND r.ksef IS NOT NULL THEN p.score END AS sc FROM rows r LEFT JOIN pairs p ON p.left_id = r.mail AND p.right_id = r.ksef)
      SELECT status, count(*) AS n, count(ksef) AS with_number, count(*) FILTER (sc = 100) AS full_scores FROM s GROUP BY status""",
    "ledger_enriched": f"""{_DONE} SELECT content_hash, CASE WHEN kh IS NOT NULL AND invoice_number LIKE '%.pdf' THEN kn ELSE invoice_number END AS invoice_number, CASE WHEN kh IS NOT NULL AND seller_name = 'klient' THEN ks ELSE seller_name END AS seller_name, kb AS buyer_tax_id, CASE WHEN kh IS NOT NULL THEN 'enriched from registry' ELSE '' END AS marks FROM e""",
    "ledger_documents": f"""WITH {FEEDS} SELECT content_hash, CASE WHEN truth_key % 8 = 0 THEN 'FV/' || truth_key ELSE invoice_number END AS invoice_number, CASE WHEN truth_key % 2 = 0 AND truth_key % 5 = 0 THEN 'Parsed Name' ELSE seller_name END AS seller_name FROM inv_saldeo""",
    "ledger_pages": f"WITH {BASE} SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids FROM inv_base GROUP BY ALL",
    "registry_year": f"WITH {FEEDS} SELECT CAST(month(issue_date) AS INT) AS month, count(*) AS n FROM inv_ksef WHERE year(issue_date) = 1996 GROUP BY 1",
    "year_rows": f"""WITH {ROWS}, t AS (SELECT r.*, p.issue_date, s.ref IS NOT NULL AND k.ref IS NOT NULL AND s.ref = k.ref AS same FROM rows r {'JOIN ready p ON p.content_hash = coalesce(r.mail, r.ksef, r.saldeo)'} LEFT JOIN ready k ON k.content_hash = r.ksef LEFT JOIN ready s ON s.content_hash = r.saldeo WHERE year(p.issue_date) = 1996), x AS (
      SELECT CASE WHEN mail IS NULL THEN '-' ELSE 'G' END || '/' || CASE WHEN ksef IS NULL THEN '-' ELSE 'K' END || '/' || CASE WHEN saldeo IS NULL THEN '-' ELSE 'S' END AS sources,
       CASE WHEN same AND truth_key % 2 = 0 THEN CASE truth_key % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'unmarked' END ELSE '—' END AS label, mail IS NOT NULL AND saldeo IS NULL AND truth_key % 13 <> 0 AS can_upload FROM t)
      SELECT sources, label, can_upload, NOT (sources LIKE '_/K/S' AND label = 'approved') AND (can_upload OR label = 'unmarked' OR contains(sources, '-')) AS attention, count(*) AS n, count(*) FILTER (label = 'unmarked') AS documents FROM x GROUP BY ALL""",
    "approve_counts": f"""WITH {ROWS}, d AS (SELECT bool_or(r.mail IS NOT NULL) AS m FROM rows r WHERE r.saldeo IS NOT NULL AND r.ksef IS NOT NULL AND r.truth_key % 2 = 0 GROUP BY r.truth_key) SELECT count(*) FILTER (m) AS pending, count(*) FILTER (NOT m) AS skipped, 0 AS blocked FROM d""",
    "edited_overrides": f"""WITH {FEEDS}, e AS (SELECT CASE WHEN truth_key % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN truth_key % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN truth_key % 4 = 0 THEN 1 ELSE 0 END AS fields FROM inv_saldeo) SELECT CAST(fields AS INT) AS fields, count(*) AS n FROM e WHERE fields > 0 GROUP BY 1""",
    "last_runs": f"WITH {BASE}, h AS (SELECT year(d) AS year, k AS run_id, lag(k) OVER (PARTITION BY year(d) ORDER BY k) AS previous_run_id FROM inv_base) SELECT CAST(year AS INT) AS year, run_id, previous_run_id FROM h QUALIFY row_number() OVER (PARTITION BY year ORDER BY run_id DESC) = 1",
}
