"""Flat reports: reconcile rows and upload plans as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triweave.functions.money import format_minor
from triweave.operators.rows import display


def tri_report(rows: DataFrame) -> DataFrame:
    """The twelve report columns of three-way rows, all text, absent values empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    d = rows.withColumn("_d", display())
    cols = {
        "status": F.col("status"), "mail_invoice_number": F.col("mail.invoice_number"), "ksef_invoice_number": F.col("ksef.invoice_number"), "saldeo_invoice_number": F.col("saldeo.invoice_number"),
        "ksef_number": F.col("ksef.ksef_reference"), "saldeo_ksef_number": F.col("saldeo.ksef_reference"), "issue_date": F.col("_d.issue_date"), "gross_amount_minor": F.col("_d.gross_amount_minor"), "currency": F.col("_d.currency"),
    }
    cols |= {c: F.col(c) for c in ("mail_score_to_ksef", "mail_score_to_saldeo", "ksef_score_to_saldeo")}
    return d.select(*[text(c).alias(n) for n, c in cols.items()])


def write_csv(report: DataFrame, path: str) -> None:
    report.write.option("header", "true").option("emptyValue", "").mode("errorifexists").csv(path)


PLAN_COLUMNS = ("upload_status", "status", "related_sources", "content_hash", "source_path", "file_sha256", "invoice_number", "contractor", "issue_date", "gross_amount", "currency", "period", "can_upload", "own_id_check", "document_id", "response_status", "error")


def plan_report(plan: DataFrame) -> DataFrame:
    """The seventeen columns of an upload plan, all text: sources joined by ``+``, period as ``YYYY-MM``; what a plan lacks is empty."""
    period = F.when(F.col("period_year").isNotNull(), F.format_string("%d-%02d", "period_year", "period_month"))
    made = {"related_sources": F.array_join("related_sources", "+"), "period": period, "gross_amount": format_minor(F.col("gross_amount_minor"))}
    text = lambda c: made[c] if c in made else F.col(c).cast("string") if c in plan.columns else F.lit(None).cast("string")
    return plan.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in PLAN_COLUMNS])
