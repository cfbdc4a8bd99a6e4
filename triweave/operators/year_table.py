"""The table of a year: rows to show, their accounting status, filters, actions, and what a refresh changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.functions.dates import target_period
from triweave.functions.records import counterparty_name, has_override, ledger_document_id, user_warnings
from triweave.operators.rows import display
from triweave.schema import OWN_TAX_ID, SOURCES


def in_year(records: DataFrame, year: int, strict: bool = False) -> DataFrame:
    """Records issued (or else sold) in the year; undated ones too, unless ``strict``."""
    day = F.coalesce("issue_date", "sale_date")
    return records.where(F.coalesce(F.year(day) == year, F.lit(not strict)))


def row_order(rows: DataFrame) -> DataFrame:
    """Rows in report order: mail rows, then registry with ledger, registry alone, ledger alone; each by content."""
    bucket = F.when(F.col("mail").isNotNull(), 0).when(F.col("ksef").isNotNull() & F.col("saldeo").isNotNull(), 1).when(F.col("ksef").isNotNull(), 2).otherwise(3)
    return rows.orderBy(bucket, F.to_json(F.coalesce(*SOURCES), {"ignoreNullFields": "false"}))


def slash_mask() -> Column:
    """Sources of a row as ``G/K/S``, a dash for an absent one; a star where the ledger record was corrected."""
    parts = [F.when(F.col(s).isNotNull(), n).otherwise("-") for s, n in zip(SOURCES, "GKS", strict=True)]
    return F.concat(F.concat_ws("/", *parts), F.when(F.coalesce(has_override(F.col("saldeo.source"), F.col("saldeo.warnings")), F.lit(False)), "*").otherwise(""))


def row_warnings() -> Column:
    """``array<struct<source, warning>>``: warnings for people of the row's records, mail first."""
    return F.concat(*[_letter(s, letter) for s, letter in zip(SOURCES, "GKS", strict=True)])


def _letter(source: str, letter: str) -> Column:
    known = F.coalesce(user_warnings(F.col(f"{source}.warnings")), F.array().cast("array<string>"))
    return F.transform(known, lambda w: F.struct(F.lit(letter).alias("source"), w.alias("warning")))


def status_label(document: Column, accounting: Column) -> Column:
    return F.when(document.isNotNull() & accounting.isNull(), "unmarked").when(accounting, "approved").when(~accounting, "rejected").otherwise("—")


def year_table(rows: DataFrame, year: int, today: Column, shown: DataFrame, fresh: DataFrame, files: DataFrame, own: str = OWN_TAX_ID) -> DataFrame:
    """Rows of a report (three record structs) that belong to a year, with what can be done about them.

    ``shown`` and ``fresh``: accounting status (``document_id, accounting``) for labels and for actions; a document
    counts only if its reference is that of the registry record, and can be marked only if its fresh status is there
    and null. ``files``: ``source_path`` of files at hand; a mail record that the ledger lacks can be uploaded if its
    file is there and its period fits.
    """
    ref = lambda s: F.nullif(F.trim(F.col(f"{s}.ksef_reference")), F.lit(""))
    r = rows.select(*SOURCES, "status", display().alias("record"), slash_mask().alias("sources"), row_warnings().alias("notes"), F.when(ref("ksef") == ref("saldeo"), ledger_document_id(F.col("saldeo.content_hash"))).alias("_doc"))
    day = lambda p: F.coalesce(F.col(f"{p}.issue_date"), F.col(f"{p}.sale_date"))
    r = r.where(F.coalesce(F.year(day("record")) == year, F.lit(True)) | F.coalesce(F.year(day("saldeo")) == year, F.lit(False)))
    one = lambda df, name, c: df.groupBy(F.col("document_id").alias(name)).agg(F.max(F.struct(F.lit(1).alias("there"), "accounting")).alias(c))
    r = r.join(one(shown, "_s", "_shown"), F.col("_doc") == F.col("_s"), "left").join(one(fresh, "_f", "_fresh"), F.col("_doc") == F.col("_f"), "left")
    r = r.join(files.select(F.col("source_path").alias("_p")).distinct(), F.col("mail.source_path") == F.col("_p"), "left")
    fits = target_period(F.col("mail.issue_date"), year, today)["year"].isNotNull()
    markable = F.when(F.col("_fresh").isNotNull() & F.col("_fresh.accounting").isNull(), F.col("_doc"))
    out = r.select(
        F.col("record.content_hash").alias("row_key"), "sources", F.when(F.size("notes") > 0, F.concat("sources", F.lit("!"))).otherwise(F.col("sources")).alias("cell"), "record", *SOURCES, "status",
        (F.col("mail").isNotNull() & F.col("saldeo").isNull() & F.col("_p").isNotNull() & fits).alias("can_upload"), markable.alias("document_id"), F.col("_shown.accounting").alias("accounting"), "notes",
    )
    return out.withColumn("label", status_label(F.col("document_id"), F.col("accounting")))


def approved() -> Column:
    """Approved, with registry and ledger record."""
    return F.col("sources").rlike("^./K/S") & F.coalesce(F.col("accounting"), F.lit(False))


def actionable() -> Column:
    return F.col("can_upload") | F.col("document_id").isNotNull()


def needs_attention(updated: Column) -> Column:
    """Not approved, and something can be done, is missing, was corrected or has changed."""
    return ~approved() & (actionable() | F.col("sources").contains("-") | updated | F.col("sources").endswith("*"))


def visible(table: DataFrame, hide_approved: bool) -> DataFrame:
    return table.where(~approved()) if hide_approved else table


def signature(own_name: str, own: str = OWN_TAX_ID) -> Column:
    """What a reader sees of a row; a row whose signature is another than before has changed."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = counterparty_name(F.lit(own_name.lower()), "record.", own)
    return F.concat_ws("|", "sources", text("record.invoice_number"), name, text("record.issue_date"), F.coalesce("record.gross_amount_minor", F.lit(0)).cast("string"), text("record.currency"), "label", F.col("can_upload").cast("string"), F.col("document_id").isNotNull().cast("string"))


def mark_updated(previous: DataFrame, table: DataFrame, own_name: str = "", live: DataFrame | None = None, accepted: DataFrame | None = None) -> DataFrame:
    """Adds ``updated``: the row was not there before with this signature, or its mail record (``live``: ``content_hash``) or action (``accepted``: ``row_key``) was just changed."""
    sign = signature(own_name)
    before = previous.select(F.col("row_key").alias("_k"), sign.alias("_s")).distinct()
    t = table.withColumn("_sign", sign).join(before, (F.col("row_key") == F.col("_k")) & (F.col("_sign") == F.col("_s")), "left").withColumn("updated", F.col("_k").isNull()).drop("_k", "_s", "_sign")
    for other, column, key in ((live, "content_hash", F.col("mail.content_hash")), (accepted, "row_key", F.col("row_key"))):
        if other is not None:
            t = t.join(other.select(F.col(column).alias("_o")).distinct(), key == F.col("_o"), "left").withColumn("updated", F.col("updated") | F.col("_o").isNotNull()).drop("_o")
    return t


def apply_mail_update(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows with changed mail records (by content hash) in place of the ones they hold, and ``touched`` where that changed anything.

    Display, upload and period follow when the table is built from them.
    """
    new = changed.groupBy(F.col("content_hash").alias("_h")).agg(F.min(F.struct(*changed.columns)).alias("_new"))
    out = rows.join(new, F.col("mail.content_hash") == F.col("_h"), "left")
    touched = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("mail"))
    return out.select(*[F.when(touched, F.col("_new")).otherwise(F.col("mail")).alias("mail") if c == "mail" else F.col(c) for c in rows.columns], touched.alias("touched"))


def refresh_rows(table: DataFrame, rows: DataFrame, changed: DataFrame, year: int, today: Column, shown: DataFrame, fresh: DataFrame, files: DataFrame, own: str = OWN_TAX_ID) -> tuple[DataFrame, DataFrame]:
    """The report's rows and its year table after mail records have changed; only rows that hold one are built again.

    ``table`` is what ``year_table`` gave for ``rows``, with further columns if need be, which are null in new rows. A
    row that a changed date moves into the year or out of it comes or goes. Statuses and files are looked up for the
    touched rows alone, so other rows keep what was read before.
    """
    after = apply_mail_update(rows, changed)
    again = year_table(after.where("touched").drop("touched"), year, today, shown, fresh, files, own)
    kept = apply_mail_update(table, changed).where("not touched").select(*table.columns)
    return after.drop("touched"), kept.unionByName(again, allowMissingColumns=True)


def action_split(chosen: DataFrame) -> dict[str, DataFrame]:
    """Rows with an ``action`` (upload, approve, reject) that they accept, as one table each: mail files to upload, documents to mark."""
    pick = lambda a: chosen.where(F.col("action") == a)
    ids = lambda a: pick(a).where("document_id is not null").select("document_id").distinct()
    return {"upload": pick("upload").where("can_upload").select("row_key", F.col("mail.source_path").alias("source_path")), "approve": ids("approve"), "reject": ids("reject")}


def review_counts(chosen: DataFrame) -> DataFrame:
    """One row: rows by action, selected and updated ones."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return chosen.agg(count("upload"), count("approve"), count("reject"), F.count_if("selected").alias("selected"), F.count_if("updated").alias("updated"))
