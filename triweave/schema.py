"""The invoice record: one schema for all feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SOURCES = ("mail", "ksef", "saldeo")  # slots of a row, in order
OWN_TAX_ID = "5242920020"  # default of every own-company parameter

_TEXT = T.StringType()
INVOICE = T.StructType(
    [T.StructField("source", _TEXT, False), T.StructField("source_path", _TEXT), T.StructField("content_hash", _TEXT, False)]
    + [T.StructField(c, _TEXT) for c in ("invoice_number", "seller_tax_id", "buyer_tax_id", "seller_name", "buyer_name")]
    + [T.StructField(c, T.DateType()) for c in ("issue_date", "sale_date", "due_date")]
    + [T.StructField(c, T.LongType()) for c in ("gross_amount_minor", "net_amount_minor", "vat_amount_minor")]
    + [T.StructField(c, _TEXT) for c in ("currency", "ksef_reference", "email_message_id", "email_subject", "email_from")]
    + [T.StructField("warnings", T.ArrayType(T.StringType()), False)]
)
COLUMNS = INVOICE.fieldNames()


def conform(df: DataFrame, *extra: str) -> DataFrame:
    """All invoice columns in order, absent ones null, plus ``extra`` columns; unknown sources are an error."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in INVOICE]
    cols[0] = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce("source", F.lit("null"))))).alias("source")
    cols[-1] = F.coalesce(cols[-1], F.array().cast("array<string>")).alias("warnings")
    return df.select(*cols, *extra)


def canonical_key(prefix: str = "") -> F.Column:
    """Content key that orders records: JSON of all columns, nulls written out."""
    return F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in COLUMNS]), {"ignoreNullFields": "false"})


def one_of(records: DataFrame, key: str, order: F.Column, last: bool = False) -> DataFrame:
    """The first record of each key in ``order``, of those that tie the first (or ``last``) by content.

    One sort of rows no wider than a record: contents are written out only where records tie, and compared in the frame.
    """
    sorted_ = Window.partitionBy(key).orderBy(order)
    peers = sorted_.rangeBetween(Window.currentRow, Window.currentRow)
    rows = records.withColumn("_n", F.row_number().over(sorted_)).withColumn("_ties", F.count("*").over(peers))
    pick, own = F.max_by if last else F.min_by, F.struct(*records.columns)
    rows = rows.withColumn("_one", pick(F.when(F.col("_ties") > 1, own), F.when(F.col("_ties") > 1, canonical_key())).over(peers))
    return rows.where("_n = 1").select(F.coalesce("_one", own).alias("_one")).select("_one.*")
