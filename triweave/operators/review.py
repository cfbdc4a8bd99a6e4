"""Review table: sorting, accounting status with null kept apart from missing, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_review(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sorted by one column, nulls last both ways, text without regard to case."""
    c = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(F.desc_nulls_last(c) if descending else F.asc_nulls_last(c))


def read_status(feed: DataFrame, json: str = "json") -> DataFrame:
    """``document_id, accounting``: documents whose accounting is there, null or boolean; a missing one gives no row.

    A response that is no success fails the job.
    """
    v = feed.select(F.try_parse_json(json).alias("v"))
    ok = F.coalesce(F.try_variant_get("v", "$.status", "string"), F.lit("none")) == "SUCCESS"
    v = v.select(F.when(ok, F.col("v")).otherwise(F.raise_error(F.lit("status feed is no success"))).alias("v"))
    item = v.select(F.explode(F.try_variant_get("v", "$.data", "array<variant>")).alias("d"))
    value = F.try_variant_get("d", "$.accounting", "variant")
    known = F.is_variant_null(value) | F.try_variant_get("d", "$.accounting", "boolean").isNotNull()
    return item.where(value.isNotNull() & known).select(F.try_variant_get("d", "$.documentId", "bigint").alias("document_id"), F.try_variant_get("d", "$.accounting", "boolean").alias("accounting"))


def overlay_status(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Live status where there is one, null included, else the cached one."""
    c, l = cached.select("document_id", F.struct("accounting").alias("c")), live.select("document_id", F.struct("accounting").alias("l"))
    return c.join(l, "document_id", "full_outer").select("document_id", F.when(F.col("l").isNotNull(), F.col("l.accounting")).otherwise(F.col("c.accounting")).alias("accounting"))


def unmarked(asked: DataFrame, status: DataFrame) -> DataFrame:
    """Distinct asked documents, in order, whose status is there and null."""
    return asked.select("document_id").distinct().join(status.where("accounting is null"), "document_id", "left_semi").orderBy("document_id")
