"""Ledger feed jobs: polymorphic input, completeness of pages, completion of records from the registry and from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.records import ENRICHED_MARKS, NO_NUMBER, needs_document
from triweave.operators.survivorship import apply_overrides, filled
from triweave.schema import COLUMNS, INVOICE, conform, one_of
from triweave.sources.feeds import flatten_ledger, read_feed

LEDGER_DOCUMENT = "documentId string, number string, name string, ksefNumber string, issueDate string, saleDate string, paymentDate string, grossPrice string, netPrice string, vatPrice string, currency string, contractorDescription string, contractorName string"


def read_ledger(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> DataFrame:
    """Ledger records from JSON lines of records, a JSON array of records, or one of raw documents; overrides are applied.

    Which of them it is shows in the fields of the input; input that is neither is an error.
    """
    if path.endswith(".jsonl"):
        records = read_feed(spark, path, "saldeo")
    else:
        fields = set(spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path).columns)
        if "content_hash" in fields and fields <= set(INVOICE.fieldNames()):
            records = read_feed(spark, path, "saldeo")
        elif fields & {"documentId", "number", "ksefNumber"}:
            records = flatten_ledger(spark.read.schema(LEDGER_DOCUMENT).option("multiLine", "true").option("mode", "FAILFAST").json(path))
        else:
            raise ValueError(f"neither records nor ledger documents: {sorted(fields)}")
    return records if overrides is None else apply_overrides(records, overrides)


def check_pages(pages: DataFrame, json: str = "json") -> DataFrame:
    """``year, month, document`` of all pages (``year, month`` and the response text).

    An error if a response states another status than SUCCESS, has no result array, or if a month's pages hold fewer
    documents than its total. That is found out at once, by one row for the first bad month: a check inside the result
    would be skipped where the optimiser finds no documents to give.
    """
    v = F.try_parse_json(json)
    items = F.try_variant_get(v, "$.data.resultCollection", "array<variant>")
    total = F.coalesce(F.try_variant_get(v, "$.data.totalCount", "bigint"), F.try_variant_get(v, "$.data.pagination.totalCount", "bigint"))
    read = pages.select("year", "month", F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("SUCCESS")).alias("status"), total.alias("total"), items.alias("items"))
    sums = read.groupBy("year", "month").agg(F.max(F.when(F.col("status") != "SUCCESS", F.col("status"))).alias("status"), F.bool_or(F.col("items").isNull()).alias("without"), F.max("total").alias("total"), F.sum(F.when(F.col("items").isNotNull(), F.size("items")).otherwise(0)).alias("n"))
    bad = sums.where((F.col("status").isNotNull()) | F.col("without") | (F.col("total") > F.col("n"))).orderBy("year", "month").first()
    if bad is not None:
        problem = f"status {bad.status}" if bad.status else "no result array" if bad.without else f"{bad.n} of {bad.total} documents"
        raise ValueError(f"ledger pages of {bad.year}-{bad.month}: {problem}")
    return read.select("year", "month", F.explode("items").alias("document")).select("year", "month", F.to_json("document").alias("document"))


def _completed(records: DataFrame, other: DataFrame, on: str, mark: str, due) -> DataFrame:
    """Records filled from the last of ``other`` with the same key, marked if that changed anything.

    Records that nothing is looked up for are dealt by their content hash, as a null key would send them all to one task.
    Contents are written out only where hashes tie, so what is shuffled is no wider than a record.
    """
    key = F.concat(F.lit("="), F.col(on))
    last = one_of(other.where(F.col(on).isNotNull()).select(key.alias("_key"), *COLUMNS), "_key", F.desc("content_hash"), last=True)
    last = last.select("_key", F.struct(*COLUMNS).alias("s"))
    wanted = F.coalesce(F.when(due, key), F.concat(F.lit("-"), "content_hash"))
    rows = records.select(F.struct(*COLUMNS).alias("t"), wanted.alias("_on")).join(last, F.col("_on") == F.col("_key"), "left")
    rows = rows.withColumn("n", F.when(F.col("s").isNotNull(), filled(F.col("t"), F.col("s"))).otherwise(F.col("t")))
    changed = ~F.col("n").eqNullSafe(F.col("t"))
    named = F.filter("n.warnings", lambda w: ~((w == NO_NUMBER) & F.col("n.invoice_number").isNotNull()))
    warnings = F.when(changed, F.concat(named, F.array(F.lit(mark)))).otherwise(F.col("t.warnings"))
    return conform(rows.select(*[F.col(f"n.{c}") for c in COLUMNS if c != "warnings"], warnings.alias("warnings")))


def enrich_from_registry(ledger: DataFrame, registry: DataFrame) -> DataFrame:
    """Ledger records filled from the registry record with the same reference."""
    return _completed(ledger, registry, "ksef_reference", ENRICHED_MARKS[1], F.lit(True))


def enrich_from_documents(ledger: DataFrame, parsed: DataFrame) -> DataFrame:
    """Ledger records that lack basic fields filled from their parsed document, which has the same content hash."""
    return _completed(ledger, parsed, "content_hash", ENRICHED_MARKS[2], needs_document())
