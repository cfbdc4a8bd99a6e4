"""Feed readers, flatteners of raw nested feeds, and the feeds derived from the order tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.functions.money import json_money
from triweave.functions.records import ENRICHED_MARKS, NO_NUMBER
from triweave.schema import COLUMNS, INVOICE, OWN_TAX_ID, conform
from triweave.storage import spread

FEED_FILES = ("ksef_records.jsonl", "records.jsonl", "ksef_records.json", "records.json")


def read_feed(spark: SparkSession, path: str, source: str, missing_ok: bool = False) -> DataFrame:
    """JSON lines or a JSON array of records; malformed input fails the job; ``source`` is the caller's."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(fs):
        if missing_ok:
            return spark.createDataFrame([], INVOICE)
        raise FileNotFoundError(path)
    if system.getFileStatus(fs).isDirectory():
        names = {s.getPath().getName() for s in system.listStatus(fs)}
        path = next((f"{path}/{n}" for n in FEED_FILES if n in names), path)
    reader = spark.read.schema(INVOICE).option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd")
    return conform(reader.option("multiLine", path.endswith(".json")).json(path).withColumn("source", F.lit(source)))


def write_records(df: DataFrame, path: str, array: bool = False) -> None:
    """JSON lines with nulls written out; with ``array`` each part file is one JSON array, for readers that want that form."""
    rows = df.select(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}).alias("value"))
    if not array:
        rows.write.mode("errorifexists").text(path)
        return

    def brackets(parts):
        first = True
        for batch in parts:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([("[" if first else ",") + value])], names=["value"])
                first = False
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if first else "]"])], names=["value"])

    rows.mapInArrow(brackets, "value string").write.mode("errorifexists").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Document corpus: ``content_hash`` (SHA-256 of the bytes), ``source_path, text`` of xml, json, txt, eml and pdf files.

    A pdf is opaque, its text null. Order by ``source_path`` where order matters; a table has none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,json,txt,eml,pdf,XML,JSON,TXT,EML,PDF}").load(path)
    text = F.when(~F.lower("path").endswith(".pdf"), F.decode("content", "UTF-8"))
    return files.select(F.sha2("content", 256).alias("content_hash"), F.col("path").alias("source_path"), text.alias("text"))


def registry_of_year(records: DataFrame, year: int) -> DataFrame:
    """Registry records of a year, each reference (or else hash) once, the first by content; undated ones stay."""
    key = F.coalesce(F.nullif(F.upper(F.trim("ksef_reference")), F.lit("")), F.col("content_hash"))
    once = Window.partitionBy("_key").orderBy("content_hash", F.to_json(F.struct(*COLUMNS)))
    kept = records.where(F.coalesce(F.year("issue_date") == year, F.lit(True))).withColumn("_key", key)
    return kept.withColumn("_n", F.row_number().over(once)).where("_n = 1").select(*records.columns)


def fresh_caches(caches: DataFrame, year: int, environment: str, context: str, now: Column, ttl_minutes: int = 360) -> DataFrame:
    """``feed, state`` of cached feeds (``feed, year, environment, context, written_at``): hit, stale, refused or missing.

    A cache of another year, environment or context is refused, whatever its age; with no lifetime all are stale.
    """
    same = (F.col("year") == year) & (F.col("environment") == environment) & (F.lower("context") == context.lower())
    age = F.unix_timestamp(now) - F.unix_timestamp("written_at")
    state = F.when(F.col("written_at").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "refused").when((age <= 60 * ttl_minutes) & F.lit(ttl_minutes > 0), "hit").otherwise("stale")
    return caches.select("feed", state.alias("state"))


def flatten_registry(raw: DataFrame) -> DataFrame:
    """Registry metadata rows to invoice columns; rows without a registry number go."""
    buyer = F.when(F.lower("buyer.identifier.type") == "nip", F.col("buyer.identifier.value"))
    number = F.nullif(F.trim("ksefNumber"), F.lit(""))
    out = raw.where(number.isNotNull()).select(
        F.lit("ksef").alias("source"), F.concat(F.lit("ksef:"), number).alias("source_path"), F.concat(F.lit("ksef:"), number).alias("content_hash"),
        F.col("invoiceNumber").alias("invoice_number"), F.col("seller.nip").alias("seller_tax_id"), buyer.alias("buyer_tax_id"),
        F.col("seller.name").alias("seller_name"), F.col("buyer.name").alias("buyer_name"), F.substring("issueDate", 1, 10).try_cast("date").alias("issue_date"),
        *[json_money(F.col(f"{n}Amount").cast("string")).alias(f"{n}_amount_minor") for n in ("gross", "net", "vat")],
        F.col("currency"), number.alias("ksef_reference"), F.array(F.lit(ENRICHED_MARKS[0])).alias("warnings"),
    )
    return conform(out)


def flatten_ledger(raw: DataFrame) -> DataFrame:
    """Ledger documents to invoice columns; rows without number, reference or id go."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    number, ref, doc = F.coalesce(text("number"), text("name")), text("ksefNumber"), F.col("documentId").cast("string")
    day = lambda c: F.substring(c, 1, 10).try_cast("date")
    shown = F.to_json(F.struct(*[F.col(c) for c in raw.columns]))
    out = raw.where(number.isNotNull() | ref.isNotNull() | doc.isNotNull()).select(
        F.lit("saldeo").alias("source"), F.coalesce(F.concat(F.lit("saldeo:"), doc), ref, F.sha2(shown, 256)).alias("content_hash"),
        number.alias("invoice_number"), F.coalesce(text("contractorDescription"), text("contractorName")).alias("seller_name"),
        day("issueDate").alias("issue_date"), day("saleDate").alias("sale_date"), day("paymentDate").alias("due_date"),
        *[json_money(F.col(f"{n}Price").cast("string")).alias(f"{n}_amount_minor") for n in ("gross", "net", "vat")],
        F.coalesce(text("currency"), F.get_json_object(F.col("grossPrice").cast("string"), "$.currency")).alias("currency"), ref.alias("ksef_reference"),
        F.when(number.isNull(), F.array(F.lit(NO_NUMBER))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return conform(out)


def quarter_windows(years: DataFrame, year: str = "year") -> DataFrame:
    """``year, quarter, start, stop``: four contiguous ranges of a year that is one day wider at either end."""
    q = years.select(F.col(year).alias("year"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("quarter"))
    first = lambda n: F.make_date(F.col("year"), n, F.lit(1))
    start = F.when(F.col("quarter") == 1, F.date_sub(first(F.lit(1)), 1)).otherwise(first(3 * F.col("quarter") - 2))
    stop = F.when(F.col("quarter") == 4, F.date_add(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), 1)).otherwise(F.add_months(first(3 * F.col("quarter") - 2), 3))
    return q.select("year", "quarter", start.alias("start"), stop.alias("stop"))


def mail_window(received: Column, year: int, sender: Column | None = None, senders: str = r"@amazon\.(?:it|es)\b") -> Column:
    """From December before the year to the end of January after it; with a ``sender`` column only mail from such senders."""
    inside = F.lit(True) if sender is None else F.coalesce(F.lower(sender).rlike(senders), F.lit(False))
    return inside & (received >= F.lit(f"{year - 1}-12-01").cast("timestamp")) & (received < F.lit(f"{year + 1}-02-01").cast("timestamp"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice for each order: the table that the three derived feeds are views of."""
    o, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    o = spread(o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"), "o_orderkey")
    nip = (F.lit(5000000000) + F.col("o_custkey")).cast("string")
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    zone = F.col("c_nationkey") % 3
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("k"), day.alias("d"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("g"), nip.alias("nip"), F.col("c_name").alias("nm"),
        F.when(zone == 0, "PLN").when(zone == 1, "EUR").otherwise("USD").alias("cur"),
        F.concat(nip, F.lit("-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), F.lpad(k.cast("string"), 12, "0"), F.lit("-AA")).alias("ref"),
        F.concat(F.lit("FV/"), k.cast("string"), F.lit("/"), F.year(day).cast("string")).alias("num"),
    )


def derived_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Feeds ``mail``, ``ksef`` and ``saldeo`` over the order tables, with ``truth_key`` for checks."""
    b, k = base(spark, sf_dir), F.col("k")
    text, own = k.cast("string"), F.lit(OWN_TAX_ID)
    when = lambda cond, x, other: F.when(cond, x).otherwise(other)
    common = [F.col("d").alias("issue_date"), F.col("cur").alias("currency"), k.alias("truth_key")]
    ksef = b.where(k % 10 != 0).select(
        F.lit("ksef").alias("source"), F.concat(F.lit("ksef:"), "ref").alias("content_hash"), F.col("num").alias("invoice_number"), F.col("nip").alias("seller_tax_id"), own.alias("buyer_tax_id"),
        F.col("nm").alias("seller_name"), F.col("g").alias("gross_amount_minor"), F.col("ref").alias("ksef_reference"), *common,
    )
    year = F.year("d").cast("string")
    number = (
        F.when(k % 11 == 0, None).when(k % 4 == 0, F.concat(F.lit("fv-"), F.lpad(text, 9, "0"), F.lit("-"), year))
        .when(k % 4 == 1, F.concat(F.lit("FV"), text, F.lit("/"), year)).when(k % 4 == 2, F.concat("num", F.lit("/A"))).otherwise(F.col("num"))
    )
    mail = b.where(~(k % 10).isin(1, 2)).select(
        F.lit("mail").alias("source"), F.concat(F.lit("mail:"), text).alias("content_hash"), number.alias("invoice_number"), when(k % 7 == 0, None, F.col("nip")).alias("seller_tax_id"), own.alias("buyer_tax_id"),
        when(k % 6 == 0, "Nabywca", F.col("nm")).alias("seller_name"), (F.col("g") + k % 5 - 2).alias("gross_amount_minor"), when(k % 9 == 0, F.lower(F.concat(F.lit(" "), "ref", F.lit(" "))), None).alias("ksef_reference"), *common,
    )
    saldeo = b.where(~(k % 10).isin(2, 3)).select(
        F.lit("saldeo").alias("source"), F.concat(F.lit("saldeo:"), text).alias("content_hash"), when(k % 8 == 0, F.concat(F.lit("scan_"), text, F.lit(".pdf")), F.col("num")).alias("invoice_number"), F.col("nip").alias("seller_tax_id"),
        when(k % 5 == 0, "klient", F.col("nm")).alias("seller_name"), F.col("g").alias("gross_amount_minor"), when(k % 3 == 0, F.col("ref"), None).alias("ksef_reference"), *common,
    )
    return {"mail": conform(mail, "truth_key"), "ksef": conform(ksef, "truth_key"), "saldeo": conform(saldeo, "truth_key")}
