"""Stored runs and their differences, store upserts, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.schema import COLUMNS
from triweave.storage import names, write_new


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row: added, removed and changed keys between two runs of ``row_key, row_hash``."""
    p, c = previous.select("row_key", F.col("row_hash").alias("old")), current.select("row_key", F.col("row_hash").alias("new"))
    both = p.join(c, "row_key", "full_outer")
    return both.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(F.col("old") != F.col("new")).alias("changed"))


def report_hash(key: Column, row_hash: Column) -> Column:
    """Aggregate: hash of all rows' keys and hashes, whatever their order; sums of two 64-bit hashes a row, and the count."""
    pair = F.sha2(F.to_json(F.struct(key.alias("k"), row_hash.alias("h")), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(pair, at, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), part(1), part(17)), 256)


def store_run(rows: DataFrame, store: str, year: int, run_id: int, previous: int | None = None) -> None:
    """Rows first, header last: a run counts once its header is there, so a failed run leaves nothing behind.

    With ``previous``, a committed run of the year, the header also counts what was added, removed and changed since.
    """
    spark, place = rows.sparkSession, f"{store}/rows/year={year}/run_id={run_id}"
    rows.write.mode("overwrite").parquet(place)
    written = spark.read.schema(rows.schema).parquet(place)
    head = written.agg(F.count("*").alias("n_rows"), report_hash(F.col("row_key"), F.col("row_hash")).alias("report_hash"))
    since = [F.lit(previous).cast("long").alias("previous_run_id"), *[F.lit(None).cast("long").alias(c) for c in ("added", "removed", "changed")]]
    if previous is not None:
        # both sides are one row
        head = head.join(F.broadcast(diff(read_run(spark, store, year, previous), written)))
        since = [since[0], "added", "removed", "changed"]
    head.select("n_rows", "report_hash", *since).write.mode("overwrite").parquet(f"{store}/headers/year={year}/run_id={run_id}")


def claim_run(spark: SparkSession, store: str, year: int) -> int:
    """A run number that was never given out before, in any year: its claim is created exclusively, and stays.

    A run that fails leaves its number unused.
    """
    taken = [int(x) for x in names(spark, f"{store}/claims") if x.isdigit()]
    number = max(taken, default=0) + 1
    while not write_new(spark, f"{store}/claims/{number:012}", str(year)):
        number += 1
    return number


def append_run(rows: DataFrame, store: str, year: int) -> int:
    """Store a run under the next number, with its difference to the last committed run of the year; the number."""
    spark = rows.sparkSession
    done = [int(x.split("=")[1]) for x in names(spark, f"{store}/headers/year={year}") if x.startswith("run_id=")]
    whole = [n for n in sorted(done, reverse=True) if "_SUCCESS" in names(spark, f"{store}/headers/year={year}/run_id={n}")]
    number = claim_run(spark, store, year)
    store_run(rows, store, year, number, previous=next(iter(whole), None))
    return number


def read_run(spark: SparkSession, store: str, year: int, run_id: int) -> DataFrame:
    """Rows of a committed run."""
    heads = spark.read.parquet(f"{store}/headers").where((F.col("year") == year) & (F.col("run_id") == run_id))
    if heads.isEmpty():
        raise ValueError(f"run {run_id} of {year} has no header")
    return spark.read.parquet(f"{store}/rows/year={year}/run_id={run_id}")


def list_runs(spark: SparkSession, store: str, limit: int = 20) -> DataFrame:
    """Headers of the latest committed runs, the newest first; the limit is the report."""
    return spark.read.parquet(f"{store}/headers").orderBy(F.desc("run_id"), F.desc("year")).limit(limit)


def store_stats(invoices: DataFrame, headers: DataFrame, rows: DataFrame) -> DataFrame:
    """``kind, n``: records by source, runs and stored rows."""
    by_source = invoices.groupBy(F.col("source").alias("kind")).agg(F.count("*").alias("n"))
    return by_source.union(headers.agg(F.lit("runs"), F.count("*"))).union(rows.agg(F.lit("rows"), F.count("*")))


def stored_summary(rows: DataFrame) -> DataFrame:
    """``status, n`` of a run's stored rows."""
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, new: DataFrame, now) -> DataFrame:
    """Store after an upsert by (source, content_hash): all fields replaced, ``created_at`` kept, ``updated_at`` set.

    Of new rows with one key the last by content counts.
    """
    key = ["source", "content_hash"]
    rest = F.struct(*[c for c in COLUMNS if c not in key])
    new = new.groupBy(*key).agg(F.max_by(rest, F.to_json(rest)).alias("r")).select(*[F.col(c) if c in key else F.col(f"r.{c}") for c in COLUMNS])
    born = stored.groupBy(*key).agg(F.min("created_at").alias("created_at"))
    fresh = new.join(born, key, "left").select(*COLUMNS, F.coalesce("created_at", F.lit(now).cast("timestamp")).alias("created_at"), F.lit(now).cast("timestamp").alias("updated_at"))
    return stored.join(new.select(*key), key, "left_anti").select(*COLUMNS, "created_at", "updated_at").unionByName(fresh)


def write_invoices(df: DataFrame, store: str) -> str:
    """Write the store's next version beside the last, then say in ``current`` that it is whole; readers go by that.

    A write that fails leaves the last version in place.
    """
    version = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy("source").parquet(f"{store}/{version}")
    spark = df.sparkSession
    at = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written_at"))
    at.coalesce(1).write.mode("append").parquet(f"{store}/current")
    return version


def read_invoices(spark: SparkSession, store: str, source: str | None = None) -> DataFrame:
    """Records of the newest whole version, of one source or of all; only that source's files are read."""
    latest = spark.read.parquet(f"{store}/current").orderBy(F.desc("written_at"), F.desc("version")).first()
    rows = spark.read.parquet(f"{store}/{latest.version}")
    return rows if source is None else rows.where(F.col("source") == source)


def previous_runs(headers: DataFrame) -> DataFrame:
    """``run_id`` and the run before it of the same year."""
    return headers.withColumn("previous_run_id", F.lag("run_id").over(Window.partitionBy("year").orderBy("run_id")))


def last_runs(headers: DataFrame) -> DataFrame:
    """The last run of each year."""
    return headers.groupBy("year").agg(F.max("run_id").alias("run_id"))
