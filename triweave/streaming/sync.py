"""Incremental document sync: a file stream whose batches are parsed once and merged into a versioned store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.functions.records import PARSER_PREFIX, needs_retry
from triweave.operators.candidates import reread
from triweave.operators.extraction import extract_documents
from triweave.operators.mailbox import join_headers
from triweave.schema import COLUMNS, INVOICE
from triweave.sources.feeds import read_documents
from triweave.sources.stores import KeyedStore
from triweave.storage import cut

PARSER_VERSION = "v2"
READ = ("xml", "json", "txt", "eml", "pdf")  # extensions, in any case; a pdf is opaque


def document_store(spark: SparkSession, store: str) -> KeyedStore:
    return KeyedStore(spark, store, ("content_hash",))


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Current records; empty before the first sync."""
    return document_store(spark, store).read(schema=INVOICE).select(*COLUMNS)


def stamped(records: DataFrame) -> DataFrame:
    """Records with this parser's version, unless reading failed and is to be tried again."""
    return records.withColumn("warnings", F.when(needs_retry(), F.col("warnings")).otherwise(F.concat("warnings", F.array(F.lit(PARSER_PREFIX + PARSER_VERSION)))))


def sync_documents(spark: SparkSession, documents: str, store: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = extract_documents, headers: DataFrame | None = None) -> None:
    """Parse files that the stream has not seen, skip contents the store has, add the rest; then stop.

    ``headers`` fill the message fields. Exactly once: the store keeps the number of the last batch with its version.
    Only the buckets that a batch's hashes lie in are read and rewritten.
    """
    pattern = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in x) for x in READ) + "}"
    files = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(documents)
    text = F.when(~F.lower("path").endswith(".pdf"), F.decode("content", "UTF-8"))
    docs = files.select(F.sha2("content", 256).alias("content_hash"), F.col("path").alias("source_path"), text.alias("text"))
    kept = document_store(spark, store)

    def merge(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("content_hash").agg(F.min(F.struct("source_path", "text")).alias("d")).select("content_hash", "d.*")
        known = kept.read(buckets=kept.met(once), schema=INVOICE).select("content_hash")
        fresh = stamped(parse(once.join(known, "content_hash", "left_anti")))
        fresh = cut(fresh if headers is None else join_headers(fresh, headers)).select(*COLUMNS)
        kept.merge(fresh, lambda stored, new: stored.select(*COLUMNS).unionByName(new), batch=(checkpoint, number))

    query = docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def refresh_documents(spark: SparkSession, documents: str, store: str, parse: Callable[[DataFrame], DataFrame] = extract_documents, version: str = PARSER_VERSION) -> int:
    """Read again what an older parser read or what failed; what cannot be read stays as it is. Number of changed records.

    The changed records replace the stored ones in one new version, and only if there are any. A record keeps its key,
    so a document that changed on disk is one for ``sync_documents``.
    """
    stored = read_store(spark, store)
    due = stored.where(~F.array_contains("warnings", PARSER_PREFIX + version) | needs_retry())
    if due.isEmpty():
        return 0
    files = read_documents(spark, documents).join(due.select("source_path", "content_hash"), ["source_path", "content_hash"], "left_semi")
    parsed = parse(files.where("text is not null"))
    new = reread(due, parsed, version)
    old = due.select(F.struct(*COLUMNS).alias("_old"))
    changed = cut(new.join(old, F.struct(*[new[c] for c in COLUMNS]).eqNullSafe(F.col("_old")), "left_anti").select(*COLUMNS))
    n = changed.count()
    if n:
        document_store(spark, store).merge(changed, lambda stored, new: stored.join(new.select("content_hash"), "content_hash", "left_anti").select(*COLUMNS).unionByName(new))
    return n
