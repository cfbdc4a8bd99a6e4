"""Mail feed jobs: attachments of message trees, header joins, new-file tests, enrichment queues and their ledger."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triweave.functions.records import has_invoice_signal, missing_core_fields, needs_paid_enrichment, number_guessed, password_protected, unreadable
from triweave.schema import OWN_TAX_ID

ALLOWED = ("xml", "json", "txt", "eml", "pdf")
# File names that are no invoices.
NO_INVOICE = ("receipt", "statement", "regulamin", "warunki", "informacje", "upowa", "oferta", "umowa", "order", "label", "bilet", "dr_skan", "wypowiedzenie", "grafklient", "cennik", "polityka", "pasek", "wishlist", "terms", "portfolio", "kosztorys", "formularz", "prawo_jazdy", "zalacznik")
ATTACHMENT = {"message_id": "string", "ordinal": "int", "filename": "string", "data": "string", "attachment_id": "string"}
ATTACHMENT_TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
ATTEMPT = "content_hash string, model string, version string, outcome string, attempted_at timestamp, detail string"


def headers_map(headers) -> F.Column:
    """Header array to a map, names in lower case, the later of two wins."""
    pairs = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    names = F.transform(pairs, lambda p: p["name"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"]))
    return F.map_from_entries(last)


def _text(value) -> str | None:
    """A JSON value as text: strings as they are, others as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _parts(payload: str | None) -> Iterator[tuple[str | None, str | None, str | None, str | None]]:
    """``filename, mime, data, attachment_id`` of each part of a tree, children before their parent."""
    try:
        stack = [(json.loads(payload or "null"), False)]
    except (ValueError, RecursionError):  # no JSON, or nested deeper than a parser takes
        return
    while stack:
        part, walked = stack.pop()
        if not isinstance(part, dict):
            continue
        children = part.get("parts")
        if isinstance(children, list) and children and not walked:
            stack.append((part, True))
            stack.extend((child, False) for child in reversed(children))
            continue
        body = part.get("body") if isinstance(part.get("body"), dict) else {}
        yield (_text(part.get("filename")) or "").strip(" ") or None, _text(part.get("mimeType")), _text(body.get("data")), _text(body.get("attachmentId"))


def explode_attachments(messages: DataFrame, message_id: str = "id", payload: str = "payload") -> DataFrame:
    """``message_id, ordinal, filename, data, attachment_id`` of the allowed parts of message trees (JSON text), children first.

    Each tree is walked once, to any depth that the JSON parser takes, in the task that reads its message: no shuffle.
    Unnamed plain-text parts get a name; numbering counts every allowed part, and parts with neither data nor an
    attachment id go after it. A null payload, one that is no JSON and a part that is no object have no attachments.
    """
    source = messages.select(F.col(message_id).cast("string").alias("message_id"), F.col(payload).alias("payload"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, n = [], 0
                for named, mime, data, attachment in _parts(tree.as_py()):
                    body = named is None and mime == "text/plain"
                    if not body and (named is None or "." not in named or named.rsplit(".", 1)[1].lower() not in ALLOWED):
                        continue
                    if data is not None or attachment is not None:
                        rows.append((of, n, named or (f"{of}_body_{n}.txt" if of is not None else None), data, attachment))
                    n += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ATTACHMENT_TYPES, strict=True)], names=list(ATTACHMENT))

    return source.mapInArrow(walk, ", ".join(f"{c} {t}" for c, t in ATTACHMENT.items()))


def join_headers(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Fills blank message fields of records by the message id in the attachment's file name, ``<id>_<n>_<name>``.

    ``headers``: ``message_id, subject, sender`` and, if there is one, ``header_id``, the id that the message itself
    states. Of several headers of a message the first by content counts.
    """
    key = F.nullif(F.regexp_extract("source_path", "(?:^|/)([^/_]+)_[0-9]+_[^/]+$", 1), F.lit(""))
    own = F.nullif(F.trim("header_id"), F.lit("")) if "header_id" in headers.columns else F.lit(None).cast("string")
    h = headers.groupBy(F.col("message_id").alias("_m")).agg(F.min(F.struct(own.alias("id"), "subject", "sender")).alias("_h"))
    out = records.withColumn("_k", key).join(h, F.col("_k") == F.col("_m"), "left")
    blank = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.nullif(F.trim(other), F.lit(""))).alias(c)
    cols = {"email_message_id": blank("email_message_id", F.coalesce("_h.id", "_m")), "email_subject": blank("email_subject", F.col("_h.subject")), "email_from": blank("email_from", F.col("_h.sender"))}
    return out.select(*[cols.get(c, F.col(c)) for c in records.columns])


def new_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path and hash are both unknown; a known null matches nothing."""
    return found.join(known.select("source_path"), "source_path", "left_anti").join(known.select("content_hash"), "content_hash", "left_anti").select(*found.columns)


def all_paths(saved: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Distinct ``source_path`` of files that a fetch saved and files found on disk."""
    return saved.select("source_path").union(on_disk.select("source_path")).distinct()


def complete_messages(plan: DataFrame, present: DataFrame) -> DataFrame:
    """``message_id, complete``: every planned attachment (``message_id, filename``) is present."""
    p = present.select("message_id", "filename").distinct().withColumn("_here", F.lit(True))
    return plan.join(p, ["message_id", "filename"], "left").groupBy("message_id").agg(F.bool_and(F.coalesce("_here", F.lit(False))).alias("complete"))


def candidate_year(records: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Records issued in the year or undated, and ``dropped``, how many others there are; the sale date does not count."""
    keep = F.coalesce(F.year("issue_date") == year, F.lit(True))
    return records.where(keep), records.agg(F.count_if(~keep).alias("dropped"))


def company_candidates(records: DataFrame, own_name: str, own: str = OWN_TAX_ID, keep_unread: bool = False, bad_words: tuple[str, ...] = NO_INVOICE) -> DataFrame:
    """Invoices of the own company, by id or name, without passwords or telling file names.

    With ``keep_unread`` also documents whose text could not be read, if anything about them says invoice.
    """
    name = F.lower(F.regexp_extract(F.coalesce("source_path", F.lit("")), "([^/]*)$", 1))
    names = F.lower(F.concat_ws(" ", "seller_name", "buyer_name"))
    related = F.coalesce(F.col("seller_tax_id") == own, F.lit(False)) | F.coalesce(F.col("buyer_tax_id") == own, F.lit(False)) | names.contains(own_name.lower())
    waiting = F.lit(keep_unread) & unreadable() & has_invoice_signal()
    bad = name.rlike("|".join(bad_words)) if bad_words else F.lit(False)
    return records.where(~password_protected() & (related | waiting) & ~bad)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """Ledger of model attempts: broken lines are dropped, of each (hash, model, version) the last entry counts."""
    rows = spark.read.schema(ATTEMPT).option("mode", "DROPMALFORMED").json(path)
    key = ("content_hash", "model", "version")
    last = Window.partitionBy(*key).orderBy(F.desc("attempted_at"), F.desc("outcome"), F.desc("detail"))
    return rows.where("content_hash is not null and outcome is not null").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def enrichment_queue(records: DataFrame, skip: DataFrame, paid: bool, forced: bool = False) -> DataFrame:
    """PDF records that a model should read: not in ``skip`` (``content_hash``), without a password.

    A paid model gets those that look like invoices and lack hard fields; a forced request, or a free one, all that lack
    core fields or have a guessed number.
    """
    pdf = F.lower(F.coalesce("source_path", F.lit(""))).endswith(".pdf")
    need = needs_paid_enrichment() if paid and not forced else missing_core_fields() | number_guessed()
    return records.join(skip.select("content_hash"), "content_hash", "left_anti").where(pdf & ~password_protected() & need).select(*records.columns)


def skip_attempted(queue: DataFrame, attempts: DataFrame, model: str, version: str, request: str = "automatic") -> DataFrame:
    """Queue without documents that this model and version already answered for good; the last attempt counts.

    Explicit and forced requests ask again.
    """
    if request not in ("automatic", "explicit", "forced"):
        raise ValueError(request)
    if request != "automatic":
        return queue
    last = Window.partitionBy("content_hash").orderBy(F.desc("attempted_at"), F.desc("outcome"))
    done = attempts.where((F.col("model") == model) & (F.col("version") == version)).withColumn("_n", F.row_number().over(last)).where("_n = 1 and outcome <> 'transient'")
    return queue.join(done, "content_hash", "left_anti")

