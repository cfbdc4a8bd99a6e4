"""Corpus pipeline: the stages in order, each over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``documents``. Rows with a null ``doc_id`` cannot be named by a decision and stay; rows that share an id are one
document, and go together. Empty tables pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm import bpe, decontam, minhash, pii, toxicity
from triweave.llm.common import cut, table
from triweave.llm.queries import tokenizer_path


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` less the ids of ``gone``; the name of the joined column is one that no table has."""
    name = f"_gone_{uuid.uuid4().hex}"
    ids = gone.where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, F.col("doc_id") == F.col(name), "left_anti")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learned from all labels of these documents, calls toxic."""
    scores, _ = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return without(docs, cut(scores.where("score >= 0.5").select("doc_id")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of each class of five-word-shingle similarity 0.8."""
    classes = cut(minhash.near_duplicates(docs, words=5, percent=80))
    return without(docs, classes.where("not kept and doc_id is not null").select("doc_id").join(classes.where("kept").select("doc_id"), "doc_id", "left_anti"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or one with other numbers, names or units."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, token_ids, decoded`` of every document that is left."""
    out = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), decoded=True)
    return out.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("toxicity", toxicity_filter),
    ("minhash", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs


ORACLE_SQL = None  # learned classifiers and a byte-pair vocabulary are not SQL; tests compare with plain Python
