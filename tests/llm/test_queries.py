"""Registered queries over the given tables against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from triweave.llm import queries

public_tokenizers = pytest.importorskip("public_tokenizers")

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted((r.doc_id, r.text or "") for r in rows))


def test_personal_data_equals_the_patterns(spark, sf):
    texts = documents(spark, sf)
    got = {r.doc_id: r for r in queries.op4_pii(spark, sf).collect()}
    assert got.keys() == texts.keys()
    seen = 0
    for doc, text in texts.items():
        found = [(m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(KINDS.items()) for m in re.finditer(p, text) if holds(kind, m[0])]
        spans = [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]
        assert got[doc].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[doc][f"n_{kind}"] for kind in KINDS] == [sum(f[2] == kind for f in found) for kind in KINDS]
        assert set(spans) <= set(got[doc].spans.split(",")) | {""}
        seen += len(spans)
    assert seen > 0


def test_token_files_of_several_partitions_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    library, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_blocks(spark, sf).collect()}
    finally:
        spark.conf.set(name, before)
    texts = documents(spark, sf)
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert got[doc] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_words_of_the_library_equal_the_index(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in queries.op2_bpe(spark, sf).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in documents(spark, sf).items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[doc] == (digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_decontamination_finds_every_verbatim_item(spark):
    sf = "/root/testdata/sf0.01"
    words = lambda text: " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {doc: words(text) for doc, text in documents(spark, sf).items()}
    planted = {(doc, item) for item, of in items.items() if len(of.split()) >= 5 for doc, text in texts.items() if of in text}
    found = {(r.doc_id, r.item_id): r for r in queries.op8_decontamination(spark, sf).collect()}
    assert planted and planted <= found.keys()
    for (doc, item), r in found.items():  # whatever else is found shares most words with its item
        assert 100 * r.n_same >= 80 * r.n_words
        assert len(set(items[item].split()) & set(texts[doc].split())) >= 0.5 * len(set(items[item].split()))
