"""Keyed stores and run history: whole versions, untouched buckets, numbers that are given out once."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from triweave.operators import snapshots
from triweave.schema import COLUMNS, INVOICE
from triweave.sources import stores
from triweave.sources.stores import Conflict, KeyedStore
from triweave.storage import names, read_text, write_new


def invoices(spark, *rows):
    base = dict.fromkeys(COLUMNS) | {"warnings": []}
    return spark.createDataFrame([tuple((base | {"source": "mail", "content_hash": h, "invoice_number": n})[c] for c in COLUMNS) for h, n in rows], INVOICE)


def held(store, version=None):
    return {r.content_hash: (r.invoice_number, r.created_at.day, r.updated_at.day) for r in store.read(version).collect()}


def test_upsert_is_whole_or_nothing(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ("source", "content_hash"), buckets=4)
    first = stores.upsert_invoices(store, invoices(spark, ("a", "1"), ("b", "2")), "2026-01-01 00:00:00")
    assert stores.upsert_invoices(store, invoices(spark, ("b", "3"), ("c", "4"), ("c", "4")), "2026-01-02 00:00:00") == first + 1
    want = {"a": ("1", 1, 1), "b": ("3", 1, 2), "c": ("4", 2, 2)}
    assert held(store) == want and held(store, first) == {"a": ("1", 1, 1), "b": ("2", 1, 1)}  # a reader keeps its version

    # killed after the data is written and before the manifest
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            stores.upsert_invoices(store, invoices(spark, ("a", "9"), ("d", "9")), "2026-01-03 00:00:00")
    assert held(store) == want
    # killed inside the writing of the manifest
    (tmp_path / "s/manifests/000000000007").write_text('{"live": {')
    assert held(store) == want
    assert stores.upsert_invoices(store, invoices(spark, ("d", "5")), "2026-01-03 00:00:00") == 8
    assert held(store) == want | {"d": ("5", 3, 3)}
    # killed while files are written
    bad = invoices(spark, ("a", "9")).withColumn("invoice_number", F.raise_error(F.lit("executor lost")).cast("string"))
    with pytest.raises(Exception, match="executor lost"):
        stores.upsert_invoices(store, bad, "2026-01-04 00:00:00")
    assert held(store) == want | {"d": ("5", 3, 3)}
    assert store.vacuum(keep=1) > 0 and held(store) == want | {"d": ("5", 3, 3)}
    store.rebucket(7)
    assert held(store) == want | {"d": ("5", 3, 3)} and store.manifest()["buckets"] == 7


def test_two_writers_of_one_version(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ("source", "content_hash"), buckets=2)
    stores.upsert_invoices(store, invoices(spark, ("a", "1")), "2026-01-01 00:00:00")

    def other_first(stored, new):
        stores.upsert_invoices(store, invoices(spark, ("a", "other")), "2026-01-02 00:00:00")
        return snapshots.upsert(stored, new, "2026-01-03 00:00:00")

    with pytest.raises(Conflict):
        store.merge(invoices(spark, ("a", "2")), other_first)
    assert held(store)["a"][0] == "other"


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    store = KeyedStore(spark, f"file://{tmp_path}/s", ("content_hash",), buckets=64)
    plain = lambda stored, new: stored.join(new.select("content_hash"), "content_hash", "left_anti").select(*new.columns).unionByName(new)
    rows = lambda a, z: spark.range(a, z).select(F.col("id").cast("string").alias("content_hash"), F.col("id").alias("v"))
    read = []

    def seen(stored, new):
        read.append(len(stored.inputFiles()))
        return plain(stored, new)

    for size in (300, 3000):
        store.merge(rows(0, size), plain)
        store.merge(rows(5, 15), seen)
    assert 0 < read[0] <= 10 and 0 < read[1] <= 10
    before = store.manifest()["live"]
    store.merge(rows(5, 6), seen)
    assert sum(before[b] != p for b, p in store.manifest()["live"].items()) == 1 and store.read().count() == 3000
    assert store.merge(rows(0, 9), plain, batch=("stream", 4)) == store.merge(rows(0, 9), plain, batch=("stream", 4))  # a batch run again


def test_ledger_and_overrides(spark, tmp_path):
    ledger = KeyedStore(spark, f"file://{tmp_path}/l", ("file_sha256",), buckets=3)
    plan = spark.createDataFrame([(x, True, 2026, k) for k, x in enumerate("pqr", 1)], "file_sha256 string, can_upload boolean, period_year int, period_month int")
    outcome = lambda *some: spark.createDataFrame(some, "file_sha256 string, outcome string")
    stores.put_outcomes(ledger, plan, outcome(("p", "unconfirmed"), ("q", "failed")))
    stores.put_outcomes(ledger, plan, outcome(("p", "uploaded"), ("r", "uploaded")))
    assert {r.file_sha256: r.state for r in ledger.read().collect()} == {"p": "uploaded", "r": "uploaded"}
    overrides = KeyedStore(spark, f"file://{tmp_path}/o", ("content_hash",), buckets=3)
    entry = lambda **f: {k: (v, "old") for k, v in f.items()}
    rows = lambda *some: spark.createDataFrame(some, "content_hash string, override map<string, struct<value string, baseline string>>")
    stores.save_overrides(overrides, rows(("h1", entry(a="1", b="2")), ("h2", entry(a="1"))))
    stores.save_overrides(overrides, rows(("h1", entry(b="3", c="4")), ("h2", {})))
    assert {r.content_hash: {k: v.value for k, v in r.override.items()} for r in overrides.read().collect()} == {"h1": {"a": "1", "b": "3", "c": "4"}}


def test_run_numbers_are_never_reused(spark, tmp_path):
    store = f"file://{tmp_path}/runs"
    run = lambda *rows: spark.createDataFrame(rows, "row_key string, row_hash string")
    numbers = [snapshots.append_run(run(("a", "1"), ("b", "1")), store, 2026), snapshots.append_run(run(("a", "2"), ("c", "1")), store, 2026), snapshots.append_run(run(("z", "1")), store, 2025)]
    failed = snapshots.claim_run(spark, store, 2026)  # its run never came
    numbers.append(snapshots.append_run(run(("a", "2")), store, 2026))
    assert numbers == [1, 2, 3, 5] and failed == 4
    got = {r.run_id: (r.year, r.previous_run_id, r.added, r.removed, r.changed) for r in snapshots.list_runs(spark, store).collect()}
    assert got == {1: (2026, None, None, None, None), 2: (2026, 1, 1, 1, 1), 3: (2025, None, None, None, None), 5: (2026, 2, 0, 1, 0)}
    assert {r.row_key for r in snapshots.read_run(spark, store, 2026, 1).collect()} == {"a", "b"}
    claimed = []
    many = [threading.Thread(target=lambda: claimed.append(snapshots.claim_run(spark, store, 2026))) for _ in range(8)]
    [t.start() for t in many], [t.join() for t in many]
    assert sorted(claimed) == list(range(6, 14)) and len(names(spark, f"{store}/claims")) == 13


def test_a_file_is_created_by_one_of_many_writers(spark, tmp_path):
    """Hadoop's local file system looks first and then creates, so two of them could both be told that they did."""
    won = []

    def race(k):
        won.append([write_new(spark, f"file://{tmp_path}/new/{n:03}", str(k)) for n in range(60)])

    many = [threading.Thread(target=race, args=(k,)) for k in range(8)]
    [t.start() for t in many], [t.join() for t in many]
    assert [sum(w) for w in zip(*won, strict=True)] == [1] * 60
    assert not write_new(spark, f"file://{tmp_path}/new/000", "late") and read_text(spark, f"file://{tmp_path}/new/000") != "late"


def test_days_of_a_chain_keep_their_runs(spark, tmp_path, monkeypatch):
    from triweave.plans import chain

    day = iter(range(9))

    def one(feeds, year, today, files, sent, overrides):
        rows = spark.createDataFrame([("k", str(next(day)))], "row_key string, row_hash string")
        return {"rows": rows, "final": rows, "overrides": overrides, "plan": rows}

    monkeypatch.setattr(chain, "run_year", one)
    monkeypatch.setattr(chain.rows, "row_keys", lambda df: df.selectExpr("*", "'s' as status", "1 as mail", "2 as ksef", "3 as saldeo"))
    for _ in range(2):
        chain.run_years(spark, (2026,), lambda year: {}, f"file://{tmp_path}/runs", F.lit(dt.date(2026, 1, 1)), None, None, None)
    got = snapshots.list_runs(spark, f"file://{tmp_path}/runs").orderBy("run_id").collect()
    assert [(r.run_id, r.previous_run_id, r.changed) for r in got] == [(1, None, None), (2, 1, 0), (3, 2, 1), (4, 3, 0)]  # the second day begins behind the first
