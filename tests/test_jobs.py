import datetime as dt

import pytest
from pyspark.sql import functions as F

from test_reconcile import feed, inv
from triweave.functions import records
from triweave.operators import candidates, ledger, mailbox, rows, snapshots, survivorship, year_table
from triweave.plans import chain, uploads
from triweave.schema import COLUMNS
from triweave.sources import feeds, sinks
from triweave.streaming import sync



def today():
    return F.lit("2026-02-10").cast("date")


def test_clusters_follow_the_number_and_never_mix_counterparties(spark):
    recs = [inv("FV/1", 100, "1111111111"), inv("FV-1", 100, "2222222222"), inv("fv 1", 999, "1111111111", seller_name="A"), inv("FV/1", 100, None), inv(None, 5), inv(None, 5), inv(None, 6)]
    got = sorted(r.content_hash for r in candidates.cluster_candidates(feed(spark, "mail", *recs)).collect())
    assert "mail1" in got and ("mail2" in got) != ("mail0" in got) and sum(h in got for h in ("mail4", "mail5")) == 1 and "mail6" in got and len(got) == 4
    assert candidates.cluster_candidates(feed(spark, "mail")).count() == 0


def test_merged_feeds_keep_main_among_equals(spark):
    main = feed(spark, "mail", inv("FV/1"), inv("FV/1", 999))
    extra = feed(spark, "mail", *[inv("FV/1"), inv("FV/1", seller_name="A"), inv("FV/2")]).withColumn("content_hash", F.concat(F.lit("x"), "content_hash"))
    got = sorted(r.content_hash for r in candidates.merge_candidates(main, extra).collect())
    assert got == ["mail1", "xmail1", "xmail2"] or got == ["mail0", "xmail1", "xmail2"]


def test_reread_replaces_old_versions_and_fills_after_failures(spark):
    old = [inv("FV/1", source_path="a", warnings=["parser:v1"]), inv("FV/1", source_path="b", warnings=["parser:v2"]), inv(None, source_path="c", warnings=["OCR failed", "parser:v2"]), inv("FV/1", source_path="d", warnings=["parser:v1"]), inv("FV/1", 500, net_amount_minor=400, vat_amount_minor=100, source_path="e", warnings=["parser:v1"])]
    new = [inv("FV/9", 7, source_path="a"), inv("FV/9", source_path="b"), inv("g-1", 7, source_path="c", warnings=[records.FILENAME_NUMBER]), inv("FV/9", source_path="d", warnings=["PDF text failed: x"]), inv("FV/9", 900, net_amount_minor=400, vat_amount_minor=100, source_path="e")]
    got = {r.source_path: r for r in candidates.reread(feed(spark, "mail", *old), feed(spark, "mail", *new), "v2").collect()}
    assert (got["a"].invoice_number, got["a"].gross_amount_minor, got["a"].warnings) == ("FV/9", 7, ["parser:v2"])
    assert got["b"].invoice_number == got["d"].invoice_number == "FV/1" and got["d"].warnings == ["parser:v1"]
    assert (got["c"].invoice_number, got["c"].gross_amount_minor) == ("g-1", 10000) and records.FILENAME_NUMBER in got["c"].warnings
    assert (got["e"].invoice_number, got["e"].gross_amount_minor) == ("FV/9", 500)  # inconsistent amounts replace nothing


def test_attempts_ledger_and_requests(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"content_hash":"h","model":"m","version":"v","outcome":"transient","attempted_at":"2026-01-01T00:00:00Z"}\nbroken\n{"content_hash":"h","model":"m","version":"v","outcome":"rejected","attempted_at":"2026-01-02T00:00:00Z"}\n')
    tried = mailbox.read_attempts(spark, f"file://{tmp_path}/a.jsonl")
    assert [r.outcome for r in tried.collect()] == ["rejected"]
    queue = spark.createDataFrame([("h",), ("i",)], "content_hash string")
    assert [mailbox.skip_attempted(queue, tried, "m", "v", r).count() for r in ("automatic", "explicit", "forced")] == [1, 2, 2]


def test_company_candidates_and_year(spark):
    recs = [inv("1", tax="5242920020"), inv("2"), inv("3", seller_name="Own Company Ltd"), inv("4", tax="5242920020", source_path="x/Terms.pdf"), inv("5", tax="5242920020", warnings=["PDF with a password"]), inv("6", warnings=["PDF text failed: x"])]
    m = feed(spark, "mail", *recs)
    assert mailbox.company_candidates(m, "own company").count() == 2 and mailbox.company_candidates(m, "own company", keep_unread=True).count() == 3
    kept, dropped = mailbox.candidate_year(feed(spark, "mail", inv("1"), inv("2", issue_date=None), inv("3", issue_date=dt.date(2025, 1, 1))), 2026)
    assert kept.count() == 2 and dropped.first().dropped == 1


def test_ledger_input_pages_and_enrichment(spark, tmp_path):
    (tmp_path / "raw.json").write_text('[{"documentId":"7","number":"FV/7","grossPrice":{"value":12.5,"currency":"EUR"},"issueDate":"2026-01-02T00:00:00"},{"documentId":null}]')
    (tmp_path / "bad.json").write_text('[{"zzz":1}]')
    (r,) = ledger.read_ledger(spark, f"file://{tmp_path}/raw.json").collect()
    assert (r.content_hash, r.gross_amount_minor, r.currency, r.issue_date) == ("saldeo:7", 1250, "EUR", dt.date(2026, 1, 2))
    with pytest.raises(ValueError, match="neither"):
        ledger.read_ledger(spark, f"file://{tmp_path}/bad.json")
    page = lambda t, n=1: (2026, n, t)
    good = '{"status":"SUCCESS","data":{"resultCollection":[{"a":1},{"a":2}],"totalCount":2}}'
    check = lambda *p: ledger.check_pages(spark.createDataFrame(list(p), "year int, month int, json string")).count()
    assert check(page(good), page('{"data":{"resultCollection":[]}}', 2)) == 2
    for bad in ('{"status":"ERROR","data":{"resultCollection":[]}}', '{"data":{}}', '{"data":{"resultCollection":[{"a":1}],"pagination":{"totalCount":3}}}'):
        with pytest.raises(Exception, match="status ERROR|no result array|1 of 3"):
            check(page(bad))


def test_year_table(spark):
    mail, ksef = [inv("FV/1", source_path="p"), inv("FV/9", tax="9999999999", source_path="q")], [inv("FV/1", ksef_reference="R"), inv("FV/2", ksef_reference="S", tax="3333333333")]
    led = [inv("FV/2", ksef_reference="S", tax="3333333333", content_hash="saldeo:5"), inv("FV/8", tax="8888888888", issue_date=dt.date(2020, 1, 1))]
    r = rows.reconcile({"mail": feed(spark, "mail", *mail), "ksef": feed(spark, "ksef", *ksef), "saldeo": feed(spark, "saldeo", *led)})
    status = spark.createDataFrame([(5, None)], "document_id long, accounting boolean")
    files = spark.createDataFrame([("p",)], "source_path string")
    t = year_table.year_table(r, 2026, today(), status, status, files)
    got = sorted((x.sources, x.label, x.can_upload, x.document_id) for x in t.collect())
    assert got == [("-/K/S", "unmarked", False, 5), ("G/-/-", "—", False, None), ("G/K/-", "—", True, None)]
    again = year_table.mark_updated(t, t)
    assert again.where("updated").count() == 0 and year_table.mark_updated(t.where("false"), t).where("updated").count() == 3
    live = year_table.mark_updated(t, t, live=spark.createDataFrame([("mail0",)], "content_hash string"))
    assert live.where("updated").count() == 1
    chosen = again.withColumn("action", F.when(F.col("can_upload"), "upload").when(F.col("document_id").isNotNull(), "approve")).withColumn("selected", F.lit(True))
    split = year_table.action_split(chosen)
    assert [x.source_path for x in split["upload"].collect()] == ["p"] and [x.document_id for x in split["approve"].collect()] == [5] and split["reject"].count() == 0
    assert tuple(year_table.review_counts(chosen).first()) == (1, 1, 0, 3, 0)
    touched = year_table.apply_mail_update(r, feed(spark, "mail", inv("FV/1", 1, source_path="p")))
    assert touched.where("touched").count() == 1 and year_table.visible(t, True).count() == 3


def test_refresh_of_touched_rows_equals_a_full_rebuild(spark):
    mail = [inv(f"FV/{k}", tax=f"{k}" * 10, source_path=f"p{k // 2}") for k in range(1, 7)]
    now = feed(spark, "mail", *mail)
    r = rows.reconcile({"mail": now, "ksef": feed(spark, "ksef", inv("FV/2", ksef_reference="R", tax="2222222222")), "saldeo": feed(spark, "saldeo", inv("FV/3", tax="3333333333"))})
    status = spark.createDataFrame([(5, None)], "document_id long, accounting boolean")
    files = spark.createDataFrame([("p1", "s1", "found"), ("p2", "s2", "found"), ("p9", "s9", "found")], "source_path string, file_sha256 string, own_id_check string")
    sent = spark.createDataFrame([("s2", "uploaded", 2026, 1)], "file_sha256 string, state string, period_year int, period_month int")
    table, plan = year_table.year_table(r, 2026, today(), status, status, files), uploads.upload_plan(r, files, sent, 2026, today())
    new = {1: {"seller_name": "Renamed Ltd"}, 2: {"source_path": "p9"}, 4: {"issue_date": dt.date(2020, 1, 1), "sale_date": None}, 5: {}}
    changed = feed(spark, "mail", *[inv(f"FV/{k + 1}", tax=f"{k + 1}" * 10, source_path=f"p{(k + 1) // 2}", content_hash=f"mail{k}") | d for k, d in new.items()])
    after, got = year_table.refresh_rows(table, r, changed, 2026, today(), status, status, files)
    full = year_table.year_table(year_table.apply_mail_update(r, changed).drop("touched"), 2026, today(), status, status, files)
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(got) == rows_of(full) != rows_of(table) and after.count() == r.count() and got.count() < table.count()
    marked = table.withColumn("built", F.lit("before"))
    _, partly = year_table.refresh_rows(marked, r, changed, 2026, today(), status, status, files)
    assert partly.where("built is null").count() == 2  # two of three touched rows are still in the year; an equal record touches nothing
    again = uploads.refresh_plan(plan, r, changed, files, sent, 2026, today())
    assert rows_of(again) == rows_of(uploads.upload_plan(after, files, sent, 2026, today())) != rows_of(plan)
    assert rows_of(uploads.refresh_plan(plan, r, changed.where("false"), files, sent, 2026, today())) == rows_of(plan)


def test_overrides_and_stores(spark, tmp_path):
    before, after = feed(spark, "saldeo", inv("1"), inv("2")), feed(spark, "saldeo", inv("1", currency="EUR"), inv("2"))
    new = survivorship.override_from_edit(before, after)
    assert [(r.content_hash, r.override["currency"].baseline) for r in new.collect()] == [("saldeo0", "PLN")]
    assert survivorship.read_overrides(new.where("false"), after, before).count() == 1
    first = snapshots.upsert(before.select(*COLUMNS, F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")).where("false"), before, "2026-01-01 00:00:00")
    snapshots.write_invoices(first, f"file://{tmp_path}/s")
    snapshots.write_invoices(snapshots.upsert(snapshots.read_invoices(spark, f"file://{tmp_path}/s"), after.union(after), "2026-01-02 00:00:00"), f"file://{tmp_path}/s")
    got = sorted((r.content_hash, r.currency, r.created_at.day, r.updated_at.day) for r in snapshots.read_invoices(spark, f"file://{tmp_path}/s", "saldeo").collect())
    assert got == [("saldeo0", "EUR", 1, 2), ("saldeo1", "PLN", 1, 2)]
    feeds.write_records(before, f"file://{tmp_path}/r.jsonl")
    assert feeds.read_feed(spark, f"file://{tmp_path}/r.jsonl", "saldeo").count() == 2
    feeds.write_records(before.coalesce(1), f"file://{tmp_path}/array", array=True)


def test_caches_and_mail_window(spark):
    at = dt.datetime(2026, 1, 1, 12)
    caches = spark.createDataFrame([("a", 2026, "prod", "nip:1", at), ("b", 2026, "prod", "NIP:1", dt.datetime(2025, 12, 31)), ("c", 2025, "prod", "nip:1", at), ("d", 2026, "prod", "nip:1", None)], "feed string, year int, environment string, context string, written_at timestamp")
    got = {r.feed: r.state for r in feeds.fresh_caches(caches, 2026, "prod", "nip:1", F.lit("2026-01-01 13:00:00").cast("timestamp")).collect()}
    assert got == {"a": "hit", "b": "stale", "c": "refused", "d": "missing"}
    df = spark.createDataFrame([(dt.datetime(2025, 12, 1), "x@amazon.it"), (dt.datetime(2027, 2, 1), "x@amazon.it"), (at, "y@b.example")], "t timestamp, s string")
    assert df.where(feeds.mail_window(F.col("t"), 2026)).count() == 2 and df.where(feeds.mail_window(F.col("t"), 2026, F.col("s"))).count() == 1


def test_plan_report_has_its_columns(spark):
    r = rows.reconcile({"mail": feed(spark, "mail", inv("FV/1", source_path="p")), "ksef": feed(spark, "ksef"), "saldeo": feed(spark, "saldeo")})
    files = spark.createDataFrame([("p", "sha", "found")], "source_path string, file_sha256 string, own_id_check string")
    sent = spark.createDataFrame([], "file_sha256 string, state string, period_year int, period_month int")
    plan = uploads.upload_plan(r, files, sent, 2026, today())
    (row,) = sinks.plan_report(plan).collect()
    assert tuple(row.asDict()) == sinks.PLAN_COLUMNS and (row.period, row.related_sources, row.gross_amount) == ("2026-01", "mail", "100.00")


def test_year_runs_and_source_sync(spark, tmp_path):
    of = {"mail": feed(spark, "mail", inv("FV/1", source_path="p", seller_name="Own Company")), "ksef": feed(spark, "ksef", inv("FV/2", ksef_reference="R", seller_name="Alpha", tax="3333333333")), "saldeo": feed(spark, "saldeo", inv("scan.pdf", ksef_reference="R", tax="3333333333"))}
    none = spark.createDataFrame([], "content_hash string, override map<string, struct<value string, baseline string>>")
    files = spark.createDataFrame([("p", "sha", "found")], "source_path string, file_sha256 string, own_id_check string")
    sent = spark.createDataFrame([], "file_sha256 string, state string, period_year int, period_month int")
    plans = chain.run_years(spark, (2026,), lambda year: of, f"file://{tmp_path}/runs", today(), files, sent, none)
    assert [r.upload_status for r in plans[2026].collect()] == ["planned"]
    assert snapshots.list_runs(spark, f"file://{tmp_path}/runs", 5).count() == 2
    stored = of["mail"].select(*COLUMNS, F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at")).where("false")
    assert chain.sync_sources(of, stored, 2026, "2026-01-01 00:00:00", "own company").groupBy("source").count().count() == 3


def test_refresh_reads_old_versions_again(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("Faktura nr FV/1/2026\nRazem do zapłaty: 12,50 PLN")
    args = (spark, f"file://{docs}", f"file://{tmp_path}/store")
    sync.sync_documents(*args, f"file://{tmp_path}/ck")
    assert sync.refresh_documents(*args) == 0 and sync.refresh_documents(*args, version="v3") == 1
    (r,) = sync.read_store(spark, f"file://{tmp_path}/store").collect()
    assert r.gross_amount_minor == 1250 and "parser:v3" in r.warnings


def test_records_without_a_key_are_dealt(spark):
    """Ledger records without a reference all met in one task; of registry records with one reference the last by hash, then content, counts."""
    from triweave.operators import ledger

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        led = feed(spark, "saldeo", *[inv(None, ksef_reference="R" if k == 0 else None, content_hash=f"s{k}") for k in range(400)])
        reg = feed(spark, "ksef", inv("A", ksef_reference="R", content_hash="h1"), inv("C", ksef_reference="R", content_hash="h2"), inv("B", ksef_reference="R", content_hash="h2"))
        out = ledger.enrich_from_registry(led, reg)
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.where("content_hash = 's0'").first().invoice_number == "C" and sum(parts) == 400 and max(parts) < 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
