import datetime as dt
import hashlib
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from triweave.operators import candidates, mailbox, matching, rows, snapshots, survivorship, windows
from triweave.operators.assignment import assign
from triweave.plans import uploads
from triweave.schema import COLUMNS, INVOICE, conform


def feed(spark, source, *recs):
    made = []
    for k, r in enumerate(recs):
        full = dict.fromkeys(COLUMNS) | {"source": source, "content_hash": f"{source}{k}", "warnings": []} | r
        made.append(tuple(full[c] for c in COLUMNS))
    return spark.createDataFrame(made, INVOICE)


def run(spark, mail=(), ksef=(), saldeo=(), threshold=70):
    f = {"mail": feed(spark, "mail", *mail), "ksef": feed(spark, "ksef", *ksef), "saldeo": feed(spark, "saldeo", *saldeo)}
    out = rows.reconcile(f, threshold)
    return sorted((tuple((r[s].content_hash if r[s] else None) for s in ("mail", "ksef", "saldeo")) for r in out.collect()), key=str), out


DAY = dt.date(2026, 1, 15)


def inv(number, gross=10000, tax="1111111111", **more):
    return {"invoice_number": number, "gross_amount_minor": gross, "seller_tax_id": tax, "issue_date": DAY, "currency": "PLN"} | more


def test_same_amount_every_month(spark):
    got, _ = run(spark, mail=[inv("11/2026")], ksef=[inv("11/2026", ksef_reference="A"), inv("1/2026", ksef_reference="B")], saldeo=[inv("1/2026")])
    assert got == sorted([("mail0", "ksef0", None), (None, "ksef1", "saldeo0")], key=str)


def test_reference_conflict_gives_three_rows(spark):
    got, _ = run(spark, mail=[inv("1", ksef_reference="a")], ksef=[inv("1", ksef_reference="b")], saldeo=[inv("1", ksef_reference="c")])
    assert len(got) == 3


def test_identity_needs_amount_without_ids(spark):
    near, _ = run(spark, mail=[inv("FV/77", tax=None)], ksef=[inv("FV/77", gross=10002)])
    far, _ = run(spark, mail=[inv("FV/77", tax=None)], ksef=[inv("FV/77", gross=10003)], threshold=100)
    assert len(near) == 1 and len(far) == 2


def test_duplicates_inside_a_feed_and_summary(spark):
    got, out = run(spark, saldeo=[inv("5/2026"), inv("5/2026", issue_date=dt.date(2026, 2, 1))])
    assert len(got) == 1
    s = rows.summary(out).first()
    assert s.saldeo_count == 1 and s.saldeo_only == 1


def test_empty_feeds(spark):
    got, out = run(spark)
    assert got == [] and rows.summary(out).first().in_all_three == 0


def test_row_keys_are_unique_and_do_not_depend_on_order(spark):
    _, out = run(spark, mail=[inv("9", tax="1111111111"), inv("9", tax="2222222222"), inv(None, tax=None)])
    keys = [r.row_key for r in rows.row_keys(out).collect()]
    assert len(set(keys)) == len(keys)


def greedy(members, links):
    group = {(s, i): {s: i} for s, i, _ in members}
    ref = {(s, i): r for s, i, r in members}
    for p, sc, ls, l, rs, r in sorted(links, key=lambda e: (e[0], -e[1], e[2], e[3], e[4], e[5])):
        a, b = group[ls, l], group[rs, r]
        if a is b or set(a) & set(b) or len({ref[x] for g in (a, b) for x in g.items() if ref[x]}) > 1:
            continue
        a.update(b)
        for x in b.items():
            group[x] = a
    return sorted({tuple(g.get(s) for s in (0, 1, 2)) for g in group.values()}, key=str)


def test_rounds_equal_sequential_greedy(spark):
    rng = random.Random(5)
    members = [(s, f"{s}{i}", rng.choice([None, None, "A", "B"])) for s in range(3) for i in range(12)]
    links = {}
    for _ in range(150):
        s, t = sorted(rng.sample(range(3), 2))
        a, b = (rng.choice([m for m in members if m[0] == x])[1] for x in (s, t))
        links[a, b] = (rng.randint(0, 2), rng.choice([50, 60, 70]), s, a, t, b)
    m = spark.createDataFrame([(s + 1, i, r) for s, i, r in members], "slot int, id string, ref string")
    e = spark.createDataFrame([(p, sc, ls, l, l, rs, r, r) for p, sc, ls, l, rs, r in links.values()], "pass int, score int, lslot int, lid string, lrank string, rslot int, rid string, rrank string")
    got = sorted((tuple(r) for r in assign(m, e).collect()), key=str)
    assert got == greedy(members, links.values())


def small_rounds(monkeypatch, component=500_000):
    from triweave.operators import assignment

    monkeypatch.setattr(assignment, "COMPONENT", component)


def test_a_tied_block_ends_in_few_rounds(spark, monkeypatch):
    """Two hundred equal records a side: 40,000 tied links, the same rows as one by one."""
    from triweave.operators import assignment

    n = 200
    members = [(s, f"{s}{i:03}", None) for s in (0, 1) for i in range(n)]
    links = [(2, 70, 0, f"0{i:03}", 1, f"1{j:03}") for i in range(n) for j in range(n)]
    m = spark.createDataFrame([(s + 1, i, r) for s, i, r in members], "slot int, id string, ref string")
    e = spark.createDataFrame([(p, sc, ls, l, l, rs, r, r) for p, sc, ls, l, rs, r in links], "pass int, score int, lslot int, lid string, lrank string, rslot int, rid string, rrank string")
    looked = []
    real = assignment.feasible
    monkeypatch.setattr(assignment, "feasible", lambda *a: looked.append(1) or real(*a))
    assert sorted((tuple(r) for r in assign(m, e).collect()), key=str) == greedy(members, links)
    assert len(looked) <= 10


def test_large_components_go_on_in_rounds(spark, monkeypatch):
    small_rounds(monkeypatch, 20)
    test_rounds_equal_sequential_greedy(spark)


def test_components(spark):
    from triweave.operators.components import components
    from triweave.storage import Cuts

    path = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), ("hub", "a"), ("hub", "b"), ("b", "c")]
    got = {r.node: r.root for r in components(spark.createDataFrame(path, "a string, b string"), Cuts(spark)).collect()}
    assert got == {f"n{k:03}": "n000" for k in range(61)} | {"x": "x", "y": "x"} | dict.fromkeys(("hub", "a", "b", "c"), "a")


@pytest.mark.parametrize("threshold", [50, 55, 70])
def test_blocks_lose_no_pair(spark, sf, threshold):
    """Blocked pairs are those of all pairs; half of the records share numbers, amounts, days and ids with others."""
    from triweave.sources.feeds import derived_feeds

    rng = random.Random(threshold)
    made = {s: [inv(rng.choice(["7", "2026", "FV/1/2026", "FV/1/2026/A", "11112222", "11112222/A", None]), rng.choice([100, 101, 103, 500, 0]), rng.choice(["1111111111", "2222222222", None]), issue_date=DAY + dt.timedelta(rng.randint(0, 20)), currency=rng.choice(["PLN", "EUR", None])) for _ in range(60)] for s in ("mail", "ksef")}
    f = {s: matching.prepare(x.where("truth_key % 97 < 2").select(*COLUMNS).unionByName(feed(spark, s, *made.get(s, [])))) for s, x in derived_feeds(spark, sf).items()}
    a, b = f["mail"].alias("a"), f["ksef"].alias("b")
    every = a.crossJoin(b).where(F.coalesce(F.col("a.ref") == F.col("b.ref"), F.lit(True)) & ((matching.score("a", "b")[0] >= threshold) | matching.identity("a", "b")))
    want = {tuple(r) for r in every.select("a.id", "b.id").collect()}
    got = [(r.lid, r.rid) for r in matching.candidates(f, threshold).where("lslot = 0 and rslot = 1").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_an_amount_over_and_over_is_dealt_to_tiles(spark, monkeypatch):
    """One supplier, 2,000 equal amounts a side: pairs as by brute force, over many tasks."""
    monkeypatch.setattr(matching, "TILE", 100)
    of = lambda side: spark.range(2000).select(F.concat(F.lit(side), "id").alias("id"), F.array(F.lit("1111111111")).alias("ids"), F.lit(500).cast("long").alias("gross"), F.date_add(F.lit(DAY), (F.col("id") % 40).cast("int")).alias("day"), F.lit("1111111111").alias("seller"), F.lit("PLN").alias("cur_text"))
    x, y = (of(s).withColumn("one", F.explode("ids")) for s in "ab")
    near = lambda d: d.withColumn("g", F.explode(F.sequence(F.col("gross") - 2, F.col("gross") + 2)))
    exact = lambda d: d.withColumn("g", F.col("gross"))
    for threshold, share in ((60, 40), (52, None), (50, 1)):
        pairs = [j.select("a.id", "b.id", F.spark_partition_id().alias("p")) for j in matching.unnumbered(x, near(x), exact(y), y, threshold)]
        days = [k % 40 for k in range(2000)]
        want = sum(days.count(d) for a in days for d in set(days) if abs(a - d) < 8) if share is None else 2000 * 2000 // share
        assert pairs[-1].count() == want and pairs[-1].distinct().count() == want
    many = {r.p for r in pairs[-1].select("p").distinct().collect()}
    assert len(many) > 1


def test_overrides_apply_only_at_their_baseline(spark):
    ledger = feed(spark, "saldeo", inv("old"), inv("moved"), inv("same"))
    entry = lambda v, b: {"invoice_number": (v, b)}
    o = spark.createDataFrame([("saldeo0", entry("new", "old")), ("saldeo1", entry("new", "old")), ("saldeo2", entry("same", "same"))], "content_hash string, override map<string, struct<value string, baseline string>>")
    once = survivorship.apply_overrides(ledger, o)
    twice = survivorship.apply_overrides(once, o)
    assert [r.invoice_number for r in once.orderBy("content_hash").collect()] == ["new", "moved", "same"]
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_repair_fills_gaps(spark):
    _, out = run(spark, ksef=[inv("FV/5/2026", ksef_reference="R", seller_name="Acme")], saldeo=[inv("scan_5.pdf", ksef_reference="r", seller_name="klient")])
    r = survivorship.repair_items(out).first()
    assert r.invoice_number == "FV/5/2026" and r.changed_fields == ["invoice_number", "seller_name"]


def test_approve_cap_blocks_all(spark):
    df = spark.createDataFrame([(k, k % 2 == 0, True) for k in range(10)], "document_id long, has_mail boolean, pending boolean")
    assert {r.decision for r in uploads.approve_plan(df, cap=5).collect()} == {"blocked"}
    assert {r.decision for r in uploads.approve_plan(df, cap=0, require_mail=True).collect()} == {"pending", "skipped"}


def test_snapshot_store_and_diff(spark, tmp_path):
    a = spark.createDataFrame([("x", "1"), ("y", "1")], "row_key string, row_hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "1")], "row_key string, row_hash string")
    assert tuple(snapshots.diff(a, b).first()) == (1, 1, 1)
    snapshots.store_run(a, f"file://{tmp_path}", 2026, 1)
    assert snapshots.read_run(spark, f"file://{tmp_path}", 2026, 1).count() == 2


def test_report_hash_sees_every_change_and_no_order(spark):
    base = [(f"k{k}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(4000)]
    changed = [*base[:-1], ("k3999", base[-1][1][:2] + "0" * 62)]
    swapped = [(base[1][0], base[0][1]), (base[0][0], base[1][1]), *base[2:]]
    runs = (base, base[::-1], changed, swapped, base + base[:1], base[:-1], [])
    got = [spark.createDataFrame(r, "row_key string, row_hash string").agg(snapshots.report_hash(F.col("row_key"), F.col("row_hash")).alias("h")).first().h for r in runs]
    assert got[0] == got[1] and len(set(got)) == 6


def test_rate_audit_waits(spark):
    e = spark.createDataFrame([(1, dt.datetime(2026, 1, 1, 0, 0, 0, k * 1000)) for k in range(9)], "u int, ts timestamp")
    got = [r.wait_ms for r in windows.rate_audit(e, "u", "ts", ((1000, 8),)).orderBy("ts_ms").collect()]
    assert got == [0] * 7 + [993, 993]


def test_attachments_children_first(spark):
    tree = '{"mimeType":"m","filename":"top.pdf","body":{"data":"d"},"parts":[{"mimeType":"text/plain","filename":"","body":{"data":"t"}},{"filename":"a.XML","body":{}},{"filename":"b.exe","body":{"data":"x"}}]}'
    df = spark.createDataFrame([("m1", tree), ("m2", None)], "id string, payload string")
    got = [(r.ordinal, r.filename) for r in mailbox.explode_attachments(df).orderBy("ordinal").collect()]
    assert got == [(0, "m1_body_0.txt"), (2, "top.pdf")]
    deep = '{"filename":"leaf.pdf","body":{"attachmentId":"a1"}}'
    for k in range(9):
        deep = '{"filename":"n%d.txt","body":{},"parts":[%s]}' % (k, deep)
    got = mailbox.explode_attachments(spark.createDataFrame([("m", deep)], "id string, payload string")).collect()
    assert [(r.ordinal, r.filename, r.attachment_id) for r in got] == [(0, "leaf.pdf", "a1")]


def test_attachments_of_deep_trees_in_one_job(spark):
    deep = '{"filename":"leaf.pdf","body":{"attachmentId":"a1"}}'
    for k in range(200):
        deep = '{"filename":"n%d.txt","body":{"data":"d"},"parts":[%s,7,null]}' % (k, deep)
    odd = [("x", "no json"), ("y", "[1]"), ("z", ""), ("n", '{"filename":3.5,"mimeType":"text/plain","body":[],"parts":{}}'), ("w", '{"filename":"  ","mimeType":"text/plain","body":{"data":{"a":[1,"é"]}}}'), (None, '{"filename":"a.pdf","body":{"data":"d"}}')]
    df = spark.createDataFrame([("m", deep), *odd], "id string, payload string")
    out = mailbox.explode_attachments(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in out.collect()]
    assert [g[1:3] for g in got if g[0] == "m"] == [(0, "leaf.pdf"), *((k + 1, f"n{k}.txt") for k in range(200))]
    assert [g for g in got if g[0] != "m"] == [("w", 0, "w_body_0.txt", '{"a":[1,"é"]}', None), (None, 0, "a.pdf", "d", None)]
    assert mailbox.explode_attachments(df.where("false")).count() == 0


def test_cached_record_must_agree_in_every_field(spark):
    full = inv("FV/1", due_date=dt.date(2026, 1, 9), net_amount_minor=8000, seller_name="Abc Ltd", warnings=["parser:v2"])
    others = ({"seller_tax_id": "2222222222"}, {"due_date": dt.date(2026, 1, 8)}, {"net_amount_minor": 7000}, {"seller_name": "Xyz Ltd"}, {"seller_name": None}, {}, {"warnings": []}, {"warnings": ["parser:v2", "OCR failed"]})
    fresh, cached = feed(spark, "mail", *[full for _ in others]), feed(spark, "mail", *[full | o for o in others])
    assert [r.content_hash for r in candidates.reuse_cached(fresh, cached).where("reusable").collect()] == ["mail5"]
    assert candidates.reuse_cached(fresh, cached.where("false")).where("reusable").count() == 0


def test_unknown_source_is_an_error(spark):
    import pytest

    with pytest.raises(Exception, match="unknown source"):
        conform(spark.createDataFrame([("x", "h")], "source string, content_hash string")).collect()


def test_sync_is_incremental(spark, tmp_path):
    from triweave.streaming.sync import read_store, sync_documents

    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("Faktura nr FV/1/2026\nDo zapłaty: 12,50 PLN")
    args = (spark, f"file://{docs}", f"file://{tmp_path}/store", f"file://{tmp_path}/ck")
    sync_documents(*args)
    (docs / "b.txt").write_text("Faktura nr FV/1/2026\nDo zapłaty: 12,50 PLN")
    (docs / "c.txt").write_text("Invoice no INV-7\nTotal: 3.00 EUR")
    sync_documents(*args)
    got = read_store(spark, f"file://{tmp_path}/store").collect()
    assert sorted((r.invoice_number, r.gross_amount_minor) for r in got) == [("FV/1/2026", 1250), ("INV-7", 300)]


def shuffle_files(spark):
    return {p.name for p in Path(spark.conf.get("spark.local.dir")).rglob("shuffle_*.data")}


def test_cuts_free_their_shuffle_files(spark):
    """A job of many cuts held the shuffle files of all of them until it ended."""
    from triweave.storage import SHUFFLE_CLEANUP, cut

    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    made = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    after = shuffle_files(spark)
    assert made.count() == 7 and not after - before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_reconcile_deletes_what_only_its_steps_read(spark):
    """Deduplicated and prepared feeds stood on the disk after the rows."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("cut-*"))
    got, _ = run(spark, mail=[inv("1/2026"), inv("2/2026")], ksef=[inv("1/2026")], saldeo=[inv("2/2026")])
    left = [spark.read.parquet(f"file://{p}").columns for p in set(shared.glob("cut-*")) - before]
    assert len(got) == 2 and not [c for c in left if "tokens" in c or "content_hash" in c]


def test_records_are_shuffled_in_passes(spark, monkeypatch):
    """Whole records, and keys that pairs are found by, stood on the disks in the shuffle files of one job; rows are the same."""
    from triweave.storage import Cuts

    largest = {}
    real = Cuts.cut_all

    def cut_all(self, parts):
        sizes = []

        def counted():
            for df in parts:
                sizes.append(df.count())
                yield df

        out = real(self, counted())
        largest.setdefault(frozenset(out.columns), []).append(sizes)
        return out

    monkeypatch.setattr(Cuts, "cut_all", cut_all)
    numbers = [f"FV/{k}/2026" for k in range(80)]
    got, _ = run(spark, mail=[inv(n) for n in numbers], ksef=[inv(n) for n in numbers], saldeo=[inv(n) for n in numbers])
    assert len(got) == 80
    rows_ = largest[frozenset(("_row", "mail", "ksef", "saldeo", "_key"))]
    assert sum(rows_[0]) == 80 and len(rows_[0]) >= 4 and max(rows_[0]) < 40
    assert all(len(sizes) >= 3 for sizes in largest[frozenset(("left", "right"))])


def test_groups_links_and_upload_items_are_shuffled_in_passes(spark, monkeypatch):
    """Groups and links were renamed in one job with the shuffle files of all joins, and upload items shuffled as whole records with their files."""
    from triweave.plans import uploads
    from triweave.storage import Cuts

    made = {}
    real = Cuts.cut_all

    def cut_all(self, parts):
        sizes = []

        def counted():
            for df in parts:
                sizes.append(df.count())
                yield df

        out = real(self, counted())
        made.setdefault(frozenset(out.columns), []).append(sizes)
        return out

    monkeypatch.setattr(Cuts, "cut_all", cut_all)
    numbers = [f"FV/{k}/2026" for k in range(80)]
    feeds = {"mail": feed(spark, "mail", *[inv(n, source_path=f"p{n}") for n in numbers]), "ksef": feed(spark, "ksef", *[inv(n) for n in numbers]), "saldeo": feed(spark, "saldeo")}
    files = spark.createDataFrame([(f"p{n}", f"sha{n}", "found") for n in numbers[:60]], "source_path string, file_sha256 string, own_id_check string")
    sent = spark.createDataFrame([(f"sha{n}", "uploaded", 2026, 1) for n in numbers[:20]], "file_sha256 string, state string, period_year int, period_month int")
    plan = uploads.upload_plan(rows.reconcile(feeds), files, sent, 2026, F.lit("2026-03-15").cast("date"))
    got = {r.upload_status: r.n for r in plan.groupBy("upload_status").agg(F.count("*").alias("n")).collect()}
    assert got["missing_local_file"] == 20 and got["already_uploaded"] == 20 and sum(got.values()) == 80
    groups, links = made[frozenset(("gid", "mail", "ksef", "saldeo", "ref"))], made[frozenset(("lg", "rg", "rank"))]
    for renamed in (groups[1], links[2], made[frozenset(("g", "b"))][0]):
        assert len(renamed) >= 4 and max(renamed) < 80
    items = [sizes for columns, some in made.items() if "contractor" in columns for sizes in some]
    assert len(items) == 2 and all(len(sizes) >= 4 and sum(sizes) == 80 and max(sizes) < 40 for sizes in items)


def test_duplicates_of_many_keys_merge_in_passes(spark):
    """Rows of a key merge whatever pass it falls in, and no other row goes."""
    numbers = [f"FV/{k}/2026" for k in range(30)]
    mail = [inv(n, gross_amount_minor=5000 + k) for k, n in enumerate(numbers)]
    again = [inv(n, gross_amount_minor=5000 + k, content_hash=f"again{k}", currency="EUR") for k, n in enumerate(numbers) if k % 3 == 0]
    _, out = run(spark, mail=mail + again)
    assert out.count() == 30 and out.select("mail.invoice_number").distinct().count() == 30


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    """A file of many splits with one row group was read, and all that follows done, by one task."""
    from triweave.storage import spread

    spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    spark.conf.set("spark.sql.files.openCostInBytes", "65536")
    try:
        df = spark.read.parquet(f"file://{tmp_path}/one")
        assert df.rdd.getNumPartitions() >= 4 and len(df.groupBy(F.spark_partition_id()).count().collect()) == 1
        assert len(spread(df, "id").groupBy(F.spark_partition_id()).count().collect()) >= 4
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dedupe_deals_keys_to_several_parts_a_core(spark):
    """A task sorted as much as the shuffle partitions left it; ties go by content."""
    recs = [inv("5/2026", seller_name="b", content_hash="x2"), inv("5/2026", seller_name="a", content_hash="x3"), inv("5/2026", content_hash="x1"), inv("6/2026", content_hash="y")]
    out = matching.dedupe(feed(spark, "mail", *recs).where("invoice_number is not null"))
    assert sorted(r.content_hash for r in out.collect()) == ["x2", "y"]
    assert f", {4 * spark.sparkContext.defaultParallelism}" in out._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].splitlines()[0]


def test_best_links_need_no_join(spark):
    """A link is made if it is the best of both its groups; links are dealt once, and met by their rank (F3-F11: disk)."""
    from triweave.operators.assignment import best_of_both

    links = spark.createDataFrame([(1, 2, 5), (1, 3, 4), (3, 4, 6), (5, 6, 7), (6, 7, 8), (8, 5, 9)], "lg long, rg long, rank long")
    made = best_of_both(links)
    assert sorted(map(tuple, made.collect())) == [(3, 1), (6, 5)]
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_a_cut_are_deleted_one_by_one(spark):
    from triweave.storage import Cuts

    work = Cuts(spark)
    parts = work.cut_by(spark.createDataFrame([(1, 0), (2, 2), (3, 2)], "x long, p int"), "p", 3)
    paths = [path for _, path in work._made]
    work.drop(parts[2])
    assert [p.columns for p in parts] == [["x"]] * 3 and [r.x for r in parts[0].collect()] == [1] and parts[1].isEmpty()
    assert [os.path.exists(path.removeprefix("file://")) for path in paths] == [True, True, False]


def test_records_of_other_keys_are_not_dealt_to_be_deduplicated(spark):
    """Whole records were dealt and sorted by key, with or without a duplicate (F1-F10: time); the same ones are kept."""
    from triweave.storage import Cuts

    recs = [inv("5/2026", seller_name="b", content_hash="x2"), inv("5/2026", seller_name="a", content_hash="x3"), inv("6/2026", content_hash="y"), inv(None, None, None, content_hash="z", issue_date=None), inv(None, None, None, content_hash="z", issue_date=None)]
    for some in (recs, recs[1:3]):
        given = feed(spark, "mail", *some)
        out, cut_of = matching.deduped(given, Cuts(spark))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.content_hash for r in out.collect()) == sorted(r.content_hash for r in matching.dedupe(given).collect())
        assert out.columns == given.columns and "Repartition" not in plan and "Join" not in plan and cut_of is not None


def test_right_records_are_dealt_once_in_all_passes(spark):
    """Each pass of scores dealt all records of the right feed (F1-F10: time)."""
    from triweave.storage import Cuts

    made = {s: matching.prepare(feed(spark, s, *[inv(f"FV/{k}/2026") for k in range(80)])) for s in ("mail", "ksef")}
    made = {s: x.withColumn("id", F.concat_ws("/", "tokens")).withColumn("rank", F.col("id")) for s, x in made.items()}
    pairs = made["mail"].select(F.col("id").alias("left"), F.col("id").alias("right"))
    work = Cuts(spark)
    met = work.cut_by((matching.with_left(pairs, made["mail"], n) for n in range(matching.SCORE_PASSES)), "_pass", matching.SCORE_PASSES)
    rights = [{r.right for r in m.collect()} for m in met]
    assert sum(map(len, rights)) == len(set().union(*rights)) == 80 and all(len(r) < 40 for r in rights)
    scored = [df.count() for df in matching.scored(met, made["ksef"], (0, 1), 70, "5242920020", work)]
    assert scored == [len(r) for r in rights]


def test_a_short_run_is_met_by_ids_only(spark):
    """A partial number without a shared id gets 60 at most, and was met by its amount too (F1-F10: time)."""
    d = matching.prepare(feed(spark, "mail", inv("7/12345678")))
    tokens = d.first()
    n_ids, n_amounts = len(tokens.ids), 1
    # 7 is short; 12345678 and 7/12345678 are not
    assert n_ids == 1 and matching.join_keys(d, True, 1).count() == 3 * n_ids + 2 * n_amounts


def test_the_last_part_of_a_cut_takes_its_folder_along(spark):
    """An empty folder stood where the parts of placed records were, which no reader can open."""
    from triweave.storage import Cuts

    work = Cuts(spark)
    parts = work.cut_by(spark.createDataFrame([(1, 0), (2, 1)], "x long, p int"), "p", 2)
    folder = os.path.dirname(work._made[0][1].removeprefix("file://"))
    work.drop(parts[0])
    assert os.path.exists(folder)
    work.drop(parts[1])
    assert not os.path.exists(folder)
