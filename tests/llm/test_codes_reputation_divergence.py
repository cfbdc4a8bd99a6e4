"""Vector codes, host reputation and source divergence: brute force, defined results, larger vocabularies than one pack."""

import hashlib
import math
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from triweave.llm import codes, divergence, reputation
from triweave.llm.transducer import Transducer

CLASH = ("vec", "d", "x", "_l", "_s", "name", "_name", "n", "y", "m", "k", "block", "kind", "term", "ordinal", "item", "host", "bad", "id")


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def plain_codes(rows):
    """Full search in Python integers; rows: (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1])
    cut = [(d * p // 4, d * (p + 1) // 4) for p in range(4)]
    books = [[r[1][a:z] for r in kept[:256]] for a, z in cut]

    def near(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p, (a, z) in enumerate(cut):
            sums, count = [[0] * (z - a) for _ in books[p]], [0] * len(books[p])
            for _, v, _ in kept:
                _, k = near(v[a:z], books[p])
                count[k] += 1
                sums[k] = [s + x for s, x in zip(sums[k], v[a:z], strict=True)]
            books[p] = [[s // n for s in total] if n else old for total, n, old in zip(sums, count, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, label in kept:
        found = [near(v[a:z], books[p]) for p, (a, z) in enumerate(cut)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return sorted(((i, c, e, by_label[label], sha) for i, c, e, label in out), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n", [5, 300])
def test_codes_equal_a_full_search(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(k), [float(np.float32(x)) for x in rng.normal(0, 0.02, 12)], int(k) % 3) for k in rng.permutation(n)]
    rows += [(n + 1, rows[0][1], None), (n + 2, rows[0][1], None), (2, rows[1][1], 1), (2, rows[1][1], 1), (None, rows[1][1], 2)]  # copies, ties, repeated and null ids
    rows += [(n + 3, None, 1), (n + 4, [1.0] * 11 + [None], 1), (n + 5, [float("nan")] * 12, 1), (n + 6, [float("inf")] * 12, 1)]
    got = codes.report(clashing(spark.createDataFrame(rows, VECTORS)).repartition(5))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [], 1), (2, [0.5] * 6, 1), (3, [3e38, -3e38, 0.0, 0.0], 2), (4, [0.0] * 4, None)], VECTORS)
    got = {r.vec_id: r for r in codes.report(df).collect()}
    assert got[1].code == "00000000" and got[1].error == 0 and got[2].code == "00000000" and got[3].error == 0 and got[4].label_error == 0
    assert codes.report(df.where("false")).count() == 0
    books = codes.encode(df)[1]
    assert codes.decode("00000000", books[6]).tolist() == [0.5] * 6
    with pytest.raises(ValueError, match="lengths"):
        codes.report(spark.createDataFrame([(k, [0.0] * k, 1) for k in range(70)], VECTORS))


def test_equal_average_search_is_exact():
    rng = np.random.default_rng(0)
    for w, spread in ((1, 3), (4, 5), (16, 40), (3, 1 << 27)):
        book, x = rng.integers(-spread, spread + 1, (200, w)), rng.integers(-spread, spread + 1, (500, w))
        apart = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = codes.nearest(x, book)
        assert (best == apart.min(axis=1)).all() and (index == apart.argmin(axis=1)).all()


LABELS, PAGES = "doc_id long, quality int, toxic int", "page_id long, url string"


def test_rules_and_parts_of_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "example.org/es/": ("", "", None, "allow"),
        "http://EXAMPLE.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "http://a.example.org/en/17?x=/": ("a.example.org", "/en/17", "example.org/en/1", "block"),
        "http://a.example.org/en/2#/": ("a.example.org", "/en/2", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "http://a.org?q=/fr/": ("a.org", "", None, "allow"),
        "https://x.com/de/?a://b": ("x.com", "/de/", "com/de/", "block"),
        "https://x.com/DE/": ("x.com", "/DE/", None, "allow"),
        "a://b.com://c/fr/": ("b.com:", "//c/fr/", None, "allow"),
        "://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "x://ÄB.com/fr/é": ("Äb.com", "/fr/é", "com/fr/", "allow"),
        "http://" + "a." * 200_000 + "com/de/": ("a." * 200_000 + "com", "/de/", "com/de/", "block"),
    }
    pages = clashing(spark.createDataFrame(list(enumerate(cases)), PAGES))
    got = reputation.judge(pages, spark.createDataFrame([], LABELS)).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == dict(enumerate(cases.values()))


def test_reputation_shrinks_to_the_domain_and_blocks_by_the_bound(spark):
    """One bad domain among good ones: its hosts are blocked, also one with no label; a lone bad page elsewhere is not."""
    rng = random.Random(1)
    pages, labels = [], []

    def add(host, n, bad, labelled=True):
        for _ in range(n):
            k = len(pages)
            pages.append((k, f"http://{host}/en/{k}"))
            if labelled:
                labels.append((k, 0 if rng.random() < bad else 1, None))

    for k in range(30):
        for sub in "abc":
            add(f"{sub}.good{k}.net", 8, 0.05)
            add(f"{sub}.bad{k}.co.uk" if k < 12 else f"{sub}.fine{k}.co.uk", 8, 0.95 if k < 12 else 0.05)
    add("new.bad1.co.uk", 3, 1, labelled=False)
    add("new.good1.net", 3, 1, labelled=False)
    add("once.good2.net", 1, 1.0)
    labels += [(labels[0][0], 1, None), (None, 0, 1), (10**9, 0, 1), (5, None, None)]
    df = spark.createDataFrame(pages, PAGES)
    got = {r.host: r.verdict for r in reputation.judge(clashing(df), clashing(spark.createDataFrame(labels, LABELS))).collect()}
    assert all(v == ("block" if ".bad" in h else "allow") for h, v in got.items())
    assert len(reputation.judge(df.union(df), spark.createDataFrame(labels, LABELS)).collect()) == 2 * len(pages)
    assert reputation.judge(df.where("false"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "a.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", ""), "x.y.com.xy": ("y.com.xy", "com.xy")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    domain, suffix = reputation.levels(F.col("h"))
    assert {r.h: (r.d, r.s) for r in df.select("h", domain.alias("d"), suffix.alias("s")).collect()} == hosts


def test_transducer_gives_places_and_merges_equal_ends():
    rng = random.Random(0)
    terms = sorted({"".join(rng.choices("abß", k=rng.randint(1, 6))).encode() for _ in range(300)})
    t = Transducer.build(terms)
    asked = [*terms, b"zz", b"a" * 9, b"\xc3", b"ab" * 3]
    data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])
    place = {x: k for k, x in enumerate(terms)}
    assert t.ordinals(data, ends, np.full(len(asked), t.root)).tolist() == [place.get(x, -1) for x in asked]
    assert [t.term(k, t.root) for k in range(len(terms))] == terms
    assert len(Transducer.build(sorted(a + b for a in (b"ab", b"cd", b"ef") for b in (b"ing", b"ed", b""))).final) == 9  # minimal: the ends are shared
    assert Transducer.build([]).ordinals(data, ends, np.zeros(len(asked), np.int64)).max() == -1


def test_terms_are_the_pattern_of_the_contract():
    rng = random.Random(2)
    texts = ["", *["".join(rng.choices(string.printable + "äßÉ漢😀\x7f\x00", k=rng.randint(0, 60))) for _ in range(300)]]
    import pyarrow as pa

    terms, row = divergence.terms_of(pa.array(texts, pa.string()).slice(1))
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    expected = [(k, x.translate(lower)) for k, t in enumerate(texts[1:]) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    assert list(zip(row.tolist(), terms.to_pylist(), strict=True)) == expected


def plain_audit(rows):
    """rows: (text, lang, source)."""
    from collections import Counter

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    docs = [(lang or "", source or "", [x.translate(lower) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    seen = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= 3)
        count = {s: Counter(t for x, y, terms in docs if (x, y) == (lang, s) for t in terms if t in set(kept)) for s in {d[1] for d in docs if d[0] == lang}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        for s in count:
            pair = sorted((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in count if o != s)
            term = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t])[:200]
            out += [(lang, s, part, x, -v, k + 1) for part, some in (("pair", pair), ("term", term)) for k, (v, _, x) in enumerate(some)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in divergence.audit(df).collect())


@pytest.mark.parametrize(("shard", "pack", "block"), [(65_536, 48_000_000, 512), (7, 1, 4)])
def test_audit_equals_plain_python(spark, monkeypatch, shard, pack, block):
    """With one shard, and with many small shards, a pack each, and blocks of few terms."""
    for name, value in (("SHARD", shard), ("PACK", pack), ("BLOCK", block)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = ["".join(rng.choices("abéЖ", k=rng.randint(1, 3))) for _ in range(40)]
    n = 60 if pack > 1 else 30
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "dé"]), rng.choice(["s1", "S2", "ß"])) for _ in range(n)]
    rows += [(None, None, None), ("", "xx", "lone"), ("rare words here", "xx", "two"), ("Ab AB aB", "en", None), rows[0], rows[0], ("ab," * 20_000, "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert audited(clashing(df).repartition(4)) == plain_audit(rows)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_more_than_the_top_terms(spark):
    rows = [(" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(260)), "en", s) for s in ("a", "a", "a")] + [("waa zz", "en", "b")] * 3
    got = audited(spark.createDataFrame(rows, "text string, lang string, source string"))
    assert got == plain_audit(rows) and sum(r[1:3] == ("a", "term") for r in got) == 200


def test_shares_do_not_exceed_64_bits():
    n, total = np.array([1, 10**12, 5 * 10**14]), np.array([3, 7 * 10**12, 10**15 - 1])
    assert divergence.share(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
