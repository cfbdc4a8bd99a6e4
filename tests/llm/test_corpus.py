import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from triweave.llm import ann, bpe, chat, decontam, graph, html, langid, minhash, pii, queries, token_io, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_minhash_equals_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(60)] for _ in range(6)]
    texts = [None, "", "  \n", "one", "one two", "ONE two"]
    for b in base:
        for k in range(5):
            words = list(b)
            for _ in range(k):
                words[rng.randrange(60)] = "new" + str(rng.random())
            texts.append(" ".join(words))
        texts.append(" ".join(b).upper())
    sets = [shingles(t, 3) for t in texts]
    link = {k: k for k in range(len(texts))}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            link[max(find(a), find(b))] = min(find(a), find(b))
    extra = docs(spark, *texts).withColumn("keys", F.lit(1)).withColumn("node", F.lit("x"))
    got = {r.doc_id: r for r in minhash.near_duplicates(extra, words=3, percent=85).collect()}
    assert {k: (r.n_shingles, r.component_id, r.kept) for k, r in got.items()} == {k: (len(s), find(k), find(k) == k) for k, s in enumerate(sets)}


def test_minhash_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [("7", 7, True), ("7", 7, True), ("8", 8, True), ("None", 7, False)]
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_bitmap_bound_never_loses(spark):
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    b = np.unique(np.concatenate([a[:250], rng.integers(0, 2**63, 60).astype(np.uint64)]))
    bits = minhash.bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))
    row = spark.createDataFrame([(len(a), bits[0].tolist(), len(b), bits[1].tolist())], "x_n long, x_bits array<long>, y_n long, y_bits array<long>")
    assert len(np.intersect1d(a, b)) <= row.select(minhash.most_shared("x", "y")).first()[0] < min(len(a), len(b))


def test_rare_pairs_lose_no_link_and_skip_copies_too_far_apart(spark):
    """Sets with a fifth of their own each share most of the rest, as 200 poor copies of one text do: none of their 19,900 pairs is made."""
    rng, sets = random.Random(5), []
    for size, kept in ((40, 40), (40, 39), (41, 38), (90, 85)):
        for _ in range(6):
            base = rng.sample(range(1000), size)
            sets += [set(base), *({*rng.sample(base, kept), *rng.sample(range(1000), size - kept)} for _ in range(4))]
    far = len(sets)
    sets += [{*range(5000, 5080), *range(10_000 + 20 * k, 10_020 + 20 * k)} for k in range(200)]
    rows = [(k, k if k % 7 else 0, [x * 2**40 - 2**49 for x in sorted(s)]) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, root long, shingles array<long>")
    for percent in (80, 85, 100):
        links = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if rows[a][1] != rows[b][1] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = [(r.x, r.y) for r in minhash.rare_pairs(nodes, percent).collect()]
        assert links <= set(got) and len(got) == len(set(got)) and (links or percent == 100)
        assert not [p for p in got if p[0] >= far and p[1] >= far]


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    alphabet = "aábcΣσÉé'sT 12½²<|>\n\t\x1c ßİ漢字🙂ﬁ.,-_"
    texts = ["", "   ", "a<|endoftext|>B <|startoftext|>", "aaaa aaaaaaa", "x" * 3000, "don't I'LL"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    lib, own = Tokenizer.from_file(public_tokenizers.path(name)), bpe.Codec(public_tokenizers.path(name))
    for ours, theirs in zip(own.encode(texts), lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.tolist() == theirs.ids
        assert own.decode(ours) == lib.decode(theirs.ids, skip_special_tokens=False)


def test_bpe_table(spark):
    df = docs(spark, None, "", "Hello there", "Hello there").withColumn("token_ids", F.lit("clash"))
    out = bpe.encode(df, public_tokenizers.path("word_bpe_49k.json"), decoded=True).orderBy("doc_id").collect()
    assert [len(r.token_ids) for r in out] == [0, 0, 2, 2] and out[2].decoded == "hello</w> there</w>"
    back = bpe.decode(spark.createDataFrame([(1, out[2].token_ids), (2, None)], "doc_id long, token_ids array<int>"), public_tokenizers.path("word_bpe_49k.json"))
    assert [r.text for r in back.orderBy("doc_id").collect()] == ["hello</w> there</w>", ""]


def test_html_structure_and_differencing(spark):
    page = "<body><nav>a<p>b</nav><article><h1>T &amp; x</h1><p>one <b>two</b>\n three<br>four<p>five<div class='comments'><p>bad</div><aside>z</aside></article><footer>f<script>var t='</p>'</script>"
    plain = "<body><p>Site name<p>{}<p>Contact us"
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", None), (3, "http://b.example/1", plain.format("red")), (4, "http://b.example/2", plain.format("blue")), (5, None, "")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & x\none two three\nfour\nfive", 2: "", 3: "red", 4: "blue", 5: ""}


def test_html_difference_decides_beside_articles_and_past_copies(spark):
    beside = "<body><p>Site name<h1>{0} headline</h1><article>{0} teaser</article><p>Contact us"
    plain = "<body><p>Site name<p>{}<p>Contact us"
    made = [("a", beside, "red"), ("a", beside, "blue"), ("b", plain, "red"), ("b", plain, "red"), ("b", plain, "blue"), ("b", plain, "blue"), ("c", plain, "red"), ("c", plain, "red")]
    rows = [(k, f"http://{host}.example/{k}", page.format(word)) for k, (host, page, word) in enumerate(made)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    alone = "Site name\nred\nContact us"
    assert got == {0: "red headline\nred teaser", 1: "blue headline\nblue teaser", 2: "red", 3: "red", 4: "blue", 5: "blue", 6: alone, 7: alone}


def test_html_names_do_not_drop_main_text():
    for element, name in (("main", "content with-sidebar"), ("article", "post has-comments"), ("article", "category-search"), ("article", "search"), ("main", "widget")):
        assert html.lines_of(f"<body><{element} class='{name}'><p>text</{element}>") == [("main", "text")]
    assert html.lines_of("<body><div class='no-sidebar'><p>text</div>") == [("open", "text")]
    assert html.lines_of("<div class='widget'><p>a</p><main><p>b</main>") == [("outside", "a"), ("main", "b")]
    page = "<article><div class='post-header'><h1>head</h1></div><div class='post-share'>x</div><div class='ad-banner'>y</div><div id=comments>z</div></article>"
    assert html.lines_of(page) == [("main", "head"), ("open", "x"), ("outside", "y"), ("outside", "z")]


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        got, rest = sorted(html.shared_lines(a, b)), iter(b)
        assert len(got) == table[-1][-1] and all(a[k] in rest for k in got)


def test_pii_base_equals_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice("0123456789@.+- ()aB\n_%") for _ in range(rng.randint(0, 40)))
        want = sorted((m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if pii.fits(k, m[0]))
        assert sorted(pii.base_spans(text)) == want


def test_pii_field_and_redaction(spark):
    texts = ["call 555-123-4567 now", "on 1998-01-02 in 1999, 12 items", "x 4111 1111 1111 1111 y", None, "", "9" * 5000]
    got = [r.text for r in pii.redact(docs(spark, *texts).withColumn("spans", F.lit(1))).orderBy("doc_id").collect()]
    assert got == ["call <PHONE> now", texts[1], "x <CARD> y", None, "", texts[5]]


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(5)
    field = pii.Field(rng.normal(size=(20, pii.N_LABELS)), rng.normal(size=(pii.N_LABELS, pii.N_LABELS)))
    runs = [[rng.integers(0, 20, 3).tolist() for _ in range(n)] for n in (1, 3, 2, 4)]
    for run, label in zip(runs, field.decode(runs), strict=True):
        scores = [field.unary[f].sum(axis=0) for f in run]
        total = lambda p: sum(s[x] for s, x in zip(scores, p, strict=True)) + sum(field.change[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert np.isclose(total(label), max(map(total, itertools.product(range(pii.N_LABELS), repeat=len(run)))))


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    vecs = np.concatenate([base, base + 0.02 * rng.normal(size=base.shape), base[:5]])
    rows = [(k, [float(x) for x in v], int(k % 30 % 2)) for k, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, rows[0][1], None)]
    unit = vecs.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    same = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows[:65]])[:, None] == np.array([r[2] for r in rows[:65]]))
    out = {r.vec_id: r for r in ann.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [out[k].n_links for k in range(65)] == (same.sum(axis=1) - 1).tolist()
    assert all(out[k].n_links == 0 and out[k].component_id == k for k in (900, 901, 902, 903))


def test_chat_round_trip_and_layouts(spark):
    rng = random.Random(7)
    for _ in range(5000):
        t = "".join(rng.choice(["<", "|", "\\", "[", "INST]", "/", "s>", "<SYS>>", "a", "|turn|>", "<|end|>", "<|text|>"]) for _ in range(rng.randint(0, 9)))
        formatted, spans = chat.render([{"role": t, "text": t}, {"role": "assistant", "text": t}])
        assert chat.parse(formatted) == [(t, t), ("assistant", t)] and [chat.unescape(formatted[a:b]) for a, b in spans][-1:] == [t]
    records = ['{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}', '{"response":"r","prompt":"p"}', '{"conversations":[{"from":"human","value":"x"}]}', '{"zzz":1}', "no json", None]
    got = chat.turns_of_records(spark.createDataFrame([(k, r) for k, r in enumerate(records)], "id int, record string"), keep=("id",)).orderBy("id").collect()
    assert [r.layout for r in got] == ["messages", "prompt_response", "from_value", None, None, None]
    assert [tuple(t) for t in got[0].turns] == [("user", "a"), ("assistant", "")]


def test_token_blocks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    for _ in range(100):
        parts = [rng.integers(0, rng.choice([1, 2, 300, 50257, 2**32 - 1]), rng.integers(0, 700)).astype(np.uint32) for _ in range(rng.integers(0, 6))]
        assert [x.tolist() for x in token_io.read_segment(token_io.write_segment(parts))] == [x.tolist() for x in parts]
    df = spark.createDataFrame([(None, None), (1, "b"), (1, "b"), (2, "")], "doc_id long, text string")
    token_io.write_tokens(df, f"file://{tmp_path}/t", public_tokenizers.path("byte_bpe_50k.json"), 2)
    out = token_io.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in out] == [(None, 0, 1), (1, 1, 2), (1, 3, 2), (2, 5, 1)]
    assert zlib.crc32(bytes(out[0].ids)) == zlib.crc32(np.array([2], "<u4").tobytes())


def test_decontamination_of_templates(spark):
    item = "Anna bought 12 apples for 3 dollars and Bob bought 12 pears, how much did they pay together today"
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None)], "item_id long, text string")
    other = "Carla bought 15 apples for 4 euros and Tom bought {} pears, how much did they pay together today?"
    got = decontam.matches(docs(spark, "Intro. " + other.format(15) + " End.", other.format(16), None, "", item, "x " * 50), bench)
    assert sorted((r.doc_id, r.item_id, r.n_changed > 0) for r in got.collect()) == [(0, 1, True), (4, 1, False)]
    assert decontam.decontaminate(docs(spark, item, "clean", None), bench).count() == 2
    assert decontam.matches(docs(spark, item), bench.where("false")).count() == 0


def test_language_of_held_out_documents(spark, sf):
    got = queries.op10_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.9
    odd = docs(spark, None, "", "123 ½", "the cat").union(docs(spark, "le chat").withColumn("lang", F.lit("fr")))
    assert [r.lang_pred for r in langid.identify(odd).orderBy("doc_id").collect()].count("und") == 3


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    assert np.mean([r.predicted for r in got if r.toxic]) >= 0.9 and np.mean([r.predicted for r in got if not r.toxic]) < 0.01
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out, _ = toxicity.score(docs(spark, None, "", "you stupid idiot", "kind words"), none)
    assert [r.score >= 0.5 for r in out.orderBy("doc_id").collect()] == [False, False, True, False]


def test_toxicity_learns_from_unlabelled_documents_and_doubts_annotators(spark):
    assert toxicity.shouts("a " * 2500 + "LOUD " * 5000, 7500) and not toxicity.shouts("LOUD " * 800 + "quiet words " * 2000, 4800)
    fires, count = np.array([[0.0] * 8, [1.0] * 7 + [0.0]]), np.array([[900.0, 0, 0], [1, 100, 80]])
    fit = lambda parts: toxicity.fitted(lambda m, old: sum(toxicity.moments(fires[x], count[x], m, old) for x in parts), (*"abcdefgh", "annotator"))
    model, accuracy = fit([slice(0, 2)])
    post = toxicity.beliefs(fires, count, model)[1]
    assert post[0] > 0.5 and post[1] > 0.9 and 0.9 < accuracy["annotator"] < 1  # one annotator against all other voters
    assert np.allclose(toxicity.beliefs(fires, count, fit([slice(0, 1), slice(1, 2)])[0])[1], post)  # sums of two tasks
    assert toxicity.cues_in({"abcd", "abce"}) >= {"abc*", "abc**"} and "abcd**" not in toxicity.cues_in({"abcdx", "abce"}) and set(toxicity.cues_with("abcd**")) == {"abcd", "abc*", "abcd*", "abc**", "abcd**"}
    texts = ["zugmob river", "calm river", "quiet lake"] * 60 + ["moron zugmob"] * 80 + ["a moron here", "a quiet here"]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(180)], "doc_id long, toxic int")
    out, model = toxicity.score(docs(spark, *texts), labels)
    got = [r.score for r in out.orderBy("doc_id").collect()]
    assert got[-2] > 0.5 > got[-1] and got[0] > 0.5 > got[1] and model.weight[model.cues["moron"]] > 4.0  # no labelled text has this word


def test_pipeline_equals_its_parts_in_plain_python(spark, sf):
    import corpus_pipeline

    source = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in source.collect()}
    clean = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, source, sf).collect()}
    sets = {k: shingles(texts[k], 5) for k in clean}
    near, link = defaultdict(list), {k: k for k in clean}
    for k, s in sets.items():
        for x in s:
            near[x].append(k)

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for k in clean:
        for o, n in Counter(o for x in sets[k] for o in near[x]).items():
            if o > k and 100 * n >= 80 * (len(sets[k]) + len(sets[o]) - n):
                link[max(find(k), find(o))] = min(find(k), find(o))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {k for k in clean if find(k) == k and not any(f" {i} " in f" {' '.join(words(texts[k]))} " for i in items)}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) <= want | set() and len(want - set(out)) <= 0.01 * len(want)
    field, codec = pii.trained(), bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    for k in list(out)[:40]:
        (base, more), = pii.find_all([texts[k]], field)
        assert out[k].token_ids == codec.encode([pii.masked(texts[k], base, more)])[0].tolist()


def test_op6_digest(spark, sf):
    said = "</s>[INST] ok [/INST]"
    row = queries.op6_chat(spark, sf).where("conv_id = -7").first()
    assert row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and row.n_turns == 2
