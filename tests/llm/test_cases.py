"""Defined results of each operator and pipeline stage: nulls, repeats, ties, long and empty texts, empty tables, clashing names."""

import random
import time

import corpus_pipeline
import numpy as np
import pytest
from pii_held_out import HELD_OUT
from pyspark.sql import functions as F

from triweave.llm import ann, bpe, chat, decontam, html, langid, minhash, pii, token_io, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("doc", "th", "t", "node", "key", "_text", "_doc", "_th", "cues", "patterns", "_dirty", "_gone", "keys", "spans", "page", "url_", "item", *sorted({p for m in chat.MAPPINGS for p in m.required + m.optional if "[" not in p and p not in ("conv_id", "turn", "role", "text")}))


def docs(spark, *texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def clashing(df):
    """The table with more columns, named as the operators name their own."""
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH if c not in df.columns])


def test_html_is_the_same_at_any_partitioning_and_uses_the_difference(spark):
    plain = "<body><p>Site {h}<p>{k} text<p>Contact {h}"
    rows = [(k, f"http://h{k % 60}.example/a/{k}", plain.format(h=k % 60, k=k)) for k in range(240)]
    rows += [(900, "http://h1.example/zz", None), (901, None, ""), (902, None, "<p>alone"), (rows[5]), (903, "http://h5.example/a/5", rows[5][2])]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    got = []
    for n in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got.append(sorted(html.extract(df).collect(), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got[0] == got[1] == got[2] and len(got[0]) == 245
    texts = {r.page_id: r.text for r in got[0]}
    assert all(texts[k] == f"{k} text" for k in range(240)) and texts[900] == texts[901] == "" and texts[902] == "alone" and texts[903] == "5 text"
    assert html.extract(df.where("false")).count() == 0


def test_html_difference_on_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("url like 'http://blog.%'")
    out = html.extract(pages).agg(F.sum("n_repeated"), F.sum("n_outside"), F.min(F.length("text"))).first()
    assert out[0] > 0 and out[1] > 0


def test_html_takes_the_nearer_neighbour(spark):
    page = "<body><p>{0}<p>own {1}<p>{0} end"
    rows = [(1, "http://a.example/x/1", page.format("left", 1)), (2, "http://a.example/y/1", page.format("right", 2)), (3, "http://a.example/y/2", page.format("right", 3))]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "left\nown 1\nleft end", 2: "own 2", 3: "own 3"}


def test_html_reads_broken_markup_in_linear_time():
    for text in ("<a " * 300_000, '<a ">' * 200_000, "<p>" * 200_000, "<div><p>" * 50_000 + "</div>" * 50_000, "<" * 500_000, "<svg>" * 100_000):
        began = time.time()
        html.lines_of(text)
        assert time.time() - began < 2
    assert html.lines_of("a < b <p title='x > y'>c</p><!-- d") == [("open", "a < b"), ("open", "c")]
    assert html.lines_of("<p>a<script>x<p>y") == [("open", "a")]


def test_longest_common_subsequence_of_large_inputs(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(html, "SMALL", 64)
    monkeypatch.setattr(html, "WORD", 16)
    for _ in range(200):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 60))] for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        got, rest = html.shared_lines(a, b), iter(b)
        assert len(got) == table[-1, -1] and got == sorted(set(got)) and all(a[k] in rest for k in got)


def test_pii_on_held_out_lines():
    right = wrong = missed = 0
    for line in HELD_OUT.strip().splitlines():
        text, gold = pii.labelled(line)
        ((base, more),) = pii.find_all([text], pii.trained())
        base, gold = {tuple(x) for x in base}, {tuple(x) for x in gold}
        right, wrong, missed = right + len({*more} & gold), wrong + len({*more} - gold), missed + len(gold - base - {*more})
    assert right >= 0.9 * (right + wrong) and right >= 0.85 * (right + missed) and right > 10


def test_pii_adds_spans_on_the_documents_table(spark):
    found = pii.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).select(F.explode("spans").alias("s")).where("not s.base")
    assert found.count() > 0


def test_pii_cases(spark):
    df = clashing(docs(spark, None, "", "a@b.cd 1.2.3.4", "a@b.cd 1.2.3.4", "x" * 300_000 + " 1.2.3.4", "1" * 100_000, ids=[1, 2, 3, 3, None, 5]).drop("spans"))
    got = sorted((str(r.doc_id), len(r.spans)) for r in pii.find(df).collect())
    assert got == [("1", 0), ("2", 0), ("3", 2), ("3", 2), ("5", 0), ("None", 1)]
    assert pii.find(df.where("false")).count() == 0 and pii.redact(df).columns == df.columns
    assert pii.word_features.cache_info().maxsize and max(len(pii.short("9" * n)[0]) for n in (1, 64, 65, 1000)) == 64


def test_embedding_recall_just_above_the_threshold_and_tiles(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    c = rng.uniform(0.9801, 0.983, size=300)[:, None]
    group = base[0] + 0.01 * rng.normal(size=(120, 64))  # one large group of near copies
    x = np.concatenate([base, base * c + away * np.sqrt(1 - c**2), rng.normal(size=(700, 64)), group])
    df = spark.createDataFrame([(k, [float(a) for a in v], 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.98).sum(axis=1) - 1
    got = {r.vec_id: r for r in ann.near_duplicates(df).collect()}
    found = sum(min(got[k].n_links, int(want[k])) for k in got)
    assert found >= 0.98 * want.sum() and all(got[k].n_links <= want[k] for k in got)
    monkeypatch.setattr(ann, "TILE", 16)  # the same with entries dealt to many tiles
    assert {r.vec_id: r for r in ann.near_duplicates(df).collect()} == got


def test_embedding_cases(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, None], 1), (3, [], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 0.0, 0.0], 1), (6, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0], 2)]
    df = clashing(spark.createDataFrame(rows, schema))
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in ann.near_duplicates(df).collect())
    assert got == [("1", 3, 1), ("1", 3, 1), ("2", 0, 2), ("3", 0, 3), ("4", 0, 4), ("5", 0, 5), ("6", 3, 1), ("7", 0, 7), ("None", 3, 1)]
    assert ann.near_duplicates(df.where("false")).count() == 0


def test_chat_passengers_optional_fields_and_ties(spark):
    records = [
        '{"id":1,"prompt":"a","response":"b"}',
        '{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","tool_call_id":7}]}',
        '{"messages":[]}',
        '{"messages":["x"]}',
        '{"instruction":"i","output":3,"input":""}',
        '{"system":"s","conversations":[{"from":"gpt","value":"v"}]}',
        "[]",
    ]
    df = clashing(spark.createDataFrame([(k, r) for k, r in enumerate(records)], "id int, record string"))
    got = chat.turns_of_records(df, keep=("id",)).orderBy("id").collect()
    assert [r.layout for r in got] == ["prompt_response", "messages", "messages", None, "instruction_output", "from_value", None]
    assert [[tuple(t) for t in r.turns or []] for r in got] == [[("user", "a"), ("assistant", "b")], [("user", "q"), ("assistant", "")], [], [], [("user", "i"), ("assistant", "3")], [("system", "s"), ("assistant", "v")], []]
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    turns = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.turns_of_rows(clashing(rows)).collect()}
    assert turns == {1: [("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}
    assert chat.format_turns(chat.turns_of_rows(rows.where("false"))).count() == 0
    other = spark.createDataFrame([("d", 1, "human", "hi")], "dialog_id string, position int, speaker string, utterance string")
    assert [tuple(t) for t in chat.turns_of_rows(other).first().turns] == [("user", "hi")]
    with pytest.raises(ValueError, match="unknown layout"):
        chat.turns_of_rows(rows.drop("role"))


def test_chat_passengers_that_other_mappings_name_and_parts(spark):
    records = {
        '{"prompt":"a","response":"b","context":"c"}': ("prompt_response", [("user", "a"), ("assistant", "b")]),
        '{"messages":[{"role":"user","content":"q"}],"input":"i","prompt":"p"}': ("messages", [("user", "q")]),
        '{"instruction":"i","output":"o","context":"c"}': ("instruction_output", [("user", "i"), ("assistant", "o")]),
        '{"question":"q","answer":"a","context":"c","system":"s","role":"r"}': ("question_answer", [("user", "c\n\nq"), ("assistant", "a")]),
        '{"messages":[{"role":"user","content":[{"type":"text","text":"x"},"y",{"type":"image","url":"u"}]}]}': ("messages", [("user", 'xy{"type": "image", "url": "u"}')]),
        '{"messages":[{"role":"user","content":[1,2]}]}': ("messages", [("user", "[1, 2]")]),
        '{"messages":[{"role":"user"},"z"]}': (None, None),
        '{"messages":{"role":"user"},"prompt":"p"}': (None, None),
        '{"role":"user","text":"t","conv_id":1,"turn":0}': (None, None),
    }
    df = spark.createDataFrame(list(enumerate(records)), "id int, record string")
    got = chat.turns_of_records(df, keep=("id",)).orderBy("id").collect()
    assert [(r.layout, r.turns and [tuple(t) for t in r.turns]) for r in got] == list(records.values())
    assert all(r.fingerprint for r in got)


def test_token_ids_equal_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(9)
    texts = [None, "", " " * 1_000_000, "\n" * 200_000, "a<|endoftext|>b", "x" * 50_000, *("".join(rng.choice("aá'sT 12½\n\t 漢🙂.,-_") for _ in range(rng.randint(0, 60))) for _ in range(300))]
    lib = Tokenizer.from_file(path)
    token_io.write_tokens(clashing(docs(spark, *texts)), f"file://{tmp_path}/t", path, 2)
    out = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in token_io.read_tokens(spark, f"file://{tmp_path}/t").collect()}
    assert out == {k: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    token_io.write_tokens(docs(spark, "a").where("false"), f"file://{tmp_path}/e", path, 2)
    assert token_io.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_decontamination_at_every_offset_with_changes(spark):
    item = "seven plain words stand in this item"
    bench = spark.createDataFrame([(1, item), (2, "the river rose over its banks while farmers moved their cattle up to higher fields before night fell")], "item_id long, text string")
    around = [f"{' '.join(['filler'] * k)} {item} {'more text follows here ' * 3}" for k in range(14)]
    words = "the river rose over its banks while farmers moved their cattle up to higher fields before night fell".split()
    changed = [" ".join(words[:9] + ["old"] + words[9:]), " ".join(words[:7] + words[8:]), " ".join(words[:3] + ["X"] + words[4:10] + ["Y"] + words[11:])]
    got = {(r.doc_id, r.item_id) for r in decontam.matches(clashing(docs(spark, *around, *changed, "the river rose but nothing else is the same as before in this text at all")), bench).collect()}
    assert got == {(k, 1) for k in range(14)} | {(14, 2), (15, 2), (16, 2)}


def test_decontamination_slots_of_other_length_and_bare_items(spark):
    bench = spark.createDataFrame([(1, "Yesterday Bob paid 1000 crowns to the miller for grain and flour"), (2, "12 + 17 + 4 + 9 + 33 + 71 = 146"), (None, "Yesterday Bob paid 1000 crowns to the miller for grain and flour")], "item_id long, text string")
    texts = ["Yesterday Mary Ann paid 1 000 crowns to the miller for grain and flour", "so 12 + 17 + 4 + 9 + 33 + 71 = 146 it is", "so 13 + 18 + 5 + 9 + 31 + 70 = 146 it is", None]
    got = sorted((str(r.doc_id), str(r.item_id)) for r in decontam.matches(docs(spark, *texts), bench).collect())
    assert got == [("0", "1"), ("0", "None"), ("1", "2")]
    twice = docs(spark, texts[0], texts[0], "other words", texts[1], texts[0], ids=[1, 1, 1, None, None])
    assert sorted(map(str, decontam.matches(twice, bench.where("item_id is not null")).select("doc_id", "item_id").collect())) == sorted(["Row(doc_id=1, item_id=1)", "Row(doc_id=None, item_id=1)", "Row(doc_id=None, item_id=2)"])
    clean = decontam.decontaminate(clashing(twice), bench)
    assert clean.count() == 2 and clean.columns == clashing(twice).columns


def test_toxicity_reads_whole_words_and_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    long = "calm river " * 20_000
    df = clashing(docs(spark, "imbecile" + "a" * 70, "imbecile", long + "you stupid idiot", None, None, "", ids=[0, 1, 2, 3, 3, None]))
    out, _ = toxicity.score(df, labels)
    got = {(r.doc_id, r.score >= 0.5) for r in out.collect()}
    assert got == {(0, False), (1, True), (2, True), (3, False), (None, False)} and out.count() == 6
    empty, _ = toxicity.score(df.where("false"), labels)
    assert empty.count() == 0
    assert toxicity.patterns_of("A B C D", "a b c d", list("abcd"), set()) == 1
    assert len(toxicity.VOTERS) - len(toxicity.MINED) - 1 >= 20  # voters that see no label


def test_language_cases(spark):
    df = clashing(docs(spark, None, "", "the cat sat", "the cat sat", "the " * 100_000, ids=[1, 2, 3, 3, None]))
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.identify(df).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "en"), ("3", "en"), ("None", "en")]
    assert langid.identify(df.where("false")).count() == 0
    mixed = docs(spark, "the cat and the dog are here", "der Hund und die Katze sind da").withColumn("lang", F.when(F.col("doc_id") == 0, "en").otherwise("de"))
    row = langid.identify(mixed.union(docs(spark, "the cat and the dog are here der Hund und die Katze sind da", ids=[7]).withColumn("lang", F.lit(None).cast("string")))).where("doc_id = 7").first()
    assert row.lang_pred in ("en", "de") and 0.3 < row.score < 0.8  # two languages share the text


def test_bpe_and_minhash_cases(spark):
    df = clashing(docs(spark, None, "", "a b c d e f", "a b c d e f", "word " * 100_000, ids=[1, 2, 3, 3, None]))
    assert bpe.encode(df, public_tokenizers.path("word_bpe_49k.json")).count() == 5
    assert bpe.encode(df.where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert minhash.near_duplicates(df).count() == 5


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_cases(spark, tmp_path, name, stage):
    item = "the river rose over its banks while farmers moved their cattle up to higher fields"
    df = docs(spark, None, None, "", "you stupid idiot", item, "write to a@b.cd or 1.2.3.4", "write to a@b.cd or 1.2.3.4", "plain words that stand here alone", "z " * 50_000, ids=[1, None, 2, 3, 4, 5, 5, 6, 7])
    spark.createDataFrame([(4, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 1), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, clashing(df), str(tmp_path))
    if name != "bpe":
        assert out.columns == clashing(df).columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    gone = {"toxicity": ["3"], "decontamination": ["4"]}.get(name, [])
    assert kept == sorted(x for x in ["1", "None", "2", "3", "4", "5", "5", "6", "7"] if x not in gone)
    if name == "pii":
        assert {r.text for r in out.where("doc_id = 5").collect()} == {"write to <EMAIL> or <IP>"}
    assert stage(spark, df.where("false"), str(tmp_path)).count() == 0


@pytest.mark.parametrize("piece", ["7 ", "1,1,", "Bob ", "1", "A", "1 km ", "Bob 7 "])
def test_decontamination_reads_long_repetitive_texts(spark, piece):
    """Half a million characters of one kind: nothing recurses, and windows start at words only."""
    item = "What is the sum of 3 apples and 4 pears that Bob has"
    long = docs(spark, piece * (500_000 // len(piece)), piece * 1000 + ". " + item)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.matches(long, bench).collect()] == [(1, 1)]
