"""Registered queries of the corpus operators: thin digests over whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triweave.llm import ann, bpe, chat, codes, decontam, divergence, html, langid, minhash, pii, reputation, token_io, toxicity
from triweave.llm.common import hex_sha, shared_dir, table


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), decoded=True)
    return out.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        hex_sha("decoded").alias("decoded_sha256"),
    )


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), added)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_back(chat.format_turns(chat.turns_of_rows(rows.unionByName(own, allowMissingColumns=True))))
    turn = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha(F.array_join(turn, "")).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        hex_sha("loss_text").alias("loss_sha256"),
        "formatted_chars",
    )


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_io.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return token_io.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def remainder(doc: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids have none."""
    return F.crc32(doc.cast("string")) % n


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder(F.col("doc"), 5) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    out = langid.identify(table(spark, sf_dir, "documents"), use=remainder(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_bpe": op2_bpe,
    "op3_html": op3_html,
    "op4_pii": op4_pii,
    "op5_embeddings": op5_embeddings,
    "op6_chat": op6_chat,
    "op7_token_blocks": op7_token_blocks,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_codes": op11_codes,
    "op12_url_filter": op12_url_filter,
    "op13_divergence": op13_divergence,
}


def op6_sql() -> str:
    marks = ["\\"] + [a + b for a in "<[" for b in ("|", "INST]", "/INST]", "s>", "/s>", "<SYS>>", "</SYS>>", "SYS>>", "/SYS>>")]
    listed = ", ".join(f"'{m}'" for m in marks)
    size = f"length(x) + list_sum(list_transform([{listed}], lambda m: (length(x) - length(replace(x, m, ''))) // length(m)))"
    head = len(chat.TURN + chat.TEXT + chat.END)
    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    s AS (SELECT *, (SELECT {size} FROM (SELECT role AS x)) + (SELECT {size} FROM (SELECT text AS x)) + {head} AS n FROM c)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
      CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM s GROUP BY conv_id"""


def op11_sql() -> str:
    """The first codebooks, four rounds and the last assignment, one after the other; a part and an entry meet by part."""
    nearest = "list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.x[k]) * (p.x[k] - b.x[k])))"
    floor = "CAST((s - (s % n + n) % n) // n AS BIGINT)"
    steps = [f"""
    kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(part)),
    firsts AS (SELECT id, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept QUALIFY entry < {codes.ENTRIES}),
    book0 AS MATERIALIZED (SELECT part, entry, x FROM parts JOIN firsts USING (id))"""]
    for k in range(codes.ROUNDS + 1):
        steps.append(f"at{k} AS MATERIALIZED (SELECT p.id, p.part, min((CAST({nearest} AS HUGEINT)) * {codes.ENTRIES} + b.entry) AS best FROM parts p JOIN book{k} b USING (part) GROUP BY ALL)")
        if k < codes.ROUNDS:
            steps.append(f"""
    sums{k} AS (SELECT part, entry, k, sum(c) AS s, count(*) AS n FROM (SELECT a.part, a.best % {codes.ENTRIES} AS entry, unnest(range(1, len(p.x) + 1)) AS k, unnest(p.x) AS c FROM at{k} a JOIN parts p USING (id, part)) GROUP BY ALL),
    book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b
      LEFT JOIN (SELECT part, entry, list({floor} ORDER BY k) AS x FROM sums{k} GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry)""")
    last = codes.ROUNDS
    return f"""WITH {', '.join(steps)},
    coded AS (SELECT id, string_agg(lpad(lower(to_hex(CAST(best % {codes.ENTRIES} AS INTEGER))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best // {codes.ENTRIES}) AS BIGINT) AS error FROM at{last} GROUP BY id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{last}) AS codebooks_sha256
    FROM kept JOIN coded USING (id)"""


def op12_sql() -> str:
    second = ", ".join(f"'{x}'" for x in reputation.SECOND_LEVEL)
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}|{v}'" for h, p, v in sorted(reputation.RULES, key=lambda r: -len(r[0] + r[1]))
    )

    def size(children: str) -> str:
        rho = "sum((y - n * m) * (y - n * m) - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0)"
        return f"(SELECT 1 / coalesce(least(greatest({rho}, {reputation.RHO_LEAST}), {reputation.RHO_MOST}), {reputation.RHO_UNKNOWN}) - 1 FROM {children} WHERE n > 0)"

    return f"""
    WITH behind AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS u FROM pages),
    split AS (SELECT page_id, translate(regexp_extract(u, '^[^/?#]*'), '{reputation.UPPER}', '{reputation.LOWER}') AS host, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM behind),
    named AS (SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '[.]$', '') AS name, CASE {cases} END AS r FROM split),
    bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
    seen AS (SELECT name, count(bad) AS n, coalesce(sum(bad), 0) AS y, string_split(name, '.') AS p FROM named LEFT JOIN bad ON page_id = doc_id WHERE name <> '' GROUP BY name),
    kinds AS (SELECT *, regexp_full_match(name, '[0-9.]+') AS address, len(p) > 2 AND length(p[-1]) = 2 AND p[-2] IN ({second}) AS two FROM seen),
    hosts AS (SELECT name, n, y, CASE WHEN address OR len(p) < 2 THEN name WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
      CASE WHEN address THEN '' WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix FROM kinds),
    s0 AS (SELECT suffix, sum(n) AS n, sum(y) AS y, (SELECT (coalesce(sum(y), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix),
    s AS (SELECT suffix, (y + k * m) / (n + k) AS m FROM s0, (SELECT {size('s0')} AS k)),
    d0 AS (SELECT domain, suffix, sum(n) AS n, sum(y) AS y, any_value(m) AS m FROM hosts JOIN s USING (suffix) GROUP BY domain, suffix),
    d AS (SELECT domain, suffix, (y + k * m) / (n + k) AS m FROM d0, (SELECT {size('d0')} AS k)),
    h0 AS (SELECT name, n, y, m FROM hosts JOIN d USING (domain, suffix)),
    h AS (SELECT name, y + k * m AS a, n - y + k * (1 - m) AS b FROM h0, (SELECT {size('h0')} AS k)),
    blocked AS (SELECT name FROM h WHERE a / (a + b) - {reputation.DEVIATIONS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {reputation.BLOCK})
    SELECT page_id, host, path, string_split(r, '|')[1] AS rule,
      coalesce(string_split(r, '|')[2], CASE WHEN name IN (SELECT name FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
    FROM named"""


def op13_sql() -> str:
    upper, lower = reputation.UPPER, reputation.LOWER
    share = lambda n, total: f"1 + (CAST(1000000000 AS HUGEINT) * ({n} + 1)) // ({total} + v)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    occ AS MATERIALIZED (SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{upper}', '{lower}') AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.IN_DOCUMENTS}),
    c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
    p AS MATERIALIZED (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, {share('coalesce(n, 0)', 'total')} AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    l AS (SELECT lang, term, {share('sum(n)', 'any_value(t)').replace('+ v', '+ any_value(v)')} AS q FROM c JOIN (SELECT lang, sum(total) AS t, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
      WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
    terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
    ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
      UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= {divergence.TOP})
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""


ORACLE_SQL: dict[str, str] = {"op6_chat": op6_sql(), "op11_codes": op11_sql(), "op12_url_filter": op12_sql(), "op13_divergence": op13_sql()}
