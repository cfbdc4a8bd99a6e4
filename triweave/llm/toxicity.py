"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. Cues, words and word beginnings that go with the label, are mined from a sample of at most ``FIT_ROWS`` labelled
   rows, twice: on each half of it; at most ``MAX_CUES`` of them, those that tell most, are the classifier's
   features. A word beginning that two different words of a text share is a cue of its own, as toxic texts mostly
   hold several words of a kind. The words of fixed lexicons in four languages are added.
2. One pass over all whole texts notes each document's cues and the patterns that it shows.
3. Voters: each lexicon and each pattern, none of which has seen a label; words, beginnings and sure cues mined from
   either half; and the annotators' labels of rows to learn from, who may err like the others. The label model is a
   mixture of a clean and a toxic class; each voter has an error rate in either, and counts the less the more its
   errors go with other voters', so that voters which err together count once. Expectation-maximisation runs over the
   counts of all documents' vote patterns: each round is a pass of tasks over the distinct patterns, which sums moments
   of the votes; the driver holds these sums of at most ``SLICES`` tasks, never the patterns.
4. A logistic regression over cues is trained on the posteriors of documents, labelled or not, summed over those with
   the same cues, of at most ``FIT_SETS`` sets of cues (those with the smallest hashes), and on rows with one sure cue
   alone; all rows are scored with it.

Defined results: null and empty texts have no cue and get the score of such a text. Without any label the voters are
the lexicons and patterns. Rows with a null id are scored, and never learned from. Several labels of one id count as
toxic if one is, and of several texts of one id the sample takes one. Repeated rows are scored each. Only the named
columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.llm.common import cut, tidy

FIT_ROWS = 12_000
FIT_SETS = 200_000
MAX_CUES = 4_096
SLICES = 64
ROUNDS = 100
MIN_G2, MIN_ODDS, SURE = 20.0, 2.0, 0.9
BEGINNINGS = range(3, 9)
KNOWN_CLEAN = 100_000
DENSE = 0.02  # share of listed words from which a text is dense in them
# Abusive words by language and kind.
LEXICONS = {
    "en_insults": "airhead blockhead cretin dimwit dumb dumbass dunce fool halfwit idiot idiotic imbecile moron moronic nitwit retard simpleton stupid",
    "en_contempt": "disgusting garbage loathsome loser pathetic repulsive trash ugly useless vile worthless",
    "en_dehumanising": "cockroach degenerate filth maggot parasite pig scum scumbag subhuman vermin",
    "en_mockery": "clown coward creep freak jerk liar lunatic weirdo wimp",
    "en_profanity": "asshole bastard bitch bullshit crap fuck fucker fucking motherfucker prick shit shitty slut whore",
    "de_insults": "blödmann depp dummkopf idioten schwachkopf trottel vollidiot",
    "de_contempt": "abschaum ekelhaft erbärmlich missgeburt versager widerlich wertlos",
    "de_profanity": "arschloch fotze hure hurensohn scheiße scheiss schlampe wichser",
    "fr_insults": "abruti bouffon crétin débile idiote imbécile stupide",
    "fr_contempt": "dégoûtant minable ordure pathétique racaille raté",
    "fr_profanity": "connard connasse enculé merde pute putain salaud salope",
    "es_insults": "cretino estúpido idiota imbécil tonto",
    "es_contempt": "asqueroso basura escoria inútil patético repugnante",
    "es_profanity": "cabrón gilipollas hijoputa joder mierda pendejo puta",
}
INSULTS = tuple(dict.fromkeys(w for words in LEXICONS.values() for w in words.split()))
YOU = frozenset("you your youre u du dein deine ihr sie tu vous ton eres tú usted".split())
TELLING_OFF = re.compile(r"\b(?:shut up|go to hell|drop dead|get lost|screw you|halt(?:'s| die) (?:maul|klappe)|fahr zur hölle|ta gueule|ferme[- ]la|va te faire|cállate|vete al infierno)\b")
THREAT = re.compile(r"\b(?:i(?:'ll| will| am going to) (?:kill|hurt|beat|destroy) you|you will (?:die|pay)|ich bring(?:e)? dich um|je vais te (?:tuer|frapper)|te voy a (?:matar|pegar))\b")
MASKED = re.compile(r"\b[a-z][*#@$]{2,}[a-z]*\b|\b(?:f[*#@]ck|sh[*#@!]t|b[*#@!]tch|a[*#@$]{2}hole)\b")
PATTERNS = ("shouting", "exclaims", "addressed", "two_kinds", "repeated", "dense", "in_capitals", "masked", "telling_off", "threat")
MINED = ("words_a", "words_b", "starts_a", "starts_b", "twice_a", "twice_b", "sure_a", "sure_b")
VOTERS = (*LEXICONS, *PATTERNS, *MINED, "annotator")
WORDS = re.compile(r"[^\W\d_]+")


def cues_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def cues_in(words: set[str]) -> set[str]:
    """Cues of a text's distinct words: of each word, and with a second star the beginnings that several share."""
    held = Counter(c for w in words for c in cues_of(w))
    return {*held, *(c + "*" for c, n in held.items() if n > 1)}


def cues_with(cue: str) -> list[str]:
    """Cues that a text with this one must have too."""
    word = cue.rstrip("*")
    own = [*cues_of(word), *([word + "*"] if cue != word else [])]
    return [*own, *(c + "*" for c in own if c != word)] if cue.endswith("**") else own


def shouts(text: str, words: int) -> bool:
    return words >= 4 and (sum(map(str.isupper, text)) > 0.6 * sum(map(str.isalpha, text)) or text.count("!") > 0.5 * words)


def patterns_of(text: str, low: str, words: list[str], listed: set[str]) -> int:
    """A bit for each of PATTERNS that a text shows; ``listed``: its words that a lexicon holds."""
    at = [k for k, w in enumerate(words) if w in listed] if listed else []
    found = (
        shouts(text, len(words)),
        bool(at) and "!!" in text,
        any(not YOU.isdisjoint(words[max(0, k - 3) : k]) for k in at),
        len(listed) > 1,
        len(at) > len(listed),
        len(at) > DENSE * len(words),
        any(w.upper() in text for w in listed if len(w) > 3),
        ("*" in low or "#" in low or "@" in low) and MASKED.search(low) is not None,
        TELLING_OFF.search(low) is not None if any(x in low for x in (" up", "hell", "dead", "lost", "screw", "maul", "klapp", "höll", "gueul", "ferme", "faire", "cállate")) else False,
        THREAT.search(low) is not None if any(x in low for x in ("kill", "hurt", "beat you", "destroy", "you will", "dich um", "tuer", "frapper", "matar", "pegar")) else False,
    )
    return sum(1 << k for k, hit in enumerate(found) if hit)


def cue_counts(sample: DataFrame) -> DataFrame:
    """``cue, half, pos, neg``: documents of each half of the sample with a cue, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], Counter] = {(h, t): Counter() for h in (0, 1) for t in (0, 1)}
        for batch in batches:
            for text, half, toxic in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                total[half, toxic].update(cues_in(set(WORDS.findall((text or "").lower()))))
        for half in (0, 1):
            names = chain(total[half, 1], (c for c in total[half, 0] if c not in total[half, 1]))
            while part := list(islice(names, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([half] * len(part), pa.int32()), *(pa.array([total[half, t][c] for c in part], pa.int64()) for t in (1, 0))], names=["cue", "half", "pos", "neg"])

    return sample.select("text", "half", "toxic").mapInArrow(tidy(run), "cue string, half int, pos long, neg long").groupBy("cue").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("pos", "neg")])


def g2(pos: Column, neg: Column, n_pos: int, n_neg: int) -> tuple[Column, Column]:
    """Likelihood ratio of a cue's label shares against the sample's, and its log odds."""
    rate = max(n_pos, 0.5) / max(n_pos + n_neg, 1)
    n = pos + neg
    part = lambda x, q: F.when(x > 0, x * F.log(x / (n * q))).otherwise(0.0)
    return 2 * (part(pos, rate) + part(neg, max(1 - rate, 1e-9))), F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))


@dataclass
class Model:
    cues: dict[str, int]  # place of each cue in weight
    weight: np.ndarray
    bias: float
    accuracy: dict[str, float]  # of each voter, as the label model estimates it


@dataclass
class LabelModel:
    """Two classes of documents and what the voters do in each; ``None`` fields before the first round."""

    prior: float = 0.5
    rate: np.ndarray | None = None  # class by voter: how often it fires
    first: np.ndarray | None = None
    once: np.ndarray | None = None  # a voter's share of those that err with it
    wrong: float = 0.1  # the annotator says toxic of clean, and of toxic ones
    hit: float = 0.9


def beliefs(fires: np.ndarray, count: np.ndarray, model: LabelModel) -> np.ndarray:
    """Probability of the toxic class for each row of votes (fires or not) and each word of the annotator: clean, nothing, toxic.

    ``count``: documents by row and word. Before the first round one vote is enough, or what annotators mostly say of
    such votes.
    """
    if model.rate is None:
        p = np.where(fires.any(axis=1), 0.95, 0.05)
        told = count[:, 0] + count[:, 2]
        p = np.where(told > 0, np.clip((count[:, 2] + 0.5 * p) / (told + 0.5), 0.02, 0.98), p)
        return np.repeat(p[:, None], 3, axis=1)
    rate = model.rate
    z = np.log(model.prior / (1 - model.prior)) + (fires * np.log(rate[1] / rate[0]) + (1 - fires) * np.log((1 - rate[1]) / (1 - rate[0]))) @ model.once
    said = np.array([np.log((1 - model.hit) / (1 - model.wrong)), 0.0, np.log(model.hit / model.wrong)])
    return 1 / (1 + np.exp(-np.clip(z[:, None] + said, -30, 30)))


def moments(fires: np.ndarray, count: np.ndarray, model: LabelModel, before: LabelModel | None) -> np.ndarray:
    """What a round needs of some rows, as one vector that adds up: per class the documents, those by voter and by pair
    of voters that fire, and those by the annotator's word; the last number is how far a belief moved."""
    p = beliefs(fires, count, model)
    moved = np.abs(p - beliefs(fires, count, before))[count > 0].max(initial=0.0) if before is not None else 1.0
    out = []
    for w in (count * (1 - p), count * p):
        own = w.sum(axis=1)
        out += [np.array([own.sum()]), own @ fires, ((fires * own[:, None]).T @ fires).ravel(), w.sum(axis=0)]
    return np.concatenate([*out, [moved]])


def next_model(total: np.ndarray, voters: int, first: np.ndarray | None) -> LabelModel:
    """The round's model from summed moments."""
    part = np.split(total[:-1], 2)
    mass = np.array([x[0] for x in part])
    hits = np.array([x[1 : 1 + voters] for x in part])
    both = [x[1 + voters : 1 + voters + voters * voters].reshape(voters, voters) for x in part]
    told = np.array([x[-3:] for x in part])
    rate = hits / np.maximum(mass, 1e-9)[:, None]
    first = rate if first is None else first
    rate = np.clip((hits + 5 * first) / (mass[:, None] + 5), 1e-4, 1 - 1e-4)  # as of five more votes like those at the start
    cov = sum(both[k] - np.outer(hits[k], rate[k]) - np.outer(rate[k], hits[k]) + mass[k] * np.outer(rate[k], rate[k]) for k in (0, 1)) / mass.sum()
    scale = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-6
    once = 1 / np.maximum(np.abs(cov / np.outer(scale, scale)).sum(axis=1), 1)
    wrong, hit = (told[:, 2] + np.array([1, 9])) / (told[:, 0] + told[:, 2] + 10)  # as of ten more labels with one error
    return LabelModel(float(np.clip(mass[1] / mass.sum(), 1e-4, 0.9)), rate, first, once, float(wrong), float(hit))


def accuracies(total: np.ndarray, voters: tuple[str, ...]) -> dict[str, float]:
    """How often each voter is right where it votes, the annotator last."""
    n = len(voters) - 1
    clean, toxic = np.split(total[:-1], 2)
    out = {v: float(toxic[1 + k] / max(toxic[1 + k] + clean[1 + k], 1e-9)) for k, v in enumerate(voters[:-1])}
    told = clean[-3] + clean[-1] + toxic[-3] + toxic[-1]
    return out | {voters[-1]: float((toxic[-1] + clean[-3]) / max(told, 1e-9))}


def fitted(sums, voters: tuple[str, ...]) -> tuple[LabelModel, dict[str, float]]:
    """The label model and the voters' accuracies; ``sums(model, before)`` gives the moments over all rows."""
    before, model, accuracy = None, LabelModel(), {}
    for _ in range(ROUNDS):
        total = sums(model, before)
        accuracy = accuracies(total, voters)
        if before is not None and total[-1] < 1e-4:
            break
        before, model = model, next_model(total, len(voters) - 1, model.first)
    return model, accuracy


def votes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``fires`` (text of 0 and 1) and the counts by the annotator's word as matrices."""
    fires = np.array([list(map(int, v)) for v in batch.column(0).to_pylist()], dtype=float).reshape(batch.num_rows, -1)
    return fires, np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2, 3)], axis=1)


def sum_moments(votes: DataFrame, model: LabelModel, before: LabelModel | None) -> np.ndarray:
    """Moments over all rows of ``fires, n_clean, n_none, n_toxic``, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = moments(*votes_of(batch), model, before)
                total = x if total is None else np.append(total[:-1] + x[:-1], max(total[-1], x[-1]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["m"])

    rows = np.array([r.m for r in votes.coalesce(SLICES).mapInArrow(tidy(run), "m array<double>").collect()])
    return np.append(rows[:, :-1].sum(axis=0), rows[:, -1].max())


def logistic(size: np.ndarray, flat: np.ndarray, target: np.ndarray, mass: np.ndarray, start: np.ndarray, rounds: int = 3000, prior: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression over cue sets, by accelerated gradient.

    ``size`` and ``flat``: the sets one after the other; ``mass`` documents have each. ``start`` is what a weight is
    drawn to, with the force of ``prior`` documents.
    """
    share = mass / mass.sum()
    goal, ridge, n = share * target, prior / mass.sum(), len(start)
    owner = np.repeat(np.arange(len(size)), size)
    curve = np.bincount(flat, weights=(share * np.maximum(size, 1))[owner], minlength=n) / 4 + ridge  # bound of the second derivative
    w, b, vw, vb = start.copy(), -2.0, np.zeros(n), 0.0
    for k in range(rounds):
        z = b + vb + np.bincount(owner, weights=(w + vw)[flat], minlength=len(size))
        err = share / (1 + np.exp(-np.clip(z, -30, 30))) - goal
        keep = min(0.99, (k + 1) / (k + 4))
        stepped, moved = w + vw - (np.bincount(flat, weights=err[owner], minlength=n) + ridge * (w + vw - start)) / (curve * 2), b + vb - err.sum() * 2
        vw, vb = keep * (stepped - w), keep * (moved - b)
        done = max(np.abs(stepped - w).max(initial=0.0), abs(moved - b)) < 1e-5
        w, b = stepped, moved
        if done:
            break
    return w, b


def find_cues(docs: DataFrame, cues: dict[str, int], doc: str, text: str) -> DataFrame:
    """``doc, cues array<int>, patterns int`` of every row, from its whole text."""
    source = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    kind = source.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: set[str] = set()
        hits: dict[str, list[int]] = {}
        starts = {c[:3] for c in cues}  # no cue begins otherwise
        lexicon = frozenset(INSULTS)
        twice = {k: cues[c + "*"] for c, k in cues.items() if c + "*" in cues}
        for batch in batches:
            found, shown = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                low = t.lower()
                words = WORDS.findall(low)
                distinct = set(words)
                shown.append(patterns_of(t, low, words, lexicon & distinct))
                here: set[int] = set()
                again: set[int] = set()
                for w in distinct - clean:
                    got = hits.get(w)
                    if got is None:
                        got = [cues[c] for c in cues_of(w) if c in cues] if w[:3] in starts else []
                        if got:
                            hits[w] = got
                        else:
                            clean.add(w)
                    again.update(twice[c] for c in got if c in here and c in twice)
                    here.update(got)
                found.append(sorted(here | again))
                if len(clean) + len(hits) > KNOWN_CLEAN:
                    clean, hits = set(), {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(shown, pa.int32())], names=["doc", "cues", "patterns"])

    return source.mapInArrow(tidy(run), f"doc {kind}, cues array<int>, patterns int")


def score(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None) -> tuple[DataFrame, Model]:
    """``doc, score`` of every row, and the model. Labels of rows where ``learn`` (over the column ``doc``) holds are used."""
    marked = labels.select(F.col(doc).alias("doc"), F.col(label).cast("int").alias("toxic")).where("doc is not null and toxic in (0, 1)")
    marked = marked.where(learn) if learn is not None else marked
    marked = marked.groupBy("doc").agg(F.max("toxic").alias("toxic"))
    present = docs.select(F.col(doc).alias("doc")).where("doc is not null").distinct()
    # the sample: at most FIT_ROWS ids with the smallest hashes
    ids = cut(marked.join(present, "doc", "left_semi").withColumn("h", F.xxhash64("doc")).orderBy("h", "doc").limit(FIT_ROWS))
    sample = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).join(F.broadcast(ids), "doc").withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    sample = cut(sample.groupBy("doc", "half", "toxic").agg(F.max("text").alias("text")))
    size = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    mined: dict[str, set[str]] = {v: set() for v in MINED}
    kept: list[str] = []
    if any(t for _, t in size):
        n = [[size.get((h, t), 0) for t in (1, 0)] for h in (0, 1)]
        counts = cue_counts(sample)
        fit = counts.select("cue", (F.col("pos0") + F.col("pos1")).alias("pos"), (F.col("neg0") + F.col("neg1")).alias("neg"), "pos0", "neg0", "pos1", "neg1", *[x.alias(a) for h in (0, 1) for a, x in zip((f"g{h}", f"o{h}"), g2(F.col(f"pos{h}"), F.col(f"neg{h}"), *n[h]), strict=True)], *[x.alias(a) for a, x in zip(("g", "o"), g2(F.col("pos0") + F.col("pos1"), F.col("neg0") + F.col("neg1"), n[0][0] + n[1][0], n[0][1] + n[1][1]), strict=True)])
        listed = fit.where((F.col("g") >= MIN_G2) & (F.col("o") >= MIN_ODDS)).orderBy(F.desc("g"), "cue").limit(MAX_CUES).collect()
        for r in listed:
            kept.append(r.cue)
            for h, half in enumerate("ab"):
                if r[f"o{h}"] >= MIN_ODDS and r[f"g{h}"] >= MIN_G2 / 2:
                    mined[("twice_" if r.cue.endswith("**") else "starts_" if r.cue[-1] == "*" else "words_") + half].add(r.cue)
                    if r[f"pos{h}"] >= SURE * (r[f"pos{h}"] + r[f"neg{h}"] + 1):
                        mined["sure_" + half].add(r.cue)
    cues = {c: k for k, c in enumerate(dict.fromkeys([*kept, *INSULTS]))}
    found = cut(find_cues(docs, cues, doc, text))

    def fires(names) -> Column:
        listed = [cues[c] for c in names if c in cues]
        return F.arrays_overlap("cues", F.array(*[F.lit(c) for c in listed]).cast("array<int>")) if listed else F.lit(False)

    bits = [fires(words.split()) for words in LEXICONS.values()] + [F.col("patterns").bitwiseAND(1 << k) > 0 for k in range(len(PATTERNS))] + [fires(mined[v]) for v in MINED]
    told = found.where("doc is not null").join(marked.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d"), "left")
    groups = told.groupBy("cues", "patterns", "toxic").count()
    groups = cut(groups.select("cues", "toxic", "count", F.concat(*[F.when(b, "1").otherwise("0") for b in bits]).alias("fires")))
    say = [F.sum(F.when(F.col("toxic").eqNullSafe(t), F.col("count")).otherwise(0)).alias(c) for c, t in (("n_clean", 0), ("n_none", None), ("n_toxic", 1))]
    votes = cut(groups.groupBy("fires").agg(*say))
    weight, bias, accuracy = np.zeros(len(cues)), -2.0, {}
    for c in INSULTS:
        weight[cues[c]] = 4.0
    if not votes.isEmpty():
        label_model, accuracy = fitted(lambda model, before: sum_moments(votes, model, before), VOTERS)

        def believe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = beliefs(*votes_of(batch), label_model)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(q[:, k], pa.float64()) for k in range(3))], names=["fires", "q_clean", "q_none", "q_toxic"])

        belief = votes.mapInArrow(tidy(believe), "fires string, q_clean double, q_none double, q_toxic double")
        q = F.when(F.col("toxic") == 1, F.col("q_toxic")).when(F.col("toxic") == 0, F.col("q_clean")).otherwise(F.col("q_none"))
        sets = groups.join(belief, "fires").groupBy("cues").agg(F.sum("count").alias("n"), F.sum(F.col("count") * q).alias("toxic"))
        sets = sets.orderBy(F.xxhash64("cues"), "cues").limit(FIT_SETS).toArrow().combine_chunks()
        listed, n, toxic = sets["cues"].combine_chunks(), sets["n"].to_numpy().astype(float), sets["toxic"].to_numpy()
        size, flat = np.diff(listed.offsets.to_numpy()).astype(np.int64), listed.flatten().to_numpy().astype(np.int64)
        target = toxic / n
        # a row with each sure cue alone, as toxic texts mostly have several; of other cues what else such texts have decides
        owner = np.repeat(np.arange(len(size)), size)
        held, bad = (np.bincount(flat, weights=m[owner], minlength=len(cues)) for m in (n, toxic))
        for c, k in cues.items():
            if held[k] and bad[k] >= SURE * (held[k] + 1):
                alone = sorted({cues[x] for x in cues_with(c) if x in cues})
                size, flat = np.append(size, len(alone)), np.append(flat, alone)
                target, n = np.append(target, (bad[k] + 0.1) / (held[k] + 1)), np.append(n, held[k] / 4)
        weight, bias = logistic(size, flat, target, n, weight)
    model = Model(cues, weight, float(bias), accuracy)
    return scored(found, model).withColumnRenamed("doc", doc), model


def scored(found: DataFrame, model: Model) -> DataFrame:
    kind = found.schema["doc"].dataType.simpleString()
    weight, bias = model.weight, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.array([bias + weight[np.array(c, dtype=np.int64)].sum() for c in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], names=["doc", "score"])

    return found.select("doc", "cues").mapInArrow(tidy(run), f"doc {kind}, score double")
