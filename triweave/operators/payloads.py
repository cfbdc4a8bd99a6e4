"""Answers of a model about documents: reading the payload out of the text, checking it, and applying it to records."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.functions.dates import parse_date
from triweave.functions.money import amounts_inconsistent, decimal_to_minor, format_minor, norm_currency
from triweave.functions.numbers import clean_number, tax_id_checksum
from triweave.functions.records import FILENAME_NUMBER, MODEL_PREFIX, MODEL_SUFFIX, clean_name, is_placeholder, missing_core_fields
from triweave.schema import COLUMNS
from triweave.storage import cut

# The fields of a payload.
FIELDS = ("invoice_number", "issue_date", "sale_date", "due_date", "gross_amount", "net_amount", "vat_amount", "currency", "seller_tax_id", "buyer_tax_id", "seller_name", "buyer_name")
MONEY, DATES, IDS, NAMES = FIELDS[4:7], FIELDS[1:4], FIELDS[8:10], FIELDS[10:12]
# Country codes of foreign tax numbers.
FOREIGN = "IE|GB|EU|DE|FR|IT|ES|NL|BE|AT|CZ|SK|SE|DK|FI|PT|HU|RO|BG|HR|SI|LT|LV|EE|LU|CY|MT|EL"
OUTCOMES = ("applied", "unchanged", "rejected", "transient")


CHANNEL = "<|channel>"
# Channels in which a model thinks.
THOUGHTS = frozenset(("thought", "analysis", "reasoning"))
CHANNEL_NAME = re.compile("[A-Za-z0-9_-]*")
MARKS = re.compile(r'[{}"\\]')


def said(answer: str) -> str:
    """The final channel of an answer, or all of it but channels of thought; names of channels left out."""
    if f"{CHANNEL}final" in answer:
        return answer.split(f"{CHANNEL}final", 1)[1].split(CHANNEL, 1)[0].strip()
    first, *rest = answer.split(CHANNEL)
    named = [(CHANNEL_NAME.match(x)[0], x) for x in rest]
    return "".join([first, *(x[len(name) :] for name, x in named if name not in THOUGHTS)]).strip()


def objects(text: str) -> list[str]:
    """Outermost JSON objects of a text in order; braces inside strings of an object do not count.

    One walk from mark to mark, with the depth and whether a string is open as its only state.
    """
    out, depth, start, quoted, passed = [], 0, 0, False, -1
    for m in MARKS.finditer(text):
        at, c = m.start(), m[0]
        if at == passed:  # it stands behind a backslash
            continue
        if quoted:
            if c == "\\":
                passed = at + 1
            quoted = c != '"'
        elif c == "{":
            start = start if depth else at
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : at + 1])
        elif c == '"':
            quoted = depth > 0
    return out


def no_constant(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are not JSON


def is_json(text: str) -> bool:
    try:
        json.loads(text, parse_int=str, parse_float=str, parse_constant=no_constant)
    except (ValueError, RecursionError):
        return False
    return True


def read_answer(answer: str) -> str | None:
    text = said(answer)
    return text if text and is_json(text) else next((x for x in reversed(objects(text)) if is_json(x)), None)


def payload_of(answer: Column) -> Column:
    """JSON text in an answer: the whole of what it says if that is JSON, else its last outermost object that is."""

    @F.arrow_udf("string")
    def read(answer: pa.Array) -> pa.Array:
        return pa.array([None if x is None else read_answer(x) for x in answer.to_pylist()], pa.string())

    return read(answer)


def normalised(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Adds ``p_<field>`` texts of a payload in plain form, ``notes`` of what was changed, and ``problems``; valid if there is none.

    Changed are decimal commas, a PL prefix of tax ids, and foreign tax numbers, which become null. A payload has
    exactly the twelve fields, each a text or null.
    """
    parsed = payload.withColumn("_v", F.try_parse_json(column))  # once for all fields
    v = F.col("_v")
    keys = F.coalesce(F.json_object_keys(F.when(v.isNotNull(), F.col(column))), F.array().cast("array<string>"))
    kind = {f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")) for f in FIELDS}
    text = {f: F.when(kind[f] == "STRING", F.try_variant_get(v, f"$.{f}", "string")) for f in FIELDS}
    shape = F.when(F.array_sort(keys) != F.array(*[F.lit(f) for f in sorted(FIELDS)]), "fields")
    typed = [F.when(~F.coalesce(kind[f], F.lit("VOID")).isin("STRING", "VOID"), f"{f}: no text") for f in FIELDS]
    out = parsed.select(*payload.columns, *[text[f].alias(f"_{f}") for f in FIELDS], F.array_compact(F.array(shape, *typed)).alias("_shape"))
    comma = {f: F.coalesce(F.col(f"_{f}").rlike("^-?[0-9]+,[0-9]{2}$"), F.lit(False)) for f in MONEY}
    polish = {f: F.coalesce(F.col(f"_{f}").rlike("(?i)^PL[ 0-9-]+$"), F.lit(False)) for f in IDS}
    foreign = {f: F.coalesce(F.col(f"_{f}").rlike(f"^(?:{FOREIGN})[A-Z0-9]+$"), F.lit(False)) & ~polish[f] for f in IDS}
    plain = {f: F.col(f"_{f}") for f in FIELDS}
    plain |= {f: F.when(comma[f], F.replace(F.col(f"_{f}"), F.lit(","), F.lit("."))).otherwise(F.col(f"_{f}")) for f in MONEY}
    plain |= {f: F.when(polish[f], F.regexp_replace(f"_{f}", "[^0-9]", "")).when(~foreign[f], F.col(f"_{f}")) for f in IDS}
    notes = [F.when(comma[f], f"model: decimal comma in {f}") for f in MONEY] + [F.when(polish[f], f"model: prefix PL in {f}") for f in IDS] + [F.when(foreign[f], f"model: foreign tax number in {f} left out") for f in IDS]
    out = out.select(*payload.columns, "_shape", *[plain[f].alias(f"p_{f}") for f in FIELDS], F.array_compact(F.array(*notes)).alias("notes"))
    c = lambda f: F.col(f"p_{f}")
    bad = [F.when(F.trim(c(f)) == "", f"{f}: empty") for f in FIELDS]
    bad += [F.when(c(f).isNotNull() & (~c(f).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.try_to_date(c(f), "yyyy-MM-dd").isNull()), f"{f}: no date") for f in DATES]
    bad += [F.when(c(f).isNotNull() & (~c(f).rlike("^-?[0-9]+[.][0-9]{2}$") | decimal_to_minor(c(f)).isNull()), f"{f}: no amount") for f in MONEY]
    bad += [F.when(c(f).isNotNull() & (~c(f).rlike("^[0-9]{10}$") | ~tax_id_checksum(c(f))), f"{f}: no tax id") for f in IDS]
    bad += [F.when(c("currency").isNotNull() & ~norm_currency(c("currency")).eqNullSafe(c("currency")), "currency: no code")]
    bad += [F.when(is_placeholder(c(f)), f"{f}: a heading") for f in NAMES]
    return out.withColumn("problems", F.concat("_shape", F.array_compact(F.array(*bad)))).drop("_shape")


def apply_payloads(records: DataFrame, answers: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Records after ``answers`` (``content_hash, answer``; a null answer is a failure to ask), and ``content_hash, outcome, detail``.

    Gaps are filled. Inconsistent amounts give way to a consistent triple, a number guessed from the file name to one
    that was read. An answer is applied as a whole: not if it is invalid, core fields are missing after it, or net and
    tax do not make the gross. Of several answers of a document the first by content counts.

    What was read out of the answers is written before records meet it, and the records after them before they are told
    apart: both results read the same ones, and no later column works an earlier one out again.
    """
    a = answers.groupBy("content_hash").agg(F.min("answer").alias("answer")).withColumn("payload", payload_of(F.col("answer")))
    a, p = normalised(a).withColumnRenamed("content_hash", "_h"), lambda f: F.col(f"p_{f}")
    value = {"invoice_number": F.nullif(clean_number(p("invoice_number")), F.lit("")), "currency": norm_currency(p("currency"))}
    value |= {f: decimal_to_minor(p(f)) for f in MONEY} | {d: parse_date(p(d)) for d in DATES} | {i: p(i) for i in IDS} | {n: clean_name(p(n)) for n in NAMES}
    a = cut(a.select("_h", "answer", "payload", "notes", "problems", *[value[f].alias(f"v_{f}") for f in FIELDS]))
    rows = records.select(F.struct(*COLUMNS).alias("r"), "content_hash").join(a, F.col("content_hash") == F.col("_h"), "left")
    r, v = F.col("r"), lambda f: F.col(f"v_{f}")
    number = v("invoice_number")
    guessed = F.array_contains(r["warnings"], FILENAME_NUMBER)
    triple = {m: v(f"{m}_amount") for m in ("net", "vat", "gross")}
    swap = amounts_inconsistent(*[r[f"{m}_amount_minor"] for m in triple]) & F.coalesce(triple["net"] + triple["vat"] == triple["gross"], F.lit(False))
    better = guessed & number.isNotNull()
    other = better & ~number.eqNullSafe(r["invoice_number"])
    fields = {"invoice_number": F.when(better, number).otherwise(F.coalesce(r["invoice_number"], number)), "currency": F.coalesce(r["currency"], v("currency"))}
    fields |= {f"{m}_amount_minor": F.when(swap, triple[m]).otherwise(F.coalesce(r[f"{m}_amount_minor"], triple[m])) for m in triple}
    fields |= {f: F.coalesce(r[f], v(f)) for f in DATES + IDS}
    named = {n: F.when(~is_placeholder(v(n)), v(n)) for n in NAMES}
    fields |= {n: F.when(r[n].isNull() | is_placeholder(r[n]), F.coalesce(named[n], r[n])).otherwise(r[n]) for n in NAMES}
    shown = lambda m: F.coalesce(format_minor(r[f"{m}_amount_minor"]), F.lit("-"))
    marks = F.array_compact(F.array(F.when(other, F.concat(F.lit("model: number from the file name replaced ("), F.coalesce(r["invoice_number"], F.lit("-")), F.lit(")"))), F.when(swap, F.concat(F.lit("model: inconsistent amounts replaced (net "), shown("net"), F.lit(", tax "), shown("vat"), F.lit(", gross "), shown("gross"), F.lit(")")))))
    kept = F.filter(r["warnings"], lambda w: ~(better & (w == FILENAME_NUMBER)))
    fields["warnings"] = F.concat(kept, F.array_except(F.concat(marks, F.col("notes")), kept))
    after = F.struct(*[(fields[c] if c in fields else r[c]).alias(c) for c in COLUMNS])
    rows = cut(rows.select("content_hash", "_h", "r", "problems", after.alias("n"), F.col("answer").isNotNull().alias("_answered"), F.col("payload").isNotNull().alias("_paid")))
    n = F.col("n")
    wrong = F.coalesce(n["net_amount_minor"] + n["vat_amount_minor"] != n["gross_amount_minor"], F.lit(False))
    problem = F.when(~F.col("_paid"), "no payload").when(F.size("problems") > 0, F.array_join("problems", "; ")).when(missing_core_fields("n."), "core fields are missing").when(wrong, "amounts do not add up")
    changed = ~n.eqNullSafe(r)
    outcome = F.when(~F.col("_answered"), "transient").when(problem.isNotNull(), "rejected").when(changed, "applied").otherwise("unchanged")
    rows = rows.withColumn("problem", problem).withColumn("outcome", F.when(F.col("_h").isNotNull(), outcome))
    mark = F.lit(f"{MODEL_PREFIX}{model}{MODEL_SUFFIX}")
    done = F.struct(*[(F.concat(F.array_remove(n["warnings"], mark), F.array(mark)) if c == "warnings" else n[c]).alias(c) for c in COLUMNS])
    out = rows.select(F.when(F.col("outcome") == "applied", done).otherwise(r).alias("x")).select("x.*")
    detail = F.when(F.col("outcome") == "rejected", F.col("problem"))
    return out, rows.where("outcome is not null").select("content_hash", "outcome", detail.alias("detail")).distinct()


def ask(queue: DataFrame, enrich: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``content_hash, answer`` of every queued record: the hook where a model is called, on Arrow batches in the tasks.

    ``enrich`` gives a batch of the same columns for each; an answer that could not be had is null.
    """
    return queue.mapInArrow(enrich, "content_hash string, answer string")
