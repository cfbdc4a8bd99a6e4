"""Invoice records read from texts, XML and JSON documents.

One Arrow stage reads each document once, whatever its kind, and cuts out the fields as text: texts by ``reading`` and
``parties``, XML by its tags, JSON by its keys. Columns then parse what was cut out. All readers take time in proportion
to the document and none recurses into it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triweave.functions.dates import document_date_order, parse_date, parse_text_date
from triweave.functions.money import amounts_inconsistent, decimal_to_minor, local_money_to_minor, norm_currency
from triweave.functions.numbers import clean_number, number_from_filename, reference_from_text
from triweave.functions.records import FILENAME_NUMBER, OWN_ID_MARKS, clean_name, missing_core_fields, quality
from triweave.operators import reading
from triweave.operators.parties import Page
from triweave.schema import COLUMNS, OWN_TAX_ID, conform

AMBIGUOUS_DATE = "ambiguous date"
READ_AS_TEXT = "JSON read as text"
# How an amount is written.
LOCAL, MACHINE, NUMBER = 0, 1, 2
# Tags of an XML invoice, and keys of a JSON invoice as lower-case letters and digits of their whole path.
XML_PARTIES = {"seller": ("Podmiot1", "Seller", "Sprzedawca"), "buyer": ("Podmiot2", "Buyer", "Nabywca")}
XML_PARTY = {"id": ("NIP", "TaxId", "VATID", "VatId"), "name": ("Nazwa", "Name", "FullName")}
XML_TAGS = {
    "number": ("P_2", "NumerFaktury", "InvoiceNumber", "NrFaktury", "number"), "issue": ("P_1", "DataWystawienia", "IssueDate"), "sale": ("P_6", "DataSprzedazy", "SaleDate"),
    "due": ("TerminPlatnosci", "DueDate", "PaymentDueDate"), "currency": ("KodWaluty", "Currency"), "reference": ("NrKSeF", "KsefNumber", "ReferenceNumber"),
}
XML_AMOUNTS = {"gross": ("P_15", "KwotaNaleznosciOgolna", "GrossAmount", "totalGross"), "net": ("NetAmount", "totalNet"), "vat": ("VatAmount", "totalVat")}
RATES = {"net": "P_13", "vat": "P_14"}
JSON_KEYS = {
    "number": ("invoicenumber", "number", "numerfaktury", "p2"), "issue": ("issuedate", "datawystawienia", "p1"), "sale": ("saledate", "datasprzedazy", "p6"), "due": ("duedate", "paymentduedate", "terminplatnosci"),
    "seller_id": ("sellertaxid", "sellernip", "podmiot1nip", "sprzedawcanip"), "buyer_id": ("buyertaxid", "buyernip", "podmiot2nip", "nabywcanip"), "seller_name": ("sellername", "podmiot1nazwa", "sprzedawcanazwa"), "buyer_name": ("buyername", "podmiot2nazwa", "nabywcanazwa"),
    "currency": ("currency", "kodwaluty"), "reference": ("ksefreference", "nrksef", "ksefnumber", "referencenumber"), "message_id": ("emailmessageid", "messageid", "id"), "subject": ("emailsubject", "subject"), "sender": ("emailfrom", "from"),
}
JSON_AMOUNTS = {"gross": ("grossamount", "totalgross", "kwotabrutto", "p15"), "net": ("netamount", "totalnet"), "vat": ("vatamount", "totalvat")}
NO_KEY = re.compile("[^A-Za-z0-9]")
RATE_NAME = re.compile("P_1[34]_[0-9]+(?:_[0-9]+)*", re.I)
TAG = re.compile(r"<(/?)(?:[A-Za-z0-9_\-]+:)?([A-Za-z0-9_\-]+)(?:\s[^<>]*)?>")
INNER = re.compile(r"<!\[CDATA\[|\]\]>|<[^<>]+>")

TEXTS = ("number", "seller_id", "buyer_id", "seller_name", "buyer_name", "issue", "sale", "due", "currency", "reference", "message_id", "subject", "sender")
#: Amount fields; the rates stand in for a sum that is not written, in XML the other way round.
AMOUNTS = ("gross", "net", "vat", "net_other", "vat_other")
FIELDS = pa.struct([("kind", pa.string()), *((c, pa.string()) for c in TEXTS), ("amounts", pa.list_(pa.struct([("field", pa.string()), ("text", pa.string()), ("form", pa.int32())])))])
FIELDS_DDL = f"struct<kind:string,{','.join(f'{c}:string' for c in TEXTS)},amounts:array<struct<field:string,text:string,form:int>>>"


def amounts(field: str, texts: list[str | None], form: int) -> list[dict]:
    return [{"field": field, "text": x, "form": form} for x in texts if x is not None]


def read_text(text: str, kind: str = "text") -> dict:
    t, page = reading.Text(text), Page(text)
    table = reading.table_columns(t)
    out = {"kind": kind, "number": reading.invoice_number(t), "currency": reading.currency(t)}
    out["issue"] = reading.labelled_date(t, reading.ISSUE_LABELS) or reading.first_date(t)
    out |= {"sale": reading.labelled_date(t, reading.SALE_LABELS), "due": reading.labelled_date(t, reading.DUE_LABELS)}
    labels = {"gross": reading.GROSS_LABELS, "net": reading.NET_LABELS, "vat": reading.VAT_LABELS}
    out["amounts"] = [x for name, some in labels.items() for x in amounts(name, [reading.labelled_amount(t, some, table)], LOCAL)]
    out["seller_id"], out["buyer_id"] = page.parties()
    out |= {"seller_name": page.name("seller"), "buyer_name": page.name("buyer")}
    return out | {"message_id": reading.header(t, "Message-ID"), "subject": reading.header(t, "Subject"), "sender": reading.header(t, "From")}


class Tags:
    """Places of the tags of an XML text by lower-case name, namespaces left out."""

    def __init__(self, text: str):
        self.text = text
        self.opens: dict[str, list[int]] = {}
        self.closes: dict[str, list[int]] = {}
        for m in TAG.finditer(text):
            name = m[2].lower()
            if m[1]:
                self.closes.setdefault(name, []).append(m.start())
            else:
                self.opens.setdefault(name, []).append(m.end())

    def content(self, name: str) -> str | None:
        """What the first element of a name holds, up to the first end of that name."""
        start = self.opens.get(name.lower(), [None])[0]
        ends = self.closes.get(name.lower(), [])
        at = bisect_left(ends, start) if start is not None else len(ends)
        return self.text[start : ends[at]] if at < len(ends) else None

    def plain(self, *names: str) -> str | None:
        """Text of the first name that occurs, marks and inner tags left out."""
        found = next((x for n in names if (x := self.content(n)) is not None), None)
        return None if found is None else INNER.sub("", found).strip()

    def rates(self, prefix: str) -> list[str]:
        """Texts of the rate fields ``prefix_1, prefix_2, prefix_6_1 ...``, each name once, in order of place."""
        first = sorted((at[0], name) for name, at in self.opens.items() if RATE_NAME.fullmatch(name) and name.startswith(prefix.lower()))
        return [x for at, _ in first if (end := self.text.find("<", at)) >= 0 and (x := self.text[at:end])]


def tax_id(x: str | None) -> str | None:
    digits = "".join(c for c in x or "" if c in "0123456789")
    return digits if len(digits) == 10 else None


def read_xml(text: str) -> dict:
    tags, ids = Tags(text), [d for d, *_ in Page(text).ids]
    out = {"kind": "xml"} | {c: tags.plain(*names) for c, names in XML_TAGS.items()}
    for k, (side, names) in enumerate(XML_PARTIES.items()):
        party = Tags(next((x for n in names if (x := tags.content(n))), ""))
        out[f"{side}_id"] = tax_id(party.plain(*XML_PARTY["id"])) or (ids[k] if k < len(ids) else None)
        out[f"{side}_name"] = party.plain(*XML_PARTY["name"])
    out["amounts"] = [x for name, names in XML_AMOUNTS.items() for x in amounts(f"{name}_other" if name in RATES else name, [tags.plain(*names)], MACHINE)]
    out["amounts"] += [x for name, prefix in RATES.items() for x in amounts(name, tags.rates(prefix), MACHINE)]
    return out


class Number(str):
    """A JSON number as written."""


def leaves(value: object) -> Iterator[tuple[str, str, str, bool]]:
    """``path, name, value, number`` of every leaf, however deep; ``number``: it is no text."""
    open_ = [("", "", value)]
    while open_:
        path, name, value = open_.pop()
        if isinstance(value, dict | list):
            items = value.items() if isinstance(value, dict) else enumerate(value)
            open_ += reversed([(f"{path}.{k}" if path else str(k), str(k), v) for k, v in items])
        elif value is not None:
            yield path, name, value if isinstance(value, str) else str(value).lower(), not isinstance(value, str) or isinstance(value, Number)


def read_json(text: str) -> dict:
    """Fields by the path of their keys; of several places the first by path. What is no JSON is read as text."""
    try:
        found = list(leaves(json.loads(text, parse_float=Number, parse_int=Number)))
    except (ValueError, RecursionError):
        return read_text(text, "json_text")
    by_key: dict[str, list[tuple[str, str, bool]]] = {}
    rates: dict[str, tuple[str, str, bool]] = {}
    for path, name, value, number in found:
        by_key.setdefault(NO_KEY.sub("", path).lower(), []).append((path, value, number))
        if RATE_NAME.fullmatch(name):
            rates[name.upper()] = min(rates.get(name.upper(), (path, value, number)), (path, value, number))
    amount = lambda field, x: amounts(field, [x[1]], NUMBER if x[2] else LOCAL)
    out = {"kind": "json"}
    for field, keys in JSON_KEYS.items():
        out[field] = next((min(some)[1] for k in keys if (some := [x for x in by_key.get(k, ()) if x[1].strip()])), None)
    out["amounts"] = [x for field, keys in JSON_AMOUNTS.items() for x in next((amount(field, min(by_key[k])) for k in keys if k in by_key), [])]
    out["amounts"] += [x for name, prefix in RATES.items() for n, rate in sorted(rates.items()) if n.startswith(prefix) for x in amount(f"{name}_other", rate)]
    ids = [d for d, *_ in Page(text).ids]
    for k, side in enumerate(("seller", "buyer")):
        out[f"{side}_id"] = tax_id(out[f"{side}_id"]) or (ids[k] if k < len(ids) else None)
    return out


READERS = {"xml": read_xml, "json": read_json}


def fields_of(kind: Column, text: Column) -> Column:
    """The fields of a document as text; ``kind``: xml, json, or anything else for text."""

    @F.arrow_udf(FIELDS_DDL)
    def read(kind: pa.Array, text: pa.Array) -> pa.Array:
        rows = [READERS.get(k, read_text)(t or "") for k, t in zip(kind.to_pylist(), text.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in FIELDS], fields=list(FIELDS))

    return read(kind, text)


def parsed_amounts(parts: Column) -> Column:
    """``field, minor`` of every amount that can be read."""
    number = lambda x: F.coalesce(F.when(x["form"] != LOCAL, decimal_to_minor(x["text"])), F.when(x["form"] != NUMBER, local_money_to_minor(x["text"])))
    return F.filter(F.transform(parts, lambda x: F.struct(x["field"].alias("field"), number(x).alias("minor"))), lambda x: x["minor"].isNotNull())


def amount_of(parsed: Column, field: str) -> Column:
    """Sum of a field's amounts; null if there is none."""
    own = F.filter(parsed, lambda x: x["field"] == field)
    return F.when(F.size(own) > 0, F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: F.try_add(s, x["minor"])))


def own_id_check(text: Column, own: str = OWN_TAX_ID) -> Column:
    """found, not_found or unreadable: the own id stands alone in the text, whatever spaces and dashes are inside.

    References begin with an id and are left out; digits joined by dots or dashes are parts of a longer id.
    """
    folded = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s", " "), "[‐-―−﹣－]", "-")
    plain = F.regexp_replace(folded, r"(?i)\b[0-9]{10} *- *[0-9]{8} *- *[A-Z0-9]{10,} *- *[A-Z0-9]{2}\b", " ")
    digits = "[ .-]*".join(own)
    alone = rf"(?iU)(?<![\p{{L}}\p{{N}}_])(?<![0-9][ .\-]{{0,9}}[.\-][ .\-]{{0,9}})(?:NIP[ :]*(?:PL *)?|PL *)?{digits}(?![\p{{L}}\p{{N}}_])(?![ .\-]*[.\-][ .\-]*[0-9])"
    return F.when(F.trim(folded) == "", "unreadable").when(plain.rlike(alone), "found").otherwise("not_found")


def with_own_check(warnings: Column, check: Column) -> Column:
    """Warnings with the mark of this check in place of an earlier one."""
    marks = F.create_map(*[F.lit(x) for kv in OWN_ID_MARKS.items() for x in kv])
    return F.concat(F.filter(warnings, lambda w: ~w.isin(*OWN_ID_MARKS.values())), F.array(marks[check]))


def read(docs: DataFrame, kind: Column, source: str, own: str) -> DataFrame:
    """Invoice records of ``content_hash, source_path, text`` rows; a number from the file name is marked as such."""
    raw = docs.select("content_hash", "source_path", F.coalesce("text", F.lit("")).alias("text"), kind.alias("_kind"))
    raw = raw.withColumn("f", fields_of(F.col("_kind"), F.col("text")))
    f, t = (lambda c: F.col(f"f.{c}")), F.col("text")
    is_text = f("kind").isin("text", "json_text")
    d = raw.select("content_hash", "source_path", "f", own_id_check(t, own).alias("_own"), is_text.alias("_text"), F.when(is_text, document_date_order(t)).alias("_order"),
        F.when(is_text, reference_from_text(t)).otherwise(F.trim(f("reference"))).alias("_ref"), F.nullif(clean_number(f("number")), F.lit("")).alias("_number"), number_from_filename(F.col("source_path")).alias("_named"))
    # Alike fields are parsed by one expression, as elements of a list.
    days = ("issue", "sale", "due")
    d = d.select("*", F.transform(F.array(*map(f, days)), lambda x: parse_text_date(x, F.col("_order"))).alias("_days"), F.transform(F.array(f("seller_name"), f("buyer_name")), clean_name).alias("_names"), parsed_amounts(f("amounts")).alias("_amounts"))
    day = lambda k, part: F.col("_days")[k][part]
    marks = [F.when(F.col("_text") & day(k, "alternative").isNotNull(), F.concat(F.lit(f"{AMBIGUOUS_DATE}: {n} date "), f(n), F.lit(" read as "), day(k, "date").cast("string"), F.lit(" (day first), may be "), day(k, "alternative").cast("string"))) for k, n in enumerate(days)]
    named = F.when(F.col("_number").isNull() & F.col("_named").isNotNull(), F.lit(FILENAME_NUMBER))
    as_text = F.when(f("kind") == "json_text", F.array(F.lit(READ_AS_TEXT))).otherwise(F.array().cast("array<string>"))
    amount = lambda *names: F.coalesce(*[amount_of(F.col("_amounts"), n) for n in names])
    return conform(
        d.select(
            F.lit(source).alias("source"), "source_path", "content_hash", F.coalesce("_number", "_named").alias("invoice_number"), f("seller_id").alias("seller_tax_id"), f("buyer_id").alias("buyer_tax_id"),
            *[F.col("_names")[k].alias(f"{n}_name") for k, n in enumerate(("seller", "buyer"))], *[day(k, "date").alias(f"{n}_date") for k, n in enumerate(days)],
            amount("gross").alias("gross_amount_minor"), amount("net", "net_other").alias("net_amount_minor"), amount("vat", "vat_other").alias("vat_amount_minor"),
            norm_currency(f("currency")).alias("currency"), F.col("_ref").alias("ksef_reference"), f("message_id").alias("email_message_id"), f("subject").alias("email_subject"), f("sender").alias("email_from"),
            F.concat(with_own_check(F.array_compact(F.array(*marks, named)), F.col("_own")), as_text).alias("warnings"),
        )
    )


def extract_text(docs: DataFrame, source: str = "mail", own: str = OWN_TAX_ID) -> DataFrame:
    """Invoice records of texts."""
    return read(docs, F.lit("text"), source, own)


def extract_xml(docs: DataFrame, source: str = "ksef", own: str = OWN_TAX_ID) -> DataFrame:
    """Invoice records of XML documents."""
    return read(docs, F.lit("xml"), source, own)


def extract_json(docs: DataFrame, source: str = "mail", own: str = OWN_TAX_ID) -> DataFrame:
    """Invoice records of JSON documents; what is no JSON is read as text.

    Keys are found at any depth by their path; numbers have a decimal point, texts may be in the local form. Rate
    fields are summed, each name once.
    """
    return read(docs, F.lit("json"), source, own)


def extract_documents(docs: DataFrame, source: str = "mail", own: str = OWN_TAX_ID) -> DataFrame:
    """Records of a mixed corpus, each document read by its extension."""
    return read(docs, F.lower(F.regexp_extract(F.coalesce("source_path", F.lit("")), "[.]([^./]*)$", 1)), source, own)


def better_reading(first: DataFrame, second: DataFrame) -> DataFrame:
    """Of two readings of a document (records by ``content_hash``) the second, unless it is worse or the first has all core fields.

    Consistent amounts come before the number of known fields.
    """
    a = first.select("content_hash", F.struct(*COLUMNS).alias("a"), missing_core_fields().alias("poor"), amounts_inconsistent(F.col("net_amount_minor"), F.col("vat_amount_minor"), F.col("gross_amount_minor")).alias("bad_a"), quality().alias("qa"))
    b = second.select("content_hash", F.struct(*COLUMNS).alias("b"), amounts_inconsistent(F.col("net_amount_minor"), F.col("vat_amount_minor"), F.col("gross_amount_minor")).alias("bad_b"), quality().alias("qb"))
    worse = (F.col("bad_b") & ~F.col("bad_a")) | ((F.col("bad_a") == F.col("bad_b")) & (F.col("qb") < F.col("qa")))
    pick = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & F.col("poor") & ~worse), F.col("b")).otherwise(F.col("a"))
    return a.join(b, "content_hash", "full_outer").select(pick.alias("r")).select("r.*")
