"""Record-level expressions over invoice columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triweave.functions.money import amounts_inconsistent
from triweave.functions.numbers import is_valid_number, looks_like_filename, norm_tax_id
from triweave.schema import OWN_TAX_ID

FILENAME_NUMBER = "numer faktury odczytany z nazwy pliku"
OVERRIDE_PREFIX = "override"
# Headings that stand where a party's name should, and names that tell nothing.
PLACEHOLDERS = ("", "nabywca", "sprzedawca", "wystawca", "odbiorca", "kupujący", "kupujacy", "buyer", "seller", "supplier", "customer", "bill to", "details", "supplier details", "customer details", "seller details", "buyer details", "brak identyfikatora")
USELESS = ("nabywca", "buyer", "sprzedawca", "seller", "kontrahent", "contractor", "customer", "klient", "odbiorca", "supplier", "vendor", "wystawca", "dostawca")
WEIGHTS = {"ksef_reference": 16, "invoice_number": 8, "seller_tax_id": 2, "buyer_tax_id": 2, "seller_name": 1, "buyer_name": 1, "issue_date": 2, "sale_date": 1, "due_date": 1, "gross_amount_minor": 2, "net_amount_minor": 1, "vat_amount_minor": 1, "currency": 1, "source_path": 1}


QUALITY_FIELDS = ("invoice_number", "issue_date", "gross_amount_minor", "currency", "seller_tax_id", "buyer_tax_id", "seller_name", "buyer_name")
OWN_ID_MARKS = {"found": "own id: found", "not_found": "own id: not found in the text, check before upload", "unreadable": "own id: text unreadable, check before upload", "not_checked": "own id: not checked"}
PASSWORD_PREFIX = "PDF with a password"
RETRY_PREFIXES = ("PDF text failed", "PDF without text", "OCR failed", "OCR not available", "read error")
UNREADABLE_PREFIX = RETRY_PREFIXES[0]
PARSER_PREFIX = "parser:"
MODEL_PREFIX, MODEL_SUFFIX = "model ", ": applied"
ENRICHED_MARKS = ("metadata", "enriched from registry", "enriched from document")
NO_NUMBER = "no number yet"


def is_placeholder(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"^[\s:\-]+|[\s:\-]+$", ""), r"\s+", " ")).isin(*PLACEHOLDERS)


def is_useful_name(name: Column) -> Column:
    t = F.trim(name)
    return F.coalesce((F.length(t) >= 3) & t.rlike(r"\p{L}") & ~F.lower(F.regexp_replace(t, "[^A-Za-z0-9]", "")).isin(*USELESS), F.lit(False))


def useful_party(name: Column) -> Column:
    t = F.trim(name)
    return F.when((t != "") & ~is_placeholder(t), t)


def completeness(prefix: str = "") -> Column:
    """Weighted count of known fields."""
    return sum((F.col(f"{prefix}{c}").isNotNull().cast("int") * w for c, w in WEIGHTS.items()), F.lit(0))


def has_warning(warnings: Column, text: str) -> Column:
    return F.array_contains(warnings, text)


def has_override(source: Column, warnings: Column) -> Column:
    return (source == "saldeo") & F.exists(warnings, lambda w: w.startswith(OVERRIDE_PREFIX))


def missing_hard_fields(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    return amounts_inconsistent(c("net_amount_minor"), c("vat_amount_minor"), c("gross_amount_minor")) | ~is_valid_number(c("invoice_number")) | has_warning(c("warnings"), FILENAME_NUMBER) | c("issue_date").isNull() | c("gross_amount_minor").isNull()


def missing_core_fields(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    bad = lambda n: F.coalesce(is_placeholder(c(n)), F.lit(False))
    return (
        amounts_inconsistent(c("net_amount_minor"), c("vat_amount_minor"), c("gross_amount_minor"))
        | c("invoice_number").isNull() | c("issue_date").isNull() | c("gross_amount_minor").isNull() | c("currency").isNull()
        | (c("seller_name").isNull() & c("buyer_name").isNull()) | bad("seller_name") | bad("buyer_name")  # noqa: E501
    )


def clean_name(x: Column) -> Column:
    """First line without punctuation around it, single blanks; three bytes at least and not only digits."""
    line = F.regexp_replace(F.trim(F.substring_index(x, "\n", 1)), r"^[:,;|-]+|[:,;|-]+$", "")
    out = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    return F.when((F.octet_length(out) >= 3) & ~out.rlike("^[0-9]*$"), out)


def number_guessed(p: str = "") -> Column:
    return has_warning(F.col(f"{p}warnings"), FILENAME_NUMBER)


def quality(p: str = "") -> Column:
    """Known fields of eight; a number counts only if it was read from the document."""
    c = lambda n: F.col(p + n)
    known = [c("invoice_number").isNotNull() & ~number_guessed(p), *[c(f).isNotNull() for f in QUALITY_FIELDS[1:]]]
    return sum((k.cast("int") for k in known), F.lit(0))


def any_prefix(warnings: Column, *prefixes: str) -> Column:
    return F.exists(warnings, lambda w: F.array_max(F.array(*[F.lower(w).startswith(p.lower()).cast("int") for p in prefixes])) == 1)


def is_model_mark(w: Column) -> Column:
    return w.startswith(MODEL_PREFIX) & w.endswith(MODEL_SUFFIX)


def password_protected(p: str = "") -> Column:
    return any_prefix(F.col(f"{p}warnings"), PASSWORD_PREFIX)


def unreadable(p: str = "") -> Column:
    return any_prefix(F.col(f"{p}warnings"), UNREADABLE_PREFIX)


def needs_retry(p: str = "") -> Column:
    return any_prefix(F.col(f"{p}warnings"), *RETRY_PREFIXES)


def own_id_status(warnings: Column) -> Column:
    """found, not_found, unreadable or not_checked, by the last mark."""
    back = F.map_from_arrays(F.array(*[F.lit(v) for v in OWN_ID_MARKS.values()]), F.array(*[F.lit(k) for k in OWN_ID_MARKS]))
    marks = F.filter(warnings, lambda w: w.isin(*OWN_ID_MARKS.values()))
    return F.coalesce(back[F.get(marks, F.size(marks) - 1)], F.lit("not_checked"))


def user_warnings(warnings: Column) -> Column:
    """Warnings for people: no versions, marks of origin, corrections or checks that found nothing wrong."""
    inner = lambda w: (F.trim(w) == "") | w.isin(OWN_ID_MARKS["found"], OWN_ID_MARKS["not_checked"], *ENRICHED_MARKS) | w.startswith(PARSER_PREFIX) | w.startswith(OVERRIDE_PREFIX) | is_model_mark(w)
    return F.filter(warnings, lambda w: ~inner(w))


def has_invoice_signal(p: str = "") -> Column:
    c = lambda n: F.col(p + n)
    # Words of invoice mail.
    word = lambda x: F.coalesce(x.rlike(r"(?iU)(invoice|faktura|faktury|rachunek|proforma|\bfv\b|ksef|billing@)"), F.lit(False))
    known = [c(f).isNotNull() for f in ("seller_tax_id", "buyer_tax_id", "ksef_reference", "gross_amount_minor")]
    out = is_valid_number(c("invoice_number"))
    for k in (*known, *[word(c(f)) for f in ("source_path", "email_subject", "email_from")]):
        out = out | k
    return out


def needs_paid_enrichment(p: str = "") -> Column:
    return ~password_protected(p) & has_invoice_signal(p) & missing_hard_fields(p)


def has_counterparty(p: str = "") -> Column:
    """A useful name on either side, and no useless one."""
    s, b = F.col(f"{p}seller_name"), F.col(f"{p}buyer_name")
    suspicious = lambda x: x.isNotNull() & ~is_useful_name(x)
    return (is_useful_name(s) | is_useful_name(b)) & ~suspicious(s) & ~suspicious(b)


def needs_document(p: str = "") -> Column:
    """A ledger record that its document may complete: no number of its own, no date, no amount or no counterparty."""
    number = F.col(f"{p}invoice_number")
    return number.isNull() | looks_like_filename(number) | F.col(f"{p}issue_date").isNull() | F.col(f"{p}gross_amount_minor").isNull() | ~has_counterparty(p)


def ledger_document_id(content_hash: Column) -> Column:
    return F.regexp_extract(content_hash, "^saldeo:([0-9]+)$", 1).try_cast("bigint")


def counterparty_name(own_name: Column, p: str = "", own: str = OWN_TAX_ID) -> Column:
    """The other party's name; ``own_name`` tells whether a name is the own company's."""
    seller, buyer = useful_party(F.col(p + "seller_name")), useful_party(F.col(p + "buyer_name"))
    is_own = lambda n: F.coalesce(F.lower(n).contains(own_name), F.lit(False))
    other = lambda n: F.when(~is_own(n), n)
    own_seller = F.coalesce(norm_tax_id(F.col(p + "seller_tax_id")) == own, F.lit(False)) | is_own(seller)
    return F.coalesce(F.when(own_seller, other(buyer)), other(seller), other(buyer), F.lit("-"))


def truncate_text(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def content_type(path: Column) -> Column:
    # Fixed values.
    kinds = {"pdf": "application/pdf", "xml": "application/xml", "json": "application/json", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
    table = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return F.coalesce(table[F.lower(F.regexp_extract(path, "[.]([^./]*)$", 1))], F.lit("application/octet-stream"))


def sanitize_filename(x: Column) -> Column:
    """Characters outside ``A-Za-z0-9.-_`` become ``_``; at most 180 characters, the extension kept."""
    s = F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]", "_"), "^_+|_+$", "")
    ext = F.regexp_extract(s, "([.][^.]{1,20})$", 1)
    return F.when(F.length(s) > 180, F.concat(F.substring(s, F.lit(1), 180 - F.length(ext)), ext)).otherwise(s)
