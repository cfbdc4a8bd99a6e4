"""Invoice numbers, tax ids and references as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from triweave.schema import OWN_TAX_ID

# Words that are never a number.
NOT_NUMBERS = ("ZOSTA", "ZOSTAŁA", "VAT", "FOR", "INVOICE", "NUMBER", "DATE", "DUE", "FAKTURY", "FAKTURA", "NUMER", "PODSTAWOWA", "SYSTEM", "KSEF")
TAX_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def _separated(x: Column) -> Column:
    """Upper case, with slashes for characters other than ``A-Za-z0-9``; patterns, which cost ten times as much, only where others than ASCII are."""
    plain = F.translate(x, _LOWER + _BREAKS, _UPPER + "/" * len(_BREAKS))
    return F.when(F.octet_length(x) == F.length(x), plain).otherwise(F.upper(F.regexp_replace(x, "[^A-Za-z0-9]+", "/")))


def canonical_number(x: Column) -> Column:
    """Tokens split at separators and letter/digit borders, upper case, no leading zeros, joined by ``/``."""
    borders = F.regexp_replace(x, "[^A-Za-z0-9]+|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "/")
    rewritten = F.regexp_replace(F.btrim(F.upper(borders), F.lit("/")), "(^|/)0+([0-9])", "$1$2")
    return F.when(x.rlike("[A-Za-z][0-9]|[0-9][A-Za-z]|(?<![A-Za-z0-9])0"), rewritten).otherwise(F.array_join(raw_tokens(x), "/"))


def known_number(x: Column) -> Column:
    """The canonical number, null where it has no characters; it is worked out once, as it would not be to compare it with nothing."""
    return F.when(x.rlike("[A-Za-z0-9]"), canonical_number(x))


def raw_tokens(x: Column) -> Column:
    """Tokens at the written separators only, upper case."""
    return F.array_remove(F.split(_separated(x), "/"), "")


def alnum_length(x: Column) -> Column:
    return F.length(F.translate(_separated(x), "/", ""))


def token_contains(a: Column, b: Column) -> Column:
    """The shorter token list is a contiguous run of the longer; a and b are token arrays."""
    inside = lambda short, long: (F.size(short) > 0) & (F.instr(F.concat(F.lit("/"), F.array_join(long, "/"), F.lit("/")), F.concat(F.lit("/"), F.array_join(short, "/"), F.lit("/"))) > 0)
    return F.when(F.size(a) <= F.size(b), inside(a, b)).otherwise(inside(b, a))


def clean_number(x: Column) -> Column:
    return F.upper(F.translate(F.regexp_replace(F.trim(x), "^[:#.,]+|[:#.,]+$", ""), "_", "/"))


def is_valid_number(x: Column) -> Column:
    t = F.trim(x)
    return F.coalesce((F.length(t) >= 3) & t.rlike("[0-9]") & ~t.isin(*NOT_NUMBERS), F.lit(False))


def looks_like_filename(x: Column) -> Column:
    return F.upper(F.trim(x)).rlike("[.](PDF|XML|JPG|JPEG|PNG)$")


def number_from_filename(path: Column) -> Column:
    """Number in a file name, after an attachment prefix is taken off; four patterns in order."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*?)([.][^./]*)?$", 1), "^[0-9A-Fa-f]{12,}_[0-9]+_", "")
    found = [
        clean_number(F.nullif(F.regexp_extract(stem, p, 1), F.lit("")))
        for p in ("(?i)Invoice-([A-Z0-9-]+)", "(?i)Faktura[_-]([A-Z0-9/-]+)", "(?i)RYANAIR[_-]([0-9-]+[_-]IE)", r"(?i)(?:fv|faktura|invoice)?[_\-\s]*([A-Z0-9]{1,8}[/_-][A-Z0-9/_-]{2,})")
    ]
    return F.coalesce(*[F.when(~x.isin("INVOICE", "FAKTURA"), x) for x in found])


def norm_tax_id(x: Column) -> Column:
    d = F.regexp_replace(x, "[^0-9]", "")
    return F.when(x.rlike(r"^[0-9]{10}\z"), x).otherwise(F.when(F.length(d) == 10, d))  # most are written plainly


def tax_id_checksum(x: Column) -> Column:
    """Ten digits whose weighted sum modulo 11 is the last one."""
    total = sum((F.substring(x, k + 1, 1).try_cast("int") * w for k, w in enumerate(TAX_WEIGHTS)), F.lit(0))
    return F.coalesce((F.length(x) == 10) & (total % 11 == F.substring(x, 10, 1).try_cast("int")), F.lit(False))


def counterparty_ids(seller: Column, buyer: Column, own: str = OWN_TAX_ID) -> Column:
    return F.array_except(F.array(norm_tax_id(seller), norm_tax_id(buyer)), F.array(F.lit(own), F.lit(None).cast("string")))


def norm_reference(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def reference_from_text(text: Column) -> Column:
    """Registry reference in a text."""
    shape = "[0-9]{10}-[0-9]{8}-[A-Z0-9]{10,}-[A-Z0-9]{2}"
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i)(?:Nr\s*KSeF|Numer\s+w\s*KSeF|KSeF)[\s:#\-]*({shape})", 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"\b({shape})\b", 1), F.lit("")))
