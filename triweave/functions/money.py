"""Money and currency as Column expressions; minor units, decimal arithmetic, halves away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CURRENCIES = ("PLN", "EUR", "USD", "GBP", "CHF", "CZK", "SEK", "NOK", "DKK")


def decimal_to_minor(x: Column) -> Column:
    """Machine decimal text of any scale, exponents allowed; null if it is none or too large."""
    return F.round(F.trim(x).try_cast("decimal(38,10)") * 100).try_cast("bigint")


def local_money_to_minor(x: Column) -> Column:
    """``1.234,56``, ``1,234.56``, ``1 234,56``; a lone separator before three digits groups thousands."""
    s = F.regexp_replace(x, "[^0-9,.-]", "")
    negative, body = s.startswith("-"), F.regexp_replace(s, "^-", "")
    commas, dots = (F.length(body) - F.length(F.translate(body, c, "")) for c in ",.")
    comma_last = F.instr(F.reverse(body), ",") < F.instr(F.reverse(body), ".")
    only_digits = F.regexp_replace(body, "[^0-9]", "")
    point = lambda sep: F.concat(F.regexp_replace(F.substring_index(body, sep, 1), "[^0-9]", ""), F.lit("."), F.substring_index(body, sep, -1))
    grouped = body.rlike("^[1-9][0-9]{0,2}([.][0-9]{3})+$") | body.rlike("^[1-9][0-9]{0,2}(,[0-9]{3})+$")
    number = (
        F.when(body.contains("-") | ~body.rlike("[0-9]"), None)
        .when((commas > 0) & (dots > 0) & comma_last, F.when(commas == 1, point(",")))
        .when((commas > 0) & (dots > 0), F.when(dots == 1, point(".")))
        .when((commas == 0) & (dots == 0), body)
        .when(grouped, only_digits)
        .when(commas == 1, point(","))
        .when(dots == 1, point("."))
    )
    return decimal_to_minor(F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), number))


def json_money(x: Column) -> Column:
    """A number, or an object with ``value``, read as text."""
    return decimal_to_minor(F.coalesce(F.get_json_object(x, "$.value"), x))


def norm_currency(x: Column) -> Column:
    code = F.upper(F.regexp_extract(x, rf"(?iU)\b({'|'.join(CURRENCIES)})\b", 1))
    low = F.lower(x)
    return F.when(F.trim(x) == "", None).otherwise(
        F.when(code != "", code)
        .when(low.contains("€") | x.rlike(r"(?iU)\beuro\b"), "EUR")
        .when(low.contains("zł") | x.rlike(r"(?iU)\bzl\b|\bz[lł]ot(?:y|ych|e)?\b"), "PLN")
        .when(x.contains("$") | x.rlike(r"(?iU)\bdol(?:ar|lars?)\b"), "USD")
        .when(x.contains("£") | x.rlike(r"(?iU)\b(?:gbp|pound|funt)\b"), "GBP")
        .when(x.rlike(r"(?iU)\bfrank(?:a|ów)?\b"), "CHF")
    )


def plain_currency(x: Column) -> Column:
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def currency_conflict(a: Column, b: Column) -> Column:
    return F.coalesce(plain_currency(a) != plain_currency(b), F.lit(False))


def near_gross(a: Column, b: Column) -> Column:
    """Both known, neither zero, at most two minor units apart."""
    return F.coalesce((a != 0) & (b != 0) & (F.abs(a - b) <= 2), F.lit(False))


def amounts_inconsistent(net: Column, vat: Column, gross: Column) -> Column:
    return (
        F.when(net.isNotNull() & vat.isNotNull() & gross.isNotNull(), F.coalesce(F.try_add(net, vat) != gross, F.lit(True)))
        .when(net.isNotNull() & vat.isNull() & (net >= 0) & (gross >= 0), net > gross)
        .when(net.isNull() & vat.isNotNull() & (vat >= 0) & (gross >= 0), vat > gross)
        .otherwise(F.lit(False))
    )


def format_minor(x: Column) -> Column:
    """``units.cc``; truncating division, so amounts between -0.99 and -0.01 lose their sign."""
    units = F.when(x < 0, -F.floor(-x / 100)).otherwise(F.floor(x / 100)).cast("bigint")
    return F.format_string("%d.%02d", units, F.abs(x) % 100)
