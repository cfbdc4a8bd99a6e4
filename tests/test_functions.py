import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from triweave.functions import dates, money, numbers, records


def values(spark, xs, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in xs], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_canonical_number_equals_tokenizer(spark):
    def plain(x):
        tokens = [t.upper() for t in re.findall("[A-Za-z]+|[0-9]+", x)]
        return "/".join((t.lstrip("0") or "0") if t.isdigit() else t for t in tokens)

    xs = ["FV12/2026", "FV/012/2026", "fv-12-2026", "1/1/2026", "11/2026", "000", "", "--", "A0B00", "FV/12/2026/A", "żółw 07"]
    assert values(spark, xs, numbers.canonical_number) == [plain(x) for x in xs]


def test_token_containment(spark):
    rows = [("FV/12/2026", "FV/12/2026/A", True), ("1/2026", "11/2026", False), ("FV/1", "FV/11", False), ("12/2026", "FV/12/2026", True), ("", "A", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select("want", numbers.token_contains(numbers.raw_tokens(F.col("a")), numbers.raw_tokens(F.col("b"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


@pytest.mark.parametrize(("x", "want"), [("-0.005", -1), ("1.005", 101), ("1.5e2", 15000), ("", None), ("abc", None), ("12", 1200), ("1e30", None)])
def test_decimal_to_minor(spark, x, want):
    assert values(spark, [x], money.decimal_to_minor) == [want]


@pytest.mark.parametrize(("x", "want"), [("1.234,56", 123456), ("1,234.56", 123456), ("1 234,56", 123456), ("1234,5", 123450), ("0.5", 50), ("1.234", 123400), ("1.2.3", None), ("-12,00", -1200), ("", None), (None, None), ("1,234,567", 123456700)])
def test_local_money(spark, x, want):
    assert values(spark, [x], money.local_money_to_minor) == [want]


def test_format_minor_truncates(spark):
    assert values(spark, [123456, -5, -150, 0], money.format_minor, "long") == ["1234.56", "0.05", "-1.50", "0.00"]


def test_currency(spark):
    assert values(spark, ["12 PLN", "5 €", "zł 3", "$5", "£", "franka", "", "xyz"], money.norm_currency) == ["PLN", "EUR", "PLN", "USD", "GBP", "CHF", None, None]


def test_dates(spark):
    xs = ["2026-03-05", "05.03.2026", "5-3-2026", "2026/03/05", "25/03/2026", "03/25/2026", "March 5, 2026", "Mar 5, 2026", "31/02/2026", "", None]
    d = dt.date
    assert values(spark, xs, dates.parse_date) == [d(2026, 3, 5)] * 4 + [d(2026, 3, 25)] * 2 + [d(2026, 3, 5)] * 2 + [None] * 3


def test_ambiguous_date_follows_order(spark):
    df = spark.createDataFrame([("03/04/2026", None), ("03/04/2026", "month_first"), ("03/04/2026", "day_first")], "x string, o string")
    got = [tuple(r[0]) for r in df.select(dates.parse_text_date(F.col("x"), F.col("o"))).collect()]
    april, march = dt.date(2026, 4, 3), dt.date(2026, 3, 4)
    assert got == [(april, march), (march, None), (april, None)]


def test_names_and_ids(spark):
    assert values(spark, ["Nabywca:", " bill  to ", "Acme", ""], records.is_placeholder) == [True, True, False, True]
    assert values(spark, ["klient", "ab", "123", "Acme", None], records.is_useful_name) == [False, False, False, True, False]
    assert values(spark, ["524-29-20-020", "12", None], numbers.norm_tax_id) == ["5242920020", None, None]
    assert values(spark, ["5242920020", "5242920021", "x"], numbers.tax_id_checksum) == [True, False, False]
    assert values(spark, ["a/0123456789ab_2_Faktura_12-2026.pdf", "scan.pdf"], numbers.number_from_filename)[0] == "12-2026"
