import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from triweave.functions import dates, records
from triweave.operators import extraction, parties, payloads
from triweave.schema import COLUMNS, INVOICE, conform


def read(spark, *texts, by=extraction.extract_text):
    df = spark.createDataFrame([(str(k), None, t) for k, t in enumerate(texts)], "content_hash string, source_path string, text string")
    return by(df).orderBy("content_hash").collect()


def test_amounts_stand_right_behind_their_label(spark):
    got = read(
        spark,
        "Subtotal: 10.00\nTotal: 12.30",
        "Do zapłaty do 2026-01-15: 12,50",
        "Amount due\n$ 45.00",
        "Payment terms: Net 30\nNet 14\nTotal 7.00 EUR",
        "NET  VAT  TOTAL\nitem\nTOTAL 100.00 23.00 123.00\nTotal: 5.00",
        "Net (EUR): 30\nTotal: 12345678901234567",
        None,
    )
    assert [(r.net_amount_minor, r.vat_amount_minor, r.gross_amount_minor) for r in got] == [(None, None, 1230), (None, None, None), (None, None, 4500), (None, None, 700), (10000, 2300, 12300), (3000, None, None), (None, None, None)]


def test_numbers_of_other_documents_come_last(spark):
    got = read(spark, "FV 123/2026", "Faktura korygująca nr FK/1/2026 do faktury nr FV/9/2025", "Credit note CN-77 for invoice INV-5", "dotyczy faktury nr FV/9/2025", "Invoice date 2026", "Invoice number: A_12")
    assert [r.invoice_number for r in got] == ["123/2026", "FK/1/2026", "INV-5", "FV/9/2025", None, "A/12"]


def test_date_order_of_a_document(spark):
    texts = ["on 25/03/2026 and 03/04/2026", "on 03/25/2026", "25/03/2026 and 03/25/2026", "March 4, 2026", "4 marca 2026", "FV/12/25/2026/A", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(dates.document_date_order(F.col("t")).alias("o")).collect()] == ["day_first", "month_first", None, "month_first", "day_first", None, None]
    us, eu, open_ = read(spark, "Issue date: 03/04/2026\n12/25/2026", "Issue date: 03/04/2026\n25/12/2026", "Issue date: 03/04/2026")
    assert (us.issue_date, eu.issue_date, open_.issue_date) == (dt.date(2026, 3, 4), dt.date(2026, 4, 3), dt.date(2026, 4, 3))
    assert [any(w.startswith(extraction.AMBIGUOUS_DATE) for w in r.warnings) for r in (us, eu, open_)] == [False, False, True]


def test_parties_by_section_and_column():
    two = "Seller:                    Buyer:\nAlpha Ltd                  Beta Ltd\nNIP 5250001234             NIP 5242920020"
    assert parties.party_ids(two) == ("5250001234", "5242920020") and parties.name_of("seller", two) == "Alpha Ltd" and parties.name_of("buyer", two) == "Beta Ltd"
    assert parties.party_ids("Bill to\nNIP 5242920020") == (None, "5242920020")
    assert parties.party_ids("NIP 5250001234\nNIP 5242920020") == ("5250001234", "5242920020")
    assert parties.party_ids("Buyer: NIP: 5242920020\nSeller:\nNIP 1234567890\nNIP 5261040828") == ("5261040828", "5242920020")  # the right checksum first
    assert parties.name_of("seller", "Gamma GmbH     Bill to\nDelta") == "Gamma GmbH" and parties.name_of("buyer", "") is None
    assert parties.name_of("seller", "Epsilon AG\nul. Prosta 1\nNIP 5250001234") == "Epsilon AG"


@pytest.mark.parametrize(
    ("text", "seller", "buyer"),
    [
        ("BUYER DETAILS\tSELLER DETAILS\nBeta Ltd\tAlpha Ltd", "Alpha Ltd", "Beta Ltd"),  # columns by tab, the other way round
        ("Seller: Alpha Ltd    Buyer: Beta Ltd", "Alpha Ltd", "Beta Ltd"),
        ("SELLER\nAlpha Ltd\nBUYER\nBeta Ltd", "Alpha Ltd", "Beta Ltd"),
        ("Seller:                    Buyer:\nAlpha Ltd\nNIP: 5250001234            NIP: 5242920020", "Alpha Ltd", None),  # an empty cell stays empty
        ("Seller:                    Buyer:\n                          Beta Ltd", None, "Beta Ltd"),
        ("Seller:\nBuyer:\nBeta Ltd", None, "Beta Ltd"),
        ("SELLER                     BUYER\nName:                      Name:\nAlpha Ltd                  VAT: PL5242920020\nVAT: IE12                  Beta Ltd", "Alpha Ltd", "Beta Ltd"),
        ("WYSTAWCA: Żółw Sp. z o.o.\nODBIORCA: Łoś i Ćma", "Żółw Sp. z o.o.", "Łoś i Ćma"),
        ("İİ Nabywca: Żółw", None, "Żółw"),  # lower case of other length moves nothing
        ("Resellers: Alpha\nCustomerology Ltd", None, None),
        ("Bill\nAlpha, Inc                      Bill to\n1 Main Street                   Beta Ltd\nUnited States                   Poland", "Alpha, Inc", "Beta Ltd"),
    ],
)
def test_names_in_their_columns(text, seller, buyer):
    assert (parties.name_of("seller", text), parties.name_of("buyer", text)) == (seller, buyer)


def test_ids_follow_the_page():
    a, b = "5252344078", "5242920020"
    for text in (f"Seller:\nVAT ID: PL{a}\nBuyer:\nNIP: {b}", f"Buyer: Beta NIP: {b} Seller: Alpha VAT ID: PL{a}", f"Buyer:            Seller:\nNIP: {b}   NIP: PL{a}", f"CUSTOMER\tSUPPLIER\nNIP: {b}\tVAT: PL{a}", f"Seller:\nCustomer number: 4\nPL {a}\nBuyer:\nNIP {b}"):
        assert parties.party_ids(text) == (a, b)
    assert parties.party_ids(f"Seller: Alpha\nNIP: {a}\nBuyer: Beta") == (a, None)
    assert parties.party_ids(f"Ask customer support\nNIP: {b}") == (None, b)
    assert parties.party_ids(f"Alpha, Inc                Bill to\n1 Street                  Beta\n                    PL VAT PL{b}") == (None, b)
    assert parties.tax_ids(f"VAT ID: PL{a}\nNIP: 524-292 00-20, NIP {a}") == [a, b]


def test_labels_are_asked_in_order_of_trust(spark):
    got = read(spark, "Kwota brutto: 100,00\nNET VAT TOTAL\nTOTAL 50.00 10.00 60.00", "Total: 12345678901234567,00\nBrutto: 7,00", "Total: 1 234 567,89 zł", "Total (EUR): 5\nTotal: 6", "vat 3,00 x\nVAT\n $ 4.00", "NET 1.00 VAT 2.00 TOTAL\nTOTAL:\n1.00\n2.00 3.00")
    assert [(r.net_amount_minor, r.vat_amount_minor, r.gross_amount_minor) for r in got] == [(5000, 1000, 10000), (None, None, 700), (None, None, 123456789), (None, None, 500), (None, 400, None), (100, 200, 300)]


LONG = ("nr numer ", "do faktury nr numer ", "1 111 ", "total: ", "7 ", "seller ", "NIP 5242920020 ", "net 1 111 111,00 ", "seller\tbuyer\tNIP 5242920020\n", "1,1,", "FV ", "kwota EUR ", "faktura vat korygująca nr ", "total\n", " ", "<a b", "<P_2>", '{"a":', "[")


def test_long_repetitive_documents_take_linear_time(spark):
    """A million characters each; every reader walks forward, and nothing recurses."""
    began = time.time()
    for piece in LONG:
        text = piece * (1_000_000 // len(piece))
        for reader in (extraction.read_text, extraction.read_xml, extraction.read_json):
            reader(text)
    assert time.time() - began < 3 * 10 * len(LONG)
    docs = [(str(k), f"{k}.{kind}", piece * (1_000_000 // len(piece))) for kind in ("txt", "xml", "json") for k, piece in enumerate(LONG)]
    assert extraction.extract_documents(spark.createDataFrame(docs, "content_hash string, source_path string, text string")).count() == len(docs)


def test_answers_of_a_million_characters(spark):
    big = "{" * 3 + '"' * 7
    answers = {
        "see " + payload(seller_name="x" * 1_000_000) + " so": payload(seller_name="x" * 1_000_000),
        '{"thought": {"a": {"b": "}"}}} then {"c": {"d": [1, {"e": "\\\""}]}} end': '{"c": {"d": [1, {"e": "\\\""}]}}',
        "{" * 1_000_000: None,
        "[" * 1_000_000: None,
        "{}" * 500_000: "{}",
        '{"a":1} {"b": NaN}': '{"a":1}',
        "<|channel>" * 100_000 + "final {}": "{}",
        "<|channel>final {1}<|channel>analysis {}": None,
        big * 100_000: None,
    }
    df = spark.createDataFrame(list(enumerate(answers)), "k int, a string")
    got = {r.k: r.p for r in df.select("k", payloads.payload_of(F.col("a")).alias("p")).collect()}
    assert got == dict(enumerate(answers.values()))


def test_own_id_alone_in_the_text(spark):
    texts = ["NIP: PL 524-292-00-20", "524 292 00 20", "x5242920020", "12-5242920020", "5242920020-20260101-ABCDEF123456-AA", "524–292–00–20", " \n", "1 5242920020 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(extraction.own_id_check(F.col("t")).alias("c")).collect()] == ["found", "found", "not_found", "not_found", "not_found", "found", "unreadable", "found"]


def test_xml_and_json_documents(spark):
    xml = '<a:F xmlns:a="u"><a:P_2>FV/1</a:P_2><P_1>2026-01-02</P_1><Seller><TaxId>525-000-12-34</TaxId><Name><![CDATA[A B]]></Name></Seller><P_13_1>100.00</P_13_1><P_13_1>9.00</P_13_1><P_13_6_1>1.50</P_13_6_1><P_14_1>23.00</P_14_1><P_14_1W>99.00</P_14_1W><P_15>124.5</P_15><Currency>eur</Currency></a:F>'
    (r,) = read(spark, xml, by=lambda d: extraction.extract_xml(d))
    assert (r.invoice_number, r.seller_tax_id, r.seller_name, r.net_amount_minor, r.vat_amount_minor, r.gross_amount_minor, r.currency) == ("FV/1", "5250001234", "A B", 10150, 2300, 12450, "EUR")
    js = json.dumps({"invoice_number": "x_1", "seller": {"nip": "5250001234", "name": "A"}, "buyer": {"name": "Be Co"}, "gross_amount": "1.234,56", "fa": [{"P_13_1": 10, "p_13_1": 3}, {"P_14_1": 2.5}], "due_date": None})
    r, other = read(spark, js, "Faktura nr FV/3/2026 {", by=lambda d: extraction.extract_json(d))
    assert (r.invoice_number, r.seller_tax_id, r.seller_name, r.buyer_name, r.gross_amount_minor, r.net_amount_minor, r.vat_amount_minor) == ("X/1", "5250001234", None, "Be Co", 123456, 1000, 250)
    assert other.invoice_number == "FV/3/2026" and "JSON read as text" in other.warnings
    assert extraction.extract_json(spark.createDataFrame([], "content_hash string, source_path string, text string")).count() == 0


def record(spark, *changes):
    base = {"source": "mail", "content_hash": "h", "invoice_number": "FV/1", "issue_date": dt.date(2026, 1, 2), "currency": "PLN", "seller_name": "Alpha", "warnings": []}
    return spark.createDataFrame([tuple((dict.fromkeys(COLUMNS) | base | {"content_hash": f"h{k}"} | c)[n] for n in COLUMNS) for k, c in enumerate(changes)], INVOICE)


def payload(**fields):
    return json.dumps(dict.fromkeys(payloads.FIELDS) | fields)


def test_payload_text_and_validation(spark):
    answers = ['x {"a":1} y {"b":{} ', '<|channel>thought {"t":1}<|channel>final {"f":2}', '<|channel>analysis {"t":1}<|channel>other {"o":3}', "none", None, '{"s":"}"} tail']
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [r.p for r in df.select(payloads.payload_of(F.col("a")).alias("p")).collect()] == ['{"a":1}', '{"f":2}', '{"o":3}', None, None, '{"s":"}"}']
    good = [payload(gross_amount="22,83", seller_tax_id="PL 526-104-08-28", buyer_tax_id="IE123"), payload(gross_amount="1.5"), payload(issue_date="2026-02-30"), payload(currency="pln"), payload(seller_name="Buyer:"), payload(seller_tax_id="1234567890"), '{"gross_amount": 1}', payload(due_date=" ")]
    out = payloads.normalised(spark.createDataFrame([(k, p) for k, p in enumerate(good)], "k int, payload string")).orderBy("k").collect()
    assert [len(r.problems) > 0 for r in out] == [False, True, True, True, True, True, True, True]
    assert (out[0].p_gross_amount, out[0].p_seller_tax_id, out[0].p_buyer_tax_id, len(out[0].notes)) == ("22.83", "5261040828", None, 3)


def test_payloads_fill_gaps_and_replace_only_what_is_wrong(spark):
    r = record(spark, {}, {"gross_amount_minor": 500, "net_amount_minor": 900}, {"invoice_number": "scan-1", "gross_amount_minor": 500, "warnings": [records.FILENAME_NUMBER]}, {"gross_amount_minor": 500}, {"currency": None, "gross_amount_minor": 1})
    answers = [("h0", payload(gross_amount="5.00")), ("h1", payload(net_amount="4.00", vat_amount="1.00", gross_amount="5.00")), ("h2", payload(invoice_number="FV/9")), ("h3", payload(gross_amount="9.00")), ("h4", payload())]
    out, outcomes = payloads.apply_payloads(r, spark.createDataFrame(answers, "content_hash string, answer string"), "m")
    got = {x.content_hash: x for x in out.collect()}
    assert {x.content_hash: x.outcome for x in outcomes.collect()} == {"h0": "applied", "h1": "applied", "h2": "applied", "h3": "unchanged", "h4": "rejected"}
    assert got["h0"].gross_amount_minor == 500 and got["h1"].net_amount_minor == 400 and got["h2"].invoice_number == "FV/9" and records.FILENAME_NUMBER not in got["h2"].warnings and got["h3"].gross_amount_minor == 500


def test_model_hook_runs_in_the_tasks(spark):
    import pyarrow as pa

    def enrich(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["{}"] * b.num_rows)], names=["content_hash", "answer"])

    assert [r.answer for r in payloads.ask(record(spark, {}, {}).select("content_hash"), enrich).collect()] == ["{}", "{}"]


def test_better_reading_keeps_the_first_on_regression(spark):
    first = record(spark, {}, {"gross_amount_minor": 5}, {})
    second = record(spark, {"gross_amount_minor": 7}, {"gross_amount_minor": 9}, {"issue_date": None, "currency": None})
    got = {r.content_hash: r.gross_amount_minor for r in extraction.better_reading(first, second).collect()}
    assert got == {"h0": 7, "h1": 5, "h2": None}
    assert conform(first.where("false")).count() == 0


def test_answers_are_read_once_for_records_and_outcomes(spark):
    """Both results read written records: neither asks the reader of answers again (F17: seconds)."""
    record = conform(spark.createDataFrame([("mail", "h1", "FV/1", "Firm")], "source string, content_hash string, invoice_number string, seller_name string"))
    both = payloads.apply_payloads(record, spark.createDataFrame([("h1", "no answer")], "content_hash string, answer string"), "m1")
    assert both[1].first().outcome == "rejected" and both[0].first().invoice_number == "FV/1"
    assert not any("ArrowEvalPython" in x._jdf.queryExecution().optimizedPlan().toString() for x in both)
