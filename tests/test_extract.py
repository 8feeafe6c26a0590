import pandas as pd
import pytest

from ledgerloom import fixed
from ledgerloom.operators.extract import extract_fields, with_entities
from ledgerloom.plans.jobs import documents_from_bytes, process_documents, quarantine

SAMPLE = """
INVOICE

Invoice No: WLD/88-1207
Invoice Date: 3 May 2023
Due Date: 02/06/2023

Seller: Willow Dyeing Mill
7 Canal Path
GSTIN: 29KLMNO4821P1ZQ

Bill To:
Oak Street Tailors
18 Needle Court

Subtotal: $640.50
Tax (8%): $51.24
Total Amount Due: $691.74
Payment Terms: within 20 days
"""
LONG_NAME = "Amalgamated Spinning and Weaving Company of the Northern Valleys Holding Ltd"
LONG_TERMS = "within thirty days after the end of the month of delivery or pickup"
LONG_NUMBER = "NV-" + "7" * 37
# text, field, expected value
CASES = [
    ("Invoice No: ROW-77-5", "invoice_number", "ROW-77-5"),
    ("Bill No. LOOM4471", "invoice_number", "LOOM4471"),
    ("We write about weather only", "invoice_number", ""),
    ("Rechnung Nr. 2024/77", "invoice_number", "2024/77"),
    ("Invoice Date: 15/01/2024", "invoice_date", "2024-01-15"),
    ("Issued on 2024-03-22", "invoice_date", "2024-03-22"),
    ("Due Date: 01/02/2024\nInvoice Date: 15 January 2024", "invoice_date", "2024-01-15"),
    ("Due Date: 2024-04-15", "due_date", "2024-04-15"),
    ("Total Due: $1,250.00", "total_amount", 1250.0),
    ("Subtotal: $1,000.00\nTotal: $1,180.00", "total_amount", 1180.0),
    ("Sous-total: 10.00\nMontant Total: 12.00", "total_amount", 12.0),
    ("Total: 1.234,56 EUR", "total_amount", 1234.56),
    ("Total: ,", "total_amount", None),
    ("Subtotal: 1000.00", "subtotal", 1000.0),
    ("VAT: £200.00", "tax_amount", 200.0),
    ("Tax: 18%", "tax_rate", "18%"),
    ("Tax: 18%", "tax_amount", None),
    ("Tax (18%): $180.00", "tax_amount", 180.0),
    ("Discount: 5.50", "discount", 5.5),
    ("Currency: USD", "currency", "USD"),
    ("Amount: ₹ 5000", "currency", "INR"),
    ("Total: 1,180.00 EUR", "currency", "EUR"),
    ("Total: R1,180.00", "currency", "ZAR"),
    ("Total: AED 500.00", "total_amount", 500.0),
    ("Subtotal: 10\nTo: Bob Builders", "buyer_name", "Bob Builders"),
    ("Subtotal 10 to nobody", "buyer_name", ""),
    ("From: Müller & Söhne\nStreet 1", "vendor_name", "Müller & Söhne"),
    ("P.O. Number: 4500-77", "po_number", "4500-77"),
    ("VAT No: DE123456789", "tax_id", "DE123456789"),
    ("shape 29KLMNO4821P1ZQ alone", "tax_id", "29KLMNO4821P1ZQ"),
    ("Payment Terms: Net 30 days\nThank you", "payment_terms", "Net 30 days"),
    ("payable within\n14 days from receipt", "payment_terms", "14 days from"),
    ("Address: 1 High St\nTown\nVAT No: DE12345", "address", "1 High St Town"),
    ("From: " + LONG_NAME, "vendor_name", LONG_NAME),
    ("Bill To: " + LONG_NAME, "buyer_name", LONG_NAME),
    ("Payment Terms: " + LONG_TERMS, "payment_terms", LONG_TERMS),
    ("Invoice No: " + LONG_NUMBER, "invoice_number", LONG_NUMBER),
    ("PO No: " + LONG_NUMBER, "po_number", LONG_NUMBER),
    ("VAT No: " + LONG_NUMBER, "tax_id", LONG_NUMBER),
    ("Address: " + "\n".join(f"Yard {i} Long Lane" for i in range(30)) + "\nVAT No: X12345", "address",
     " ".join(f"Yard {i} Long Lane" for i in range(30))),
    ("Tax (8%): -$51.24", "tax_amount", -51.24),
    ("VAT: -1.234,50", "tax_amount", -1234.5),
    ("Discount: -3.00", "discount", -3.0),
    ("Total - 12.00", "total_amount", 12.0),
]


@pytest.fixture(scope="module")
def extracted(spark):
    texts = sorted({t for t, _, _ in CASES} | {SAMPLE})
    rows = extract_fields(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    return {r["text"]: r for r in rows}


@pytest.mark.parametrize("text,field,want", CASES)
def test_field(extracted, text, field, want):
    assert extracted[text][field] == want


def test_whole_sample(extracted):
    row = extracted[SAMPLE]
    want = {"invoice_number": "WLD/88-1207", "invoice_date": "2023-05-03", "due_date": "2023-06-02",
            "vendor_name": "Willow Dyeing Mill", "buyer_name": "Oak Street Tailors", "total_amount": 691.74,
            "subtotal": 640.5, "tax_amount": 51.24, "tax_rate": "8%", "currency": "USD", "tax_id": "29KLMNO4821P1ZQ",
            "payment_terms": "within 20 days", "address": "Oak Street Tailors 18 Needle Court"}
    assert {k: row[k] for k in want} == want
    assert set(row["confidence_scores"]) == set(fixed.CONFIDENCE_KEYS)
    assert all(0 <= v <= 1 for v in row["confidence_scores"].values())
    assert row["confidence_scores"]["po_number"] == fixed.CONF_LOW


def test_entities_fill_in(spark):
    def find(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: [{"text": "Org B", "label": "ORG", "pos": 5}, {"text": "Org A", "label": "ORG", "pos": 1},
                                    {"text": "3 May 2024", "label": "DATE", "pos": 9}])

    rows = spark.createDataFrame([("nothing labelled",), ("From: Named Ltd",)], "text string")
    first, second = sorted(extract_fields(with_entities(rows, find)).collect(), key=lambda r: r["text"], reverse=True)
    assert (first["vendor_name"], first["buyer_name"], first["invoice_date"]) == ("Org A", "Org B", "2024-05-03")
    assert first["confidence_scores"]["vendor_name"] == fixed.CONF_MEDIUM
    assert second["vendor_name"] == "Named Ltd"


def test_failures_are_rows(spark):
    docs = documents_from_bytes(spark, [("a.pdf", SAMPLE.encode()), ("b.docx", b"Invoice No: X-1")])
    results = process_documents(docs)
    got = {r["filename"]: r for r in results.collect()}
    assert got["a.pdf"]["success"] and got["a.pdf"]["validation_report"]["status"] == "PASSED"
    assert not got["b.docx"]["success"] and got["b.docx"]["error"] == "Unsupported file type: .docx"
    assert got["b.docx"]["invoice_number"] is None
    assert [r["filename"] for r in quarantine(results).collect()] == ["b.docx"]


def test_an_overlong_number_is_reported(spark):
    docs = documents_from_bytes(spark, [("a.pdf", SAMPLE.replace("WLD/88-1207", LONG_NUMBER).encode())])
    row = process_documents(docs).first()
    assert row["invoice_number"] == LONG_NUMBER and row["validation_status"] == "WARNING"
    assert any("exceeds expected length" in m for m in row["validation_report"]["warnings"])


def test_every_line_item_is_in_the_text(spark):
    from pyspark.sql import functions as F

    from ledgerloom.sources.invoices import invoice_text
    from ledgerloom.sources.tables import table

    folder = "/root/testdata/sf0.001"
    texts = invoice_text(spark, folder).select((F.col("doc_id") - 1).alias("l_orderkey"), F.size(F.regexp_extract_all(
        "text", F.lit(r"(?m)^(Part \d+) "), F.lit(1))).alias("shown"))
    counts = table(spark, folder, "lineitem").groupBy("l_orderkey").count()
    both = counts.join(texts, "l_orderkey")
    assert both.where("shown <> count").count() == 0 and both.where("count > 4").count() > 0


def test_languages_of_invoices(spark):
    from ledgerloom.plans import catalog
    from ledgerloom import fixed as values

    folder = "/root/testdata/sf0.001"
    wanted = {(t[0], t[1]) for t in values.TEMPLATES}
    rows = catalog.all_queries()["detect_language"](spark, folder).collect()
    assert {((r["doc_id"] - 1) % 7, r["lang_code"]) for r in rows} == wanted
