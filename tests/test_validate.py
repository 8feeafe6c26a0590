import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.duplicates import duplicates_vs_history, flag_duplicates
from ledgerloom.operators.validate import validate

SCHEMA = ("id bigint, invoice_number string, invoice_date string, due_date string, vendor_name string, "
          "total_amount double, subtotal double, tax_amount double, currency string")
BASE = {"invoice_number": "KILN-3071", "invoice_date": "2023-09-04", "due_date": None, "vendor_name": "Fern Pottery",
        "total_amount": 763.0, "subtotal": 700.0, "tax_amount": 63.0, "currency": "CHF"}
# change, status, kind, words of one message
CASES = [
    ({}, "PASSED", "passed", "arithmetic consistent"),
    ({"invoice_number": None}, "FAILED", "errors", "invoice_number"),
    ({"total_amount": None}, "FAILED", "errors", "total_amount"),
    ({"total_amount": 0.0}, "FAILED", "errors", "non-positive"),
    ({"subtotal": 310.0, "tax_amount": 20.0, "total_amount": 900.0}, "WARNING", "warnings", "Arithmetic"),
    ({"invoice_date": "2099-12-31"}, "WARNING", "warnings", "future"),
    ({"invoice_date": "1999-12-31"}, "WARNING", "warnings", "year < 2000"),
    ({"invoice_date": "soon"}, "WARNING", "warnings", "Could not parse"),
    ({"due_date": "2023-02-11"}, "FAILED", "errors", "before"),
    ({"due_date": "2023-09-04"}, "PASSED", "passed", "after"),
    ({"tax_amount": -50.0}, "WARNING", "warnings", "negative"),
    ({"subtotal": 1700.0}, "WARNING", "warnings", "exceeds total"),
    ({"currency": "us dollars"}, "WARNING", "warnings", "currency"),
    ({"invoice_number": "AB"}, "WARNING", "warnings", "short"),
    ({"invoice_number": "1" * 31}, "WARNING", "warnings", "exceeds"),
    ({"invoice_number": "---"}, "FAILED", "errors", "alphanumeric"),
]


@pytest.fixture(scope="module")
def checked(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [tuple({**BASE, **change, "id": i}[n] for n in names) for i, (change, *_) in enumerate(CASES)]
    return {r["id"]: r for r in validate(spark.createDataFrame(rows, SCHEMA), "2026-01-01").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(checked, i):
    _, status, kind, words = CASES[i]
    assert checked[i]["validation_status"] == status
    assert any(words in message for message in checked[i][kind])


def test_duplicates_against_brute_force(spark):
    """One number holds half of the rows, many numbers are missing."""
    rows = [(i, "HOT" if i % 2 else ("" if i % 3 == 0 else None if i % 5 == 0 else f"N{i % 40}")) for i in range(400)]
    got = {r["id"]: (r["is_duplicate"], r["duplicate_of"])
           for r in flag_duplicates(spark.createDataFrame(rows, "id bigint, invoice_number string")).collect()}
    for i, number in rows:
        others = [j for j, n in rows if number and n == number and j != i]
        assert got[i] == (bool(others), min(others) if others else None)
    batch = spark.createDataFrame([(1000, "HOT"), (1001, "new"), (1002, "")], "id bigint, invoice_number string")
    history = spark.createDataFrame(rows, "id bigint, invoice_number string")
    assert [(r["id"], r["duplicate_of"]) for r in duplicates_vs_history(batch, history).collect()] == [(1000, 1)]


def test_duplicate_key_may_have_more_columns(spark):
    rows = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, "A", "x")], "id bigint, invoice_number string, vendor_name string")
    got = flag_duplicates(rows, ["invoice_number", "vendor_name"]).where("is_duplicate").select("id").orderBy("id")
    assert [r[0] for r in got.collect()] == [1, 3]
    assert rows.select(F.count("id")).first()[0] == 3
