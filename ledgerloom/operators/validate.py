"""Data-quality rules over an invoice table. Every rule is a column, no rule shuffles.

A rule gives a message or NULL; a report is three message arrays, a status and the
duplicate flag. `as_of` is the day that counts as today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.dates import read_date
from ledgerloom.functions.text import ascii_digits, money_text, squeeze

PASSED, WARNING, ERROR = "passed", "warnings", "errors"
Rules = list[tuple[str, Column]]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def mandatory_rules() -> Rules:
    rules: Rules = []
    for field in fixed.MANDATORY_FIELDS:
        if field == "total_amount":
            missing = F.coalesce(F.col(field) == 0, F.lit(True))
        else:
            missing = squeeze(_text(field)) == ""
        rules.append((ERROR, F.when(missing, f"Missing mandatory field: '{field}'")))
        rules.append((PASSED, F.when(~missing, f"Mandatory field present: '{field}'")))
    return rules


def number_rules() -> Rules:
    number = _text("invoice_number")
    size = F.length(number)
    given = number != ""
    say = lambda tail: F.concat(F.lit("Invoice number '"), number, F.lit(tail))
    return [
        (WARNING, F.when(given & (size < fixed.NUMBER_MIN_LEN), say("' is suspiciously short"))),
        (WARNING, F.when(size > fixed.NUMBER_MAX_LEN, say("' exceeds expected length"))),
        (PASSED, F.when(size.between(fixed.NUMBER_MIN_LEN, fixed.NUMBER_MAX_LEN), "Invoice number format valid")),
        (ERROR, F.when(given & ~number.rlike("[A-Za-z0-9]"), say("' contains no alphanumeric characters"))),
    ]


def date_rules(as_of: str) -> Rules:
    """Needs the columns _invoice_day and _due_day of with_days."""
    shown, day, due = _text("invoice_date"), F.col("_invoice_day"), F.col("_due_day")
    future = day > F.lit(as_of).cast("date")
    old = F.year(day) < 2000
    say = lambda head, tail: F.concat(F.lit(head), shown, F.lit(tail))
    return [
        (WARNING, F.when((shown != "") & day.isNull(), say("Could not parse invoice date: '", "'"))),
        (WARNING, F.when(future, say("Invoice date ", " is in the future"))),
        (WARNING, F.when(~future & old, say("Invoice date ", " may be incorrect (year < 2000)"))),
        (PASSED, F.when(~future & ~old, "Invoice date is valid")),
        (ERROR, F.when(due < day, "Due date is before invoice date — logically inconsistent")),
        (PASSED, F.when(due >= day, "Due date is after invoice date")),
    ]


def amount_rules() -> Rules:
    total, subtotal, tax = F.col("total_amount"), F.col("subtotal"), F.col("tax_amount")
    cents = lambda c: F.floor(c * 100 + 0.5)
    off = F.abs(cents(subtotal) + cents(tax) - cents(total))
    beyond = off * 100 > cents(total) * fixed.TOTAL_TOLERANCE_PERCENT
    story = F.concat(
        F.lit("Arithmetic inconsistency: subtotal ("), money_text(subtotal), F.lit(") + tax ("), money_text(tax),
        F.lit(") = "), money_text((cents(subtotal) + cents(tax)) / 100), F.lit(" but total is "), money_text(total),
        F.lit(" (diff="), money_text(off / 100), F.lit(")"),
    )
    return [
        (ERROR, F.when(total <= 0, F.concat(F.lit("Total amount is non-positive: "), money_text(total)))),
        (PASSED, F.when(total > 0, F.concat(F.lit("Total amount present: "), money_text(total)))),
        (WARNING, F.when(beyond, story)),
        (PASSED, F.when(~beyond, "Subtotal + tax ≈ total (arithmetic consistent)")),
        (WARNING, F.when(subtotal > total, F.concat(
            F.lit("Subtotal ("), money_text(subtotal), F.lit(") exceeds total ("), money_text(total), F.lit(")")))),
        (WARNING, F.when(tax < 0, F.concat(F.lit("Tax amount is negative: "), money_text(tax)))),
    ]


def currency_rules() -> Rules:
    currency = _text("currency")
    valid = currency.rlike(fixed.ISO_CURRENCY)
    return [
        (WARNING, F.when((currency != "") & ~valid, F.concat(F.lit("Non-standard currency format: '"), currency, F.lit("'")))),
        (PASSED, F.when(valid, F.concat(F.lit("Currency code valid: "), currency))),
    ]


def duplicate_rules() -> Rules:
    """Needs the columns is_duplicate and duplicate_of of flag_duplicates."""
    return [(WARNING, F.when(F.col("is_duplicate"), F.concat(
        F.lit("Duplicate invoice number '"), _text("invoice_number"), F.lit("' found (ID: "),
        F.col("duplicate_of").cast("string"), F.lit(")"))))]


def strict_rules() -> Rules:
    """Documented rules that are no part of the status: discount, tax id and PO shapes."""
    po, tax_id = _text("po_number"), _text("tax_id")
    return [
        (WARNING, F.when(F.col("discount") < 0, F.concat(F.lit("Discount is negative: "), money_text(F.col("discount"))))),
        (WARNING, F.when((tax_id != "") & ~tax_id.rlike(r"^[A-Za-z0-9\-]{5,20}\z"),
                         F.concat(F.lit("Tax id has an unknown shape: '"), tax_id, F.lit("'")))),
        (WARNING, F.when((po != "") & ~F.length(po).between(3, 20),
                         F.concat(F.lit("PO number has an unusual length: '"), po, F.lit("'")))),
    ]


def with_days(invoices: DataFrame) -> DataFrame:
    """Adds the dates read from the two date texts."""
    clean = lambda c: squeeze(ascii_digits(_text(c)))
    invoices = invoices.withColumns({"_invoice_text": clean("invoice_date"), "_due_text": clean("due_date")})
    invoices = invoices.withColumns({
        "_invoice_day": read_date(F.col("_invoice_text")), "_due_day": read_date(F.col("_due_text")),
    })
    return invoices.drop("_invoice_text", "_due_text")


def messages(rules: Rules, kind: str) -> Column:
    return F.array_compact(F.array(*[message for k, message in rules if k == kind] or [F.lit(None).cast("string")]))


def apply_rules(invoices: DataFrame, rules: Rules) -> DataFrame:
    """Adds the three message arrays of a rule set."""
    return invoices.withColumns({kind: messages(rules, kind) for kind in (PASSED, WARNING, ERROR)})


def status_of(warnings: Column, errors: Column) -> Column:
    return F.when(F.size(errors) > 0, "FAILED").when(F.size(warnings) > 0, "WARNING").otherwise("PASSED")


def validate(invoices: DataFrame, as_of: str) -> DataFrame:
    """Adds status, passed, warnings, errors; with duplicate_of present, the duplicate rule too."""
    rules = [*mandatory_rules(), *number_rules(), *date_rules(as_of), *amount_rules(), *currency_rules()]
    if "duplicate_of" in invoices.columns:
        rules += duplicate_rules()
    checked = apply_rules(with_days(invoices), rules).drop("_invoice_day", "_due_day")
    return checked.withColumn("validation_status", status_of(F.col(WARNING), F.col(ERROR)))


def report(is_duplicate: Column | None = None) -> Column:
    """The report of validate as one struct."""
    flag = F.col("is_duplicate") if is_duplicate is None else is_duplicate
    return F.struct(
        F.col("validation_status").alias("status"), F.col(PASSED), F.col(WARNING), F.col(ERROR),
        F.coalesce(flag, F.lit(False)).alias("is_duplicate"),
    )
