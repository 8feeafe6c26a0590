"""The stored invoices table (28 columns) derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.scores import average_confidence, score_map
from ledgerloom.operators.duplicates import flag_duplicates
from ledgerloom.operators.validate import report, validate
from ledgerloom.sources.invoices import invoice_facts, invoice_text


def known_fields(spark: SparkSession, folder: str) -> DataFrame:
    """id, filename, received_at and the sixteen fields, straight from the facts.

    Three more planted faults live here only, for the documented strict rules.
    """
    facts = invoice_facts(spark, folder)
    money = lambda c: (F.col(c) / 100)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    every = lambda prime: F.col("key") % prime == 0
    return facts.select(
        (F.col("key") + 1).alias("id"), "key", "filename", "received_at", "invoice_number",
        day("invoice_day").alias("invoice_date"), day("due_day").alias("due_date"), "vendor_name", "buyer_name",
        money("total_c").alias("total_amount"), money("subtotal_c").alias("subtotal"),
        money("tax_c").alias("tax_amount"), "tax_rate",
        F.when(every(67), (F.lit(0) - F.col("discount_c")) / 100).otherwise(money("discount_c")).alias("discount"), "currency",
        F.when(every(71), "GST/27").otherwise(F.regexp_extract("tax_id_line", ": (.*)", 1)).alias("tax_id"),
        F.when(every(61), "P1").otherwise(F.col("po_number")).alias("po_number"),
        F.concat_ws(" ", "buyer_name", F.lit(fixed.BUYER_STREET)).alias("address"),
        F.lit(fixed.TERMS).alias("payment_terms"), F.col("lang").alias("detected_language"),
    )


def _known_scores() -> dict[str, Column]:
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) != ""
    high = {"invoice_number", "invoice_date", "vendor_name", "buyer_name", "total_amount", "tax_id", "po_number"}
    return {
        key: F.when(filled(key), fixed.CONF_HIGH if key in high else fixed.CONF_MEDIUM).otherwise(fixed.CONF_LOW)
        for key in fixed.CONFIDENCE_KEYS
    }


def scored(records: DataFrame) -> DataFrame:
    """Adds confidence map and mean, engine and engine confidence."""
    records = records.withColumn("confidence_scores", score_map(_known_scores()))
    return records.withColumns({
        "avg_field_confidence": average_confidence(F.col("confidence_scores")),
        "ocr_engine": F.when(F.col("key") % 5 == 0, "easyocr").otherwise("tesseract"),
        "ocr_confidence": (F.pmod("key", F.lit(41)) + 60) / 100,
    })


def validated(spark: SparkSession, folder: str, as_of: str = fixed.AS_OF) -> DataFrame:
    """Known fields with scores, duplicate flag and the report's message arrays."""
    return validate(flag_duplicates(scored(known_fields(spark, folder))), as_of)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The record columns plus report and scores; no text column, so no text is rendered."""
    rows = validated(spark, folder).withColumn("processed_at", F.col("received_at"))
    return rows.withColumn("validation_report", report()).select(
        *fixed.RECORD_COLUMNS, "validation_report", "confidence_scores"
    )


def invoices(spark: SparkSession, folder: str) -> DataFrame:
    """All 28 columns: records plus content hash and full text."""
    text = invoice_text(spark, folder).select(F.col("doc_id").alias("id"), "file_hash", F.col("text").alias("raw_text"))
    return records(spark, folder).join(text, "id")
