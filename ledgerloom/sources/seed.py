"""Synthetic invoice rows for load tests: every value depends on the row's id alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed


def seed_invoices(existing: DataFrame, size: int, count: int | None = None) -> DataFrame:
    """The rows that top a table up to `size` rows; none when it has as many already.

    One digest per row supplies the picks: four hex digits per picked column.
    """
    spark = existing.sparkSession
    count = existing.count() if count is None else count
    ids = spark.range(count, max(size, count)).withColumn("_digest", F.md5(F.col("id").cast("string")))

    def draw(slot: int, n: int) -> Column:
        return F.pmod(F.conv(F.substring("_digest", 1 + 4 * slot, 4), 16, 10).cast("bigint"), F.lit(n))

    def pick(slot: int, values: Sequence[str]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(slot, len(values)) + 1).cast("int"))

    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    wide = F.pmod(F.conv(F.substring("_digest", 5, 8), 16, 10).cast("bigint"), F.lit(4990001))
    rows = ids.withColumns({"vendor_name": pick(0, fixed.SEED_VENDORS), "_total_c": wide + 10000})
    share = lambda percent: F.floor((F.col("_total_c") * percent + 50) / 100) / 100
    number = F.concat(pick(3, fixed.SEED_PREFIXES), F.lit("-"), (draw(4, 60000) + 1000).cast("string"))
    total = F.col("_total_c") / 100
    width = F.greatest(F.lit(5), F.length(F.col("id").cast("string")))
    return rows.select(
        "id",
        F.concat(F.lit("invoice_"), F.lpad(F.col("id").cast("string"), width, F.lit("0")), F.lit(".jpg")).alias("filename"),
        F.sha2(F.col("id").cast("string"), 256).alias("file_hash"),
        number.alias("invoice_number"),
        F.concat(F.lit("2023-"), two(draw(5, 12) + 1), F.lit("-"), two(draw(6, 28) + 1)).alias("invoice_date"),
        "vendor_name",
        pick(7, fixed.SEED_VENDORS).alias("buyer_name"),
        total.alias("total_amount"),
        share(85).alias("subtotal"),
        share(15).alias("tax_amount"),
        pick(2, fixed.SEED_CURRENCIES).alias("currency"),
        pick(5, fixed.SEED_LANGUAGES).alias("detected_language"),
        pick(6, fixed.STATUSES).alias("validation_status"),
        F.concat(F.col("vendor_name"), F.lit(" asks for "),
                 total.cast("decimal(18,2)").cast("string")).alias("raw_text"),
        ((draw(1, 481) + 500) / 1000).alias("avg_field_confidence"),
        F.lit("tesseract").alias("ocr_engine"),
        ((draw(3, 391) + 600) / 1000).alias("ocr_confidence"),
        F.lit(False).alias("is_duplicate"),
    )
