"""Projections and filters over the stored invoices table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NullType

from ledgerloom import fixed
from ledgerloom.functions.scores import status_class, whole_percent
from ledgerloom.functions.text import money_text

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def time_text(stamp: Column) -> Column:
    return F.date_format(stamp, TIME_FORMAT)


def record_view(invoices: DataFrame) -> DataFrame:
    """The 24 record columns; the processing time as text."""
    return invoices.select(*fixed.RECORD_COLUMNS[:-1], time_text(F.col("processed_at")).alias("processed_at"))


def export_view(invoices: DataFrame) -> DataFrame:
    """Record columns in their fixed order: absent ones are NULL, others dropped."""
    types = dict(invoices.dtypes)

    def column(name: str) -> Column:
        if name not in types:
            return F.lit(None).cast("string").alias(name)
        if name in fixed.MONEY_COLUMNS and types[name] == "double":
            return F.col(name).cast("decimal(18,2)").alias(name)
        if types[name].startswith("timestamp"):
            return time_text(F.col(name)).alias(name)
        return F.col(name)

    return invoices.select(*[column(c) for c in fixed.RECORD_COLUMNS])


def newest_first(invoices: DataFrame, limit: int) -> DataFrame:
    """Newest rows by processing time, highest id first on a tie."""
    return invoices.orderBy(F.desc("processed_at"), F.desc("id")).limit(limit)


def by_id(invoices: DataFrame, invoice_id: int) -> DataFrame:
    return invoices.where(F.col("id") == invoice_id)


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that the table has, in the given order."""
    return df.select(*[c for c in columns if c in df.columns])


def results_view(invoices: DataFrame) -> DataFrame:
    """Display columns with the style class of the status."""
    shown = present(invoices, fixed.DISPLAY_COLUMNS)
    if "processed_at" in shown.columns:
        shown = shown.withColumn("processed_at", time_text(F.col("processed_at")))
    return shown.withColumn("status_class", status_class(F.col("validation_status")))


STATUS_VIEWS = {
    "FAILED": ["id", "filename", "invoice_number", "vendor_name", "total_amount"],
    "WARNING": ["id", "filename", "invoice_number", "vendor_name"],
    "PASSED": ["id", "filename", "invoice_number", "invoice_date", "vendor_name", "total_amount"],
}


def with_status(invoices: DataFrame, status: str) -> DataFrame:
    return present(invoices.where(F.col("validation_status") == status), STATUS_VIEWS[status])


def duplicates_view(invoices: DataFrame) -> DataFrame:
    """Rows flagged as duplicate; a missing flag counts as false."""
    flag = F.coalesce(F.col("is_duplicate"), F.lit(False)) if "is_duplicate" in invoices.columns else F.lit(False)
    return invoices.where(flag).select("id", "filename", "invoice_number", "vendor_name")


def batch_view(results: DataFrame) -> DataFrame:
    """Ten display columns of a processing result; failed rows show a dash and the error."""
    missing = lambda c, shown="": F.coalesce(F.col(c).cast("string"), F.lit(shown))
    return results.select(
        "filename",
        missing("validation_status", "—").alias("status"),
        missing("invoice_number").alias("invoice_no"),
        missing("vendor_name").alias("vendor"),
        F.coalesce(money_text(F.col("total_amount")), F.lit("")).alias("total"),
        missing("currency").alias("currency"),
        missing("detected_language").alias("language"),
        F.concat(F.coalesce(whole_percent(F.col("ocr_confidence")), F.lit(0)).cast("string"), F.lit("%")).alias("ocr_conf"),
        missing("error").alias("error"),
        "success",
    )


def csv_ready(df: DataFrame) -> DataFrame:
    """Booleans as True/False and untyped columns as text, for text sinks."""
    out = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, BooleanType):
            column = F.when(column, "True").when(~column, "False").alias(field.name)
        elif isinstance(field.dataType, NullType):
            column = column.cast("string").alias(field.name)
        out.append(column)
    return df.select(*out)
