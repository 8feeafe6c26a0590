"""CSV and JSON sinks, written in parallel; no row passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators.views import csv_ready, export_view, newest_first

BYTE_ORDER_MARK = "\ufeff"


def export_csv(invoices: DataFrame, path: str, limit: int | None = None, mark: bool = True, compression: str = "none") -> str:
    """UTF-8 CSV part files, each with a header; mark puts a byte order mark before it."""
    rows = csv_ready(export_view(newest_first(invoices, limit) if limit else invoices))
    if mark:
        first = rows.columns[0]
        rows = rows.withColumnRenamed(first, BYTE_ORDER_MARK + first)
    (rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "")
     .option("quote", '"').option("escape", '"').option("lineSep", "\n").option("compression", compression).csv(path))
    return path


def export_json(invoices: DataFrame, path: str, limit: int | None = None, compression: str = "none") -> str:
    """One JSON object per line; NULLs and non-ASCII characters are kept."""
    rows = export_view(newest_first(invoices, limit) if limit else invoices)
    rows.write.mode("overwrite").option("ignoreNullFields", False).option("compression", compression).json(path)
    return path


def export(
    invoices: DataFrame, folder: str, fmt: str = "both", limit: int | None = None, compression: str = "none"
) -> dict[str, str]:
    """csv, json or both; returns format -> path. An unknown format writes nothing. compression is Spark's name of one."""
    paths = {}
    if fmt in ("csv", "both"):
        paths["csv"] = export_csv(invoices, f"{folder}/invoice_export.csv", limit, compression=compression)
    if fmt in ("json", "both"):
        paths["json"] = export_json(invoices, f"{folder}/invoice_export.json", limit, compression)
    return paths


def read_csv_export(spark, path: str, schema: str) -> DataFrame:
    """Reads an export back; the schema replaces the header's names. Values may hold line feeds."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
            .option("multiLine", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").csv(path))
