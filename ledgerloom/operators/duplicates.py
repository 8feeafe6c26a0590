"""Duplicate invoice numbers inside a table and against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import salted_join


def _key(columns: list[str]) -> Column:
    """The number alone, or number plus more columns; '' when the number is missing."""
    number = F.coalesce(F.col(columns[0]), F.lit(""))
    if len(columns) == 1:
        return number
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[1:]]
    return F.when(number == "", "").otherwise(F.concat_ws("\u0001", number, *rest))


def flag_duplicates(invoices: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Adds is_duplicate and duplicate_of, the lowest id of another row with the same key.

    The two lowest ids per key are enough for that. The rank limit runs before
    the shuffle, so a key that holds a third of the rows sends two rows per task;
    the way back is a salted join with one row per duplicated key.
    """
    keyed = invoices.withColumn("_key", _key(key or ["invoice_number"]))
    w = Window.partitionBy("_key").orderBy("id")
    lowest = (
        keyed.where(F.col("_key") != "").select("_key", "id")
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 2)
        .groupBy("_key").agg(F.min("id").alias("_first"), F.max("id").alias("_second"))
        .where(F.col("_first") < F.col("_second"))
    )
    joined = salted_join(keyed, lowest, ["_key"], F.col("id"))
    other = F.when(F.col("id") == F.col("_first"), F.col("_second")).otherwise(F.col("_first"))
    return joined.withColumns({"is_duplicate": F.col("_first").isNotNull(), "duplicate_of": other}).drop(
        "_key", "_first", "_second"
    )


def duplicates_vs_history(batch: DataFrame, history: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Rows of a new batch whose key is already in the history, with the lowest id there."""
    columns = key or ["invoice_number"]
    known = (
        history.withColumn("_key", _key(columns)).where(F.col("_key") != "")
        .groupBy("_key").agg(F.min("id").alias("duplicate_of"))
    )
    keyed = batch.withColumn("_key", _key(columns))
    return salted_join(keyed, known, ["_key"], F.col("id"), "inner").drop("_key")
