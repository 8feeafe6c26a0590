"""Recognised words derived from conversations: a conversation is a document, a turn a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.tables import table


def recognised_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page with its words as array<struct<word,conf>> (confidence 0-100)."""
    turns = table(spark, folder, "conversations")
    seed = F.col("conv_id") * 31 + F.col("turn") * 17
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(w.alias("word"), F.pmod(seed + (i + 1) * 7, F.lit(101)).cast("double").alias("conf")),
    )
    return turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "role", words.alias("words"))


def recognised_pages_alt(spark: SparkSession, folder: str) -> DataFrame:
    """The second engine's view: on every other page each fifth word is lost; confidence 0-1."""
    whole = F.pmod(F.col("doc_id") + F.col("page_no"), F.lit(2)) == 1
    kept = F.filter("words", lambda w, i: whole | ((i + 1) % 5 != 0))
    scaled = F.transform(kept, lambda w: F.struct(w["word"].alias("word"), (w["conf"] / 100).alias("conf")))
    return recognised_pages(spark, folder).withColumn("words", scaled)
