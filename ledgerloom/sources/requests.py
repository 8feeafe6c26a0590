"""Search queries derived from the supplier table, one per supplier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.sources.tables import table


def _template(position: int) -> Column:
    values = F.array(*[F.lit(t[position]) for t in fixed.TEMPLATES])
    return F.element_at(values, (F.pmod("s_suppkey", F.lit(7)) + 1).cast("int"))


def vendor_queries(spark: SparkSession, folder: str) -> DataFrame:
    """First word of a vendor name, as a search page would send it; every tenth is empty."""
    first_word = F.when(F.col("s_suppkey") % 10 == 9, "").otherwise(F.split(_template(4), " ")[0])
    return table(spark, folder, "supplier").select(F.col("s_suppkey").alias("query_id"), first_word.alias("vendor"),
                                                   F.lit(None).cast("string").alias("q"))


def mixed_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor word plus supplier number, every third one with a currency, every fifth with a range; some have
    stop words only, or no words at all."""
    key = F.col("s_suppkey")
    none = F.lit(None)
    return table(spark, folder, "supplier").select(
        key.alias("query_id"),
        F.when(key % 10 == 7, none).when(key % 10 == 8, "the of and").otherwise(
            F.concat_ws(" ", F.split(_template(4), " ")[0], key)).alias("q"),
        F.when((key % 4 == 0) & (key % 10 != 8), F.split(_template(4), " ")[1]).alias("vendor"),
        F.when(key % 3 == 0, _template(2)).alias("currency"),
        none.cast("string").alias("language"),
        F.when(key % 6 == 0, "PASSED").alias("validation_status"),
        F.when(key % 5 == 0, F.lit(50000.0)).alias("min_amount"),
        F.when(key % 5 == 0, F.lit(250000.0)).alias("max_amount"),
    )


def word_requests(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, kind, words: of each benchmark item a phrase of its third to fifth word, the beginning of its second
    and its first and last words; every tenth phrase has a word that no text has."""
    items = table(spark, folder, "benchmark").select("item_id", F.split(F.lower(F.trim("text")), r"[^\p{L}\p{N}]+").alias("w"))
    key = F.col("item_id").cast("bigint")
    phrase = F.when(key % 10 == 3, F.concat(F.slice("w", 3, 2), F.array(F.lit("qqzzq")))).otherwise(F.slice("w", 3, 3))
    kinds = [("phrase", phrase), ("prefix", F.array(F.substring(F.get("w", F.lit(1)), 1, 4))),
             ("any", F.array(F.get("w", F.lit(0)), F.element_at("w", -2)))]
    made = F.array(*[F.struct((key * 3 + i).alias("query_id"), F.lit(kind).alias("kind"), words.alias("words"))
                     for i, (kind, words) in enumerate(kinds)])
    return items.where(F.size("w") >= 5).select(F.explode(made).alias("r")).select("r.*")
