"""Cleaning and mixing of the documents table: each stage works on what the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_rules, mixing, near_dups, private
from ledgerloom.llm.common import written
from ledgerloom.sources.tables import table


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars after a change of the texts."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly their host's repeated lines go, and those lines of the others."""
    return _measured(line_rules.clean_documents(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id stays; rows of one doc_id and text become one.

    Unlike texts under one doc_id are documents of their own: that of the least hash goes by the doc_id, the others come
    after all doc_ids. Of rows that differ in other columns only, the one with the least hash of these stays.
    """
    columns = docs.columns
    named = docs.where("doc_id IS NOT NULL").withColumn("__hash", F.xxhash64("text"))
    several = named.groupBy("doc_id").agg(F.min("__hash").alias("__first"), F.max("__hash").alias("__last"))
    several = written(several.where("__first < __last").select(F.col("doc_id").alias("__of"), "__first"), "shared-ids")
    own = F.xxhash64("doc_id", "__hash").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = (named.join(several, F.col("doc_id") == F.col("__of"), "left")
             .withColumn("__id", F.when(F.col("__hash") != F.col("__first"), own).otherwise(F.col("doc_id"))))
    linked = near_dups.link_near_duplicates(named.select(F.col("__id").alias("doc_id"), "text"))
    kept = linked.where("kept").select(F.col("doc_id").alias("__id"))
    others = F.xxhash64(*[c for c in columns if c != "text"])
    single = (named.join(kept, "__id", "left_semi").groupBy("__id")
              .agg(F.min_by(F.struct(*columns), others).alias("row")).select("row.*"))
    return single.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows."""
    return _measured(private.mask_private(docs), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken into the mix, with the number of their copies.

    Each row is drawn as it is, also where several share a doc_id or have none; a column that bears the name of a new one
    gives way.
    """
    new = ["size", "target", "copies", "taken"]
    docs = docs.drop(*new)
    return mixing.pareto_mix(docs, carry=docs.columns).where("copies > 0").select("row.*", *new)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mix),
]
#: SQL can't express the pattern, sketch and edit-distance stages; tests/llm checks each stage, quality
#: and near-duplicates by exact rows, the others in part.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
