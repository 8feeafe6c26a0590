"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import (adaptive_scan, archive, classifier, collocations, decontaminate, licences, line_rules, mixing,
                            near_dups, page_diff, private, tokens, zone_maps)
from ledgerloom.llm.sql import SQL
from ledgerloom.sources.tables import table


def op1_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    records = archive.read_records(archive.write_archive(table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op2_licence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licences(table(spark, folder, "documents"))


def op3_benchmark_passages(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.pareto_mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find_private(table(spark, folder, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in private.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_rules.judge_quality(table(spark, folder, "documents")).drop("text_hash")


def op7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_diff.extract_main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.link_near_duplicates(table(spark, folder, "documents"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(tokens.MODEL))


def op10_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return adaptive_scan.nearest_vectors(table(spark, folder, "embeddings"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, folder, "documents"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return zone_maps.cluster_vectors(table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    run.__name__: run for run in (
        op1_warc_archive, op2_licence_rules, op3_benchmark_passages, op4_source_mix, op5_personal_data, op6_line_rules,
        op7_page_text, op8_near_duplicates, op9_token_counts, op10_quality_scores, op11_nearest_vectors, op12_collocations,
        op13_centroid_clusters, pipeline)}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
