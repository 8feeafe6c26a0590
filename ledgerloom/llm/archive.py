"""Content-addressed WARC archive.

Payload bytes are kept once, under an address that ends in their SHA-256; the exact header block of every record is kept
apart. The original record is header + payload + two line ends, put together by a join on the address. Payloads are
bucketed by it, so that join shuffles headers and leaves payloads where they are; spark.sql.shuffle.partitions says how many
buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import skew_join, written
from ledgerloom.session import work_dir

END = "\r\n"
#: Pages say nothing of when they were fetched; a record must have a date.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Base32 of 40 hex digits: ten digits are 40 bits, which are eight base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


@dataclass
class Archive:
    """Table of payloads (address, sha256, payload), folder of headers (page_id, address, header)."""

    spark: SparkSession
    payload_table: str
    header_path: str

    def payloads(self) -> DataFrame:
        return self.spark.table(self.payload_table)

    def headers(self) -> DataFrame:
        return self.spark.read.schema("page_id bigint, address string, header string").parquet(self.header_path)


def _address(page: str) -> Column:
    """Where a payload is kept: the page that has it first, which spreads one payload's pages, and its digest."""
    return F.concat(F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col("sha256"))


def _header(first: Column, date: str) -> Column:
    """The header block of a record; a revisit carries no block of its own and names the record it repeats."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(END))

    revisit = F.col("page_id") != first
    return F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit(PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), first.cast("string"), F.lit(">"))),
        )).otherwise(line("Content-Type", F.lit("text/html"))),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit(END))


def write_archive(pages: DataFrame, folder: str | None = None, date: str = DATE) -> Archive:
    """Writes one record per row of pages (page_id, url, html) and returns where they are.

    The payload is the html in UTF-8, a null html is an empty payload and a null url an empty target. Of equal
    payloads that with the smallest page_id is the response. Rows with the same page_id are kept as records of their
    own; with equal payloads they are all the response. Rows without a page_id are records without a name and are
    always responses. All records bear the given date. An empty table gives two empty tables. Other columns of pages are not archived.

    Only digests are grouped; payloads are shuffled once, into the buckets they are kept in. One task gets all rows
    without a page_id that have the same payload.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    named = rows.select("page_id", "url", "sha256", base32(F.upper(F.sha1("payload"))).alias("sha1"),
                        F.octet_length("payload").cast("bigint").alias("bytes"))
    named = written(named, "warc-digests")
    first = named.groupBy("sha256").agg(F.min("page_id").alias("first"))
    headers = skew_join(named, first, ["sha256"], F.struct("page_id", "url"))
    # without a page_id the comparison is null, which makes the record a response
    headers.select("page_id", _address("first").alias("address"), _header(F.coalesce("first", F.lit(0)), date).alias("header")
                   ).write.parquet(f"{folder}/headers")
    holders = first.select(_address("first").alias("address"))
    # as many buckets as the join has partitions, so that its rows are written where they are
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = (rows.select(_address("page_id").alias("address"), "sha256", "payload")
              .join(holders, "address", "left_semi").dropDuplicates(["address"]))
    name = f"warc_payloads_{uuid.uuid4().hex[:12]}"
    (stored.write.bucketBy(n, "address").sortBy("address").option("path", f"{folder}/payloads").saveAsTable(name))
    return Archive(spark, name, f"{folder}/headers")


def read_records(archive: Archive) -> DataFrame:
    """One row per record: page_id, the exact record bytes, and what header and payload say.

    `verified`: the stored payload has the digest it is kept under, and the record put together from header and payload
    has the stated length, a block (cut from it by Content-Length) with the stated digest, and the closing line ends. A
    revisit has an empty block; its stated digest is that of the payload it refers to. Columns that the caller doesn't
    select are not read, but for the payload of a response, which `verified` needs.
    """
    payload = archive.payloads().select(
        "address", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32(F.upper(F.sha1("payload"))).alias("payload_digest"),
        (F.sha2("payload", 256) == F.col("sha256")).alias("whole"))

    def value(name: str) -> Column:
        return F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)

    header = archive.headers().select(
        "page_id", "address", F.encode("header", "UTF-8").alias("head"), value("WARC-Type").alias("record_type"),
        value("WARC-Payload-Digest").alias("stated"), value("Content-Length").cast("int").alias("block_bytes"),
        F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>", 1).alias("refers"))
    close = F.lit(b"\r\n\r\n")
    responses = (header.where("record_type = 'response'").join(payload, "address")
                 .withColumn("record", F.concat("head", "payload", close)))
    at = F.octet_length("head") + 1
    block = F.substring("record", at, F.col("block_bytes"))
    responses = responses.withColumn("verified", (
        F.col("whole") & (F.col("stated") == F.concat(F.lit("sha1:"), base32(F.upper(F.sha1(block)))))
        & (F.octet_length("record") == at + F.col("block_bytes") + 3)
        & (F.substring("record", at + F.col("block_bytes"), F.lit(4)) == close)))
    # a payload that a large share of the pages has: its revisits are dealt over many tasks
    revisits = (skew_join(header.where("record_type = 'revisit'"), payload, ["address"], "page_id")
                .withColumn("record", F.concat("head", close))
                .withColumn("verified", F.col("whole") & (F.col("block_bytes") == 0)
                            & (F.col("stated") == F.concat(F.lit("sha1:"), F.col("payload_digest")))))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type",
               F.when(F.col("refers") != "", F.col("refers").cast("bigint")).alias("refers_to"), "verified",
               F.octet_length("record").cast("bigint").alias("record_bytes"), "payload", "record"]
    return responses.select(*columns).unionByName(revisits.select(*columns))
