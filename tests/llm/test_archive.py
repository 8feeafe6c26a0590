import base64
import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm.archive import Archive, read_records, write_archive

PAGES = [(3, "http://a/1", "<p>x</p>"), (1, "http://a/2", "<p>x</p>"), (2, None, None), (5, "http://b", ""), (4, "http://c\r\nX: y", "é" * 50_000),
         (4, "http://c", "other"), (None, "http://d", "<p>x</p>"), (None, "http://e", "alone"), (7, "http://f", "same"), (7, "http://f", "same")]


def test_records_come_back_byte_for_byte(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("sha256", F.lit("clash"))
    archive = write_archive(pages)
    assert archive.payloads().count() == len({h or "" for _, _, h in PAGES})
    assert archive.headers().count() == len(PAGES)
    rows = read_records(archive).collect()
    assert len(rows) == len(PAGES) and all(r["verified"] for r in rows)
    firsts = {}
    for page, _, html in PAGES:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    for r in rows:
        body = bytes(r["payload"])
        text = body.decode()
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        revisit = r["page_id"] is not None and firsts[text] != r["page_id"]
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == (firsts[text] if revisit else None)
        record = bytes(r["record"])
        head, block = record.split(b"\r\n\r\n", 1)
        assert block == (b"" if revisit else body) + b"\r\n\r\n"
        assert f"Content-Length: {0 if revisit else len(body)}".encode() in head and head.count(b"WARC-Target-URI") == 1
        assert r["record_bytes"] == len(record)
        assert all(head.count(f"\r\n{name}: ".encode()) == 1 for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date"))


def test_a_damaged_payload_is_noticed(spark):
    archive = write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id bigint, url string, html string"))
    damaged = archive.payloads().withColumn("payload", F.when(F.col("payload") == F.lit(b"one"), F.lit(b"0ne")).otherwise(F.col("payload")))
    damaged.createOrReplaceTempView("damaged_payloads")
    assert {r["page_id"]: r["verified"] for r in read_records(Archive(spark, "damaged_payloads", archive.header_path)).collect()} == {1: False, 2: True}


def test_a_wrong_length_is_noticed(spark):
    archive = write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two"), (3, "u", "two")], "page_id bigint, url string, html string"))
    path = archive.header_path + "-damaged"
    archive.headers().withColumn("header", F.when(F.col("page_id") == 1, F.replace("header", F.lit("Length: 3"), F.lit("Length: 2")))
                                 .otherwise(F.col("header"))).write.parquet(path)
    rows = read_records(Archive(spark, archive.payload_table, path)).select("page_id", "verified").collect()
    assert {r["page_id"]: r["verified"] for r in rows} == {1: False, 2: True, 3: True}


def test_payloads_stay_where_they_are(spark):
    """The record join shuffles headers only: no exchange above the scan of payloads."""
    archive = write_archive(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        responses = read_records(archive).where("record_type = 'response'").select("page_id", "verified")
        plan = responses._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan


def test_no_pages(spark):
    archive = write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert read_records(archive).count() == 0
