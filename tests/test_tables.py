import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, export, pages, search
from ledgerloom.operators.upsert import number_rows, upsert_by_hash
from ledgerloom.session import work_dir
from ledgerloom.sources.files import hash_files, scan_files

NOW = "cast('2026-01-01 00:00:00' as timestamp_ntz)"


def _stored(spark, rows):
    return spark.createDataFrame(rows, "id bigint, file_hash string, status string").withColumn("processed_at", F.expr(NOW))


def test_upsert_twice_is_once(spark):
    target = _stored(spark, [(1, "aa00", "OLD"), (7, "bb00", "KEEP")])
    incoming = spark.createDataFrame([("aa00", None, 1), ("cc00", "FIRST", 1), ("cc00", "LAST", 2), ("ab00", "NEW", 1)],
                                     "file_hash string, status string, ingest_seq int")
    later = F.expr("cast('2026-02-02 00:00:00' as timestamp_ntz)")
    once = upsert_by_hash(target, incoming, later)
    want = {(1, "aa00", None), (7, "bb00", "KEEP"), (8, "ab00", "NEW"), (9, "cc00", "LAST")}
    pick = lambda df: {(r["id"], r["file_hash"], r["status"]) for r in df.collect()}
    assert pick(once) == want
    assert pick(upsert_by_hash(once, incoming, F.expr(NOW))) == want
    days = {r["file_hash"]: r["processed_at"].month for r in once.collect()}
    assert days == {"aa00": 1, "bb00": 1, "ab00": 2, "cc00": 2}


def test_number_rows_follows_the_hash_order(spark):
    rows = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("file_hash"))
    got = [r["file_hash"] for r in number_rows(rows).orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 500


def test_exports_read_back(spark):
    rows = spark.createDataFrame([(1, "a,b.jpg", 'He said "x"\nnext', 500.0, True), (2, "é.jpg", None, 12345678.9, False)],
                                 "id bigint, filename string, vendor_name string, total_amount double, is_duplicate boolean")
    paths = export.export(rows, work_dir(spark, "x"))
    parts = [r["content"] for r in spark.read.format("binaryFile").load(paths["csv"] + "/part-*").collect()]
    assert all(p.startswith(b"\xef\xbb\xbf") for p in parts if p)
    text = b"".join(parts).decode("utf-8")
    assert "12345678.90" in text and "True" in text and '""x""' in text
    schema = "id bigint, filename string, vendor_name string, total_amount string, is_duplicate string"
    csv = export.read_csv_export(spark, paths["csv"], ", ".join(
        f"`{c}` {dict(f.split() for f in schema.split(', ')).get(c, 'string')}" for c in export.export_view(rows).columns))
    assert {(r["id"], r["vendor_name"]) for r in csv.collect()} == {(1, 'He said "x"\nnext'), (2, None)}
    back = spark.read.json(paths["json"])
    assert set(back.columns) == set(export.export_view(rows).columns)
    assert {r["filename"] for r in back.collect()} == {"a,b.jpg", "é.jpg"}
    assert export.export(rows, work_dir(spark, "x"), "xml") == {}
    empty = export.export(rows.limit(0), work_dir(spark, "x"))
    assert spark.read.schema(export.export_view(rows).schema).json(empty["json"]).count() == 0


def test_exact_median(spark):
    random.seed(3)
    values = [("hot", round(random.expovariate(0.01), 2)) for _ in range(3001)] + [("same", 5.0)] * 100 + [("two", 1.0), ("two", 4.0)]
    got = dict(analytics.exact_median(spark.createDataFrame(values, "g string, v double"), "g", "v").collect())
    hot = sorted(v for g, v in values if g == "hot")
    assert got == {"hot": hot[1500], "same": 5.0, "two": 2.5}


def test_page_rules(spark):
    words = [("Hello", 90.0), (" ", 80.0), ("lost", 0.0), ("world", 50.0)]
    rows = spark.createDataFrame([(1, 1, "a", i, w, c) for i, (w, c) in enumerate(words)],
                                 "doc_id bigint, page_no bigint, engine string, pos int, word string, conf double")
    built = pages.pages_from_words(rows)
    first = pages.page_text(built).first()
    assert (first["text"], first["conf"]) == ("Hello world", 70.0)
    alt = pages.page_text_alt(built.withColumn("words", F.transform("words", lambda w: F.struct(
        w["word"].alias("word"), (w["conf"] / 100).alias("conf"))))).first()
    assert alt["text"] == "Hello lost world"
    chosen = pages.choose_engine(pages.page_text(built), pages.page_text_alt(built)).first()
    assert (chosen["engine"], chosen["text"]) == ("easyocr", "Hello lost world")


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"x")
    rows = hash_files(scan_files(spark, str(tmp_path))).select("filename", "file_hash").collect()
    assert [tuple(r) for r in rows] == [("a.PDF", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(i, f"f{i}.pdf", f"INV-{i}", "2024-01-01", ["Acme Parts", "Acme Tools", "Bolt Works"][i % 3], "Buyer Co", "USD" if i % 2 else "EUR",
             "en", "PASSED", float(i) if i % 7 else None, f"line items number{i % 5} of acme") for i in range(1, 61)]
    return spark.createDataFrame(rows, "id bigint, filename string, invoice_number string, invoice_date string, vendor_name string, "
                                 "buyer_name string, currency string, detected_language string, validation_status string, "
                                 "total_amount double, raw_text string").cache()


def test_search_paths_agree(spark, shop):
    postings = search.build_postings(shop).cache()
    ids = lambda df: {r["id"] for r in df.collect()}
    for wanted in [search.Request(q="bolt number3"), search.Request(vendor="tools", currency="USD"),
                   search.Request(q="works", min_amount=10.0, max_amount=40.0), search.Request(currency="EUR", min_amount=0.0)]:
        one = ids(search.search_one(shop, postings, wanted))
        text = [t for t in (wanted.q or "").split()]
        brute = {r["id"] for r in search.facet_filter(shop, wanted).collect()
                 if all(t in f"{r['vendor_name']} {r['buyer_name']} {r['raw_text']}".lower() for t in text)
                 and (wanted.vendor or "") in r["vendor_name"].lower()}
        assert one == brute and one
    assert ids(search.search_one(shop, postings, search.Request(q="INV-17"))) == {17}
    assert ids(search.scan_search(shop, search.Request(q="100%"))) == set()


def test_index_update_equals_rebuild(spark, shop):
    changed = shop.where("id % 10 = 0").withColumn("vendor_name", F.lit("Renamed Houses"))
    table = shop.where("id % 10 <> 0").unionByName(changed)
    updated = search.update_postings(search.build_postings(shop), changed)
    assert sorted(map(tuple, updated.collect())) == sorted(map(tuple, search.build_postings(table).collect()))


def test_vendor_scan_is_exact(spark, shop):
    asked = spark.createDataFrame([(1, "acme"), (2, "t"), (3, "WORK"), (4, "zzz"), (5, "acme"), (6, ""), (7, None)],
                                  "query_id bigint, vendor string")
    got = {}
    for r in search.vendor_scan_batch(asked, shop, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    rows = [(r["id"], r["vendor_name"].lower()) for r in shop.collect()]
    want = {q: sorted(i for i, v in rows if t.lower() in v)[:4] for q, t in [(1, "acme"), (2, "t"), (3, "work"), (5, "acme"), (6, ""), (7, "")]}
    assert got == want


def test_requests_without_words(spark, shop):
    index = search.write_index(shop, work_dir(spark, "index"))
    asked = spark.createDataFrame(
        [(1, None, None, "USD", None, None, None, None), (2, "the of", None, None, None, None, 10.0, 20.0), (3, "", "", "", "en", "PASSED", None, None),
         (4, None, None, None, None, None, None, None), (5, "bolt", None, "EUR", None, None, None, None), (6, None, None, "XXX", None, None, None, None)],
        "query_id bigint, q string, vendor string, currency string, language string, validation_status string, min_amount double, max_amount double")
    got = {}
    for r in search.search_batch(asked, shop, index, 7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    rows = shop.collect()
    first = lambda test: sorted(r["id"] for r in rows if test(r))[:7]
    assert got[1] == first(lambda r: r["currency"] == "USD")
    assert got[2] == first(lambda r: r["total_amount"] is not None and 10 <= r["total_amount"] <= 20)
    assert got[3] == got[4] == first(lambda r: True)
    assert len(got[5]) == 7 and 6 not in got


def test_a_written_index_is_read_once_per_use(spark, shop):
    from test_catalog import plan_of

    index = search.write_index(shop, work_dir(spark, "index"))
    built = sorted(map(tuple, search.build_postings(shop).collect()))
    assert sorted(map(tuple, index.postings.collect())) == built
    asked = spark.createDataFrame([(1, "bolt number3")], "query_id bigint, q string").withColumn("vendor", F.lit(None).cast("string"))
    assert "NestedLoop" not in plan_of(search.search_batch(asked, shop, index, 5))


def test_store_replay_and_idle_restart(spark):
    from ledgerloom.streaming import intake

    def batch(names):
        text = "Invoice No: {0}-1\nInvoice Date: 2024-03-01\nFrom: {0} Mill\nTotal: 10.00 USD"
        rows = [(i, f"{n}.pdf", text.format(n), 1) for i, n in enumerate(names)]
        df = spark.createDataFrame(rows, "doc_id bigint, filename string, text string, ingest_seq int")
        return df.withColumn("file_hash", F.sha2("text", 256))

    root, now = work_dir(spark, "store"), F.expr(NOW)
    content = lambda: sorted((r["id"], r["filename"], r["invoice_number"]) for r in intake.current_records(spark, root).collect())
    intake.merge_batch(batch([]), root, 0, now)
    assert content() == []
    intake.merge_batch(batch(["ash", "elm"]), root, 1, now)
    intake.merge_batch(batch(["oak", "oak"]), root, 2, now)
    before = content()
    assert [i for i, _, _ in before] == [1, 2, 3]
    intake.merge_batch(batch(["oak", "oak"]), root, 2, now)  # delivered again
    assert content() == before
    intake.merge_batch(batch([]), root, 3, now)
    assert content() == before
    # the index follows the rows: postings of each batch, the same as of a build over the whole table
    from ledgerloom.operators.search import build_postings
    again = batch(["elm", "yew"]).withColumn("filename", F.concat(F.lit("new-"), "filename"))
    intake.merge_batch(again, root, 4, F.expr(NOW) + F.expr("INTERVAL 1 DAY"))
    rows = {r["filename"]: r for r in intake.stored_table(spark, root).collect()}
    assert {f: r["id"] for f, r in rows.items()} | dict.fromkeys(["ash.pdf", "new-elm.pdf"], 0) == {
        "ash.pdf": 0, "new-elm.pdf": 0, "oak.pdf": 3, "new-yew.pdf": 4}
    assert rows["new-elm.pdf"]["processed_at"] == rows["ash.pdf"]["processed_at"] < rows["new-yew.pdf"]["processed_at"]
    index, whole = intake.current_index(spark, root), build_postings(intake.stored_table(spark, root))
    rows_of = lambda df: sorted(map(tuple, df.select("field", "term", "doc_id", "tf", "len").collect()))
    assert rows_of(index.postings) == rows_of(whole) and {d for _, t, d, _, _ in rows_of(whole) if t == "yew"} == {4}
    assert index.stats.select("n_docs").distinct().first()[0] == 4
    # a batch that an earlier failure left half-done is written over by its replay
    intake.merge_batch(batch(["fir"]), root, 5, now)
    intake.merge_batch(batch(["fir", "bay"]), root, 5, now)
    assert len(content()) == 6 and [i for i, _, _ in content()] == [1, 2, 3, 4, 5, 6]
