"""What keeps the cost of large tables down: cheap first tests of patterns, plans without work that nobody asks for."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.text import all_matches, quick_pattern
from ledgerloom.plans import catalog
from test_catalog import FOLDER, plan_of


def test_quick_patterns_find_the_same(spark):
    """Labels, values and odd neighbours in random order: the plain pattern and the quick one have the same group 1."""
    draw = random.Random(3)
    words = sorted({w for words in fixed.PATTERN_WORDS.values() for w in words})
    parts = [*words, "Invoice No", "Due Date", "Bill To", "Grand Total", "SUB-TOTAL", "Tax Amount", "vat no", "GSTIN", "P.O. No", "Terms",
             "factura no", "rechnung nr", "date of invoice", "pay by", "29KLMNO4821P1ZQ", "INV-004412", "AB/77123", "2024-03-22", "1.2.2024", "3 May 2023",
             "Net 45", "12 days", "9 Old Street, Town", "$1,234.50", "1.234,56 EUR", "18%", "(5%)", "Ada Mill", "नील", "المجموع", "é",
             "ſ", "K", "\U00010400", "_", "7", "USD", "us"]
    signs = [" ", ": ", "\n", "-", "", "#", ". ", "é", "a", "5", "("]
    texts = ["".join(draw.choice(parts) + draw.choice(signs) for _ in range(draw.randint(1, 14))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").cache()
    for pattern in fixed.PATTERN_STARTS:
        quick = quick_pattern(pattern)
        assert quick != pattern
        if pattern in (fixed.NOT_TOTAL, fixed.DUE_LABEL):
            plain, new = F.regexp_replace("text", pattern, "~"), F.regexp_replace("text", quick, "~")
        else:
            plain, new = F.regexp_extract("text", pattern, 1), F.regexp_extract("text", quick, 1)
        assert rows.where(~plain.eqNullSafe(new)).collect() == [], pattern
    for pattern in [*fixed.CURRENCY_PATTERNS, *fixed.DUE_PATTERNS, *fixed.VENDOR_PATTERNS, *fixed.TAX_RATE_PATTERNS]:
        plain = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda hit: F.trim(hit)))
        assert rows.where(~plain.eqNullSafe(all_matches(F.col("text"), [pattern]))).collect() == [], pattern


@pytest.mark.parametrize("name", ["quarantine", "batch_summary"])
def test_failures_need_no_extraction(spark, name):
    plan = plan_of(catalog.all_queries()[name](spark, FOLDER))
    assert "Scan parquet" in plan and "/extracted-" not in plan


def test_accuracy_joins_one_row_per_document(spark):
    plan = plan_of(catalog.all_queries()["extraction_accuracy"](spark, FOLDER))
    assert plan.count("- Generate (") == 1


def test_both_exports_read_the_records_once(spark):
    """The plan after the exports has their files only; the records they come from are a written table."""
    seen = []
    write, catalog.export.export = catalog.export.export, lambda rows, *rest: (seen.append(rows), write(rows, *rest))[1]
    try:
        catalog.all_queries()["export_both"](spark, FOLDER)
    finally:
        catalog.export.export = write
    plan = plan_of(seen[0])
    assert "/records-" in plan and "lineitem" not in plan


def test_windows_that_are_no_names_are_not_joined(spark):
    """The filter drops windows by their hash; every name passes."""
    from ledgerloom.operators import entities

    known = entities.known_names(spark.createDataFrame([(f"Mill {i}", "ORG") for i in range(300)], "name string, label string"))
    grams = spark.range(6000).select(F.concat(F.lit("mill "), "id").alias("gram")).withColumn("bits", entities._bits(known))
    passed = {r["gram"] for r in grams.where(entities._may_be_known("gram", "bits")).collect()}
    assert {f"mill {i}" for i in range(300)} <= passed and len(passed) < 350


def test_search_pairs_without_the_other_words_are_dropped(spark):
    """Only documents with both words of a request get past the first step, whose pairs are written."""
    from ledgerloom.operators import search

    docs = spark.createDataFrame([(i, f"{'Lantern' if i % 50 == 0 else 'Kite'} {i % 3 + 70}", "", "", "") for i in range(300)],
                                 "id bigint, vendor_name string, buyer_name string, invoice_number string, raw_text string")
    queries = spark.createDataFrame([(1, "70 lantern", None), (2, "lantern", "72"), (3, "73 lantern", None)],
                                    "query_id bigint, q string, vendor string")
    written, keep = {}, search.stage
    search.stage = lambda df, name, **layout: written.setdefault(name, keep(df, name, **layout))
    try:
        found = search.match(queries, search.build_postings(docs))
    finally:
        search.stage = keep
    assert sorted(r["doc_id"] for r in found.select("query_id", "doc_id").distinct().where("query_id = 1").collect()) == [0, 150]
    assert {r["query_id"] for r in found.collect()} == {1, 2}
    assert written["pairs"].where("query_id = 1").count() <= 6 and written["asked"].count() < 600


def test_scripts_are_counted_in_what_is_left(spark):
    """Counts and first places come from the text without the characters below the scripts, not from the whole text."""
    from ledgerloom.functions.language import with_script

    docs = spark.createDataFrame([(1, "x" * 500 + " абвгде عربيتن"), (2, "é عربيتن абвгде"), (3, "абвгд" + "€" * 50), (4, "नीलकमल"), (5, None)],
                                 "i bigint, text string")
    rows = with_script(docs, "text", "script")
    assert [r["script"] for r in rows.orderBy("i").collect()] == ["ru", "ar", "", "hi", ""]
    plan = plan_of(rows)
    assert "regexp_extract_all(" not in plan and "regexp_instr(text" not in plan


def test_function_words_stand_between_characters_of_no_token(spark):
    """Tokens that cannot be function words are not taken; the rest count as whole tokens, whatever stands beside them."""
    from ledgerloom.functions.language import with_profile

    draw = random.Random(4)
    words = sorted({w for words in fixed.LANGUAGE_WORDS.values() for w in words})
    beside = [" ", ".", "\n", "_", "1", "٣", "²", "\u0308", "\u00a0", "—", "।", "€", "a", "é", "İ", "\u212a", "\U00010400", "\U0001F600", "\x00"]
    texts = [None, "", "DER", *["".join(draw.choice([str.upper, str])(draw.choice(words)) + draw.choice(beside)
                                        for _ in range(draw.randint(1, 25))) for _ in range(1500)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    lists = ", ".join(f"size(filter(t, w -> w IN ({', '.join(repr(w) for w in ws)})))" for ws in fixed.LANGUAGE_WORDS.values())
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(fixed.TOKEN), F.lit(0))
    plain = rows.withColumn("t", tokens).withColumn("n", F.expr(f"array({lists})"))
    plain = plain.select("*", F.array_max("n").alias("hits"), (1 - F.array_position("n", F.array_max("n"))).alias("rank"))
    got = with_profile(plain, "text", "best")
    assert got.where("text IS NOT NULL AND (best.hits <> hits OR best.rank <> rank)").collect() == []
    assert got.where("hits > 0").select("rank").distinct().count() == len(fixed.LANGUAGE_WORDS)
    assert fixed.TOKEN not in plan_of(with_profile(rows, "text", "best"))


def test_first_match_searches_a_text_once(spark):
    from ledgerloom.functions.text import first_match

    rows = spark.createDataFrame([("Terms: net 30.",), ("term",), ("terms: ",), ("",), (None,)], "text string")
    found = rows.select(first_match(F.col("text"), fixed.TERMS_PATTERNS[:1], F.lower("text")).alias("hit"))
    assert [r["hit"] for r in found.collect()] == ["net 30", "", "", "", ""]
    physical = plan_of(found).split("(1) ")[0] + found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("regexp_extract(") == 1


def test_postings_take_words_from_texts_once(spark):
    """Words are counted where they stand; terms of several words and rows without a doc_id of their own meet."""
    from collections import Counter

    from ledgerloom.operators.search import build_postings

    stems = {"walking": "walk", "walks": "walk", "cities": "citi", "exceeding": "exceed", "exceed": "exce"}
    texts = [(1, "walk Walking walks tree"), (1, "tree tree the x walk 17"), (1, "tree"), (2, "cities citi 17 17 é١"), (3, ""), (4, None),
             (None, "tree a"), (None, "tree"), (5, "the x"), (6, "exceeding exceed exceed")]
    rows = spark.createDataFrame(texts, "id bigint, raw_text string")
    want = Counter()
    for i, text in texts:
        words = [w for w in (text or "").lower().split() if len(w) > 1 and w != "the"]
        want.update(("raw_text", stems.get(w, w), i, len(words)) for w in words)
    built = build_postings(rows, ["raw_text"])
    assert {(r["field"], r["term"], r["doc_id"], r["len"]): r["tf"] for r in built.collect()} == want and built.count() == len(want)
    assert "regexp_extract_all" not in plan_of(built)


def test_all_matches_test_the_first_letter(spark):
    """A sign between two hits belongs to the first of them; the start of a text is an edge."""
    rows = spark.createDataFrame([("USD EUR;GBP,,INR USD",), ("xUSD",), ("due date 2024-01-02due date 2024-01-03 pay by 2024-01-04",)], "text string")
    found = rows.select(all_matches(F.col("text"), [fixed.CURRENCY_PATTERNS[0], *fixed.DUE_PATTERNS]).alias("hits"))
    assert [r["hits"] for r in found.collect()] == [["USD", "GBP", "INR"], [], ["2024-01-02", "2024-01-04"]]
    assert plan_of(found).count(r"(?!\G)") >= 2


def test_exports_of_both_are_compressed(spark):
    import os

    seen, write = [], catalog.export.export
    catalog.export.export = lambda *given: (seen.append(write(*given)), seen[-1])[1]
    try:
        got = catalog.all_queries()["export_both"](spark, FOLDER).collect()
    finally:
        catalog.export.export = write
    parts = [f for path in seen[0].values() for f in os.listdir(path) if f.startswith("part-")]
    assert parts and all(f.endswith(".gz") for f in parts) and len({(r["n"], r["ids"]) for r in got}) == 1
