from ledgerloom.operators import phrases

TEXTS = ["The searching party found a lantern, the lantern house.", "Lantern houses search parties", "lantern lantern lantern",
         "state of the art lanterns", "", None, "x " * 50_000 + "state of any art"]


def answers(spark, requests, texts=TEXTS):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id bigint, raw_text string, word string")
    asked = spark.createDataFrame(requests, "query_id bigint, kind string, words array<string>")
    got = phrases.answer_requests(asked, phrases.positional_postings(docs, "raw_text")).collect()
    return sorted((r["query_id"], r["doc_id"], r["n"]) for r in got)


def test_kinds(spark):
    got = answers(spark, [
        (1, "phrase", ["lantern", "house"]), (2, "phrase", ["house", "lantern"]), (3, "phrase", ["Lantern"]),
        (4, "phrase", ["lantern", "lantern"]), (5, "phrase", ["state", "of", "the", "art"]), (6, "phrase", ["search", "party"]),
        (11, "prefix", ["lan"]), (12, "prefix", ["search"]), (13, "prefix", ["l"]), (14, "prefix", ["zz"]),
        (21, "any", ["houses", "art"]), (22, "any", ["missing"]), (23, "any", ["lantern", "lanterns"])])
    assert got == [(1, 0, 1), (1, 1, 1), (3, 0, 2), (3, 1, 1), (3, 2, 3), (3, 3, 1), (4, 2, 2), (5, 3, 1), (5, 6, 1), (6, 0, 1), (6, 1, 1),
                   (11, 0, 1), (11, 1, 1), (11, 2, 1), (11, 3, 1), (12, 0, 1), (12, 1, 1),
                   (21, 0, 1), (21, 1, 1), (21, 3, 1), (21, 6, 1), (23, 0, 1), (23, 1, 1), (23, 2, 1), (23, 3, 1)]


def test_odd_requests_find_nothing(spark):
    assert answers(spark, [(1, "phrase", []), (2, "phrase", None), (3, "any", ["the", None]), (4, "other", ["lantern"]),
                           (5, None, ["lantern"]), (6, "phrase", ["the", "of"]), (7, "prefix", []), (8, "prefix", [""])]) == []
    assert answers(spark, []) == [] and answers(spark, [(1, "any", ["lantern"])], []) == []
