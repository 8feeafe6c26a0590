import pytest

import corpus_pipeline
from compare import compare, connect
from ledgerloom.llm import queries
from ledgerloom.llm.decontaminate import normal_words
from ledgerloom.llm.line_rules import measures
from ledgerloom.llm.private import base_spans

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.all_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, queries.all_queries()[name], queries.all_sql()[name], FOLDER) == ""


def test_stages(spark):
    """Each stage's decisions are in what the next one gets."""
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    columns = docs.columns
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER).cache()
        seen.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    start, good, single, clean, masked, mixed = [[r.asDict() for r in d.collect()] for d in seen]
    assert {r["doc_id"] for r in good} <= {r["doc_id"] for r in start if not measures(r["text"])["base_failed"]}
    from test_near_dups import brute
    roots = brute([(r["doc_id"], r["text"]) for r in good])
    assert sorted(r["doc_id"] for r in single) == sorted(set(roots.values()))
    items = [" ".join(normal_words(r["text"])) for r in corpus_pipeline.table(spark, FOLDER, "benchmark").collect()]
    exact = {r["doc_id"] for r in single if any(f" {i} " in f" {' '.join(normal_words(r['text']))} " for i in items)}
    assert exact and not exact & {r["doc_id"] for r in clean}
    assert len(masked) == len(clean) and not any(base_spans(r["text"]) for r in masked)
    before = {r["doc_id"]: r["text"] for r in clean}
    assert all(r["text"] == before[r["doc_id"]] for r in masked if not base_spans(before[r["doc_id"]]))
    assert mixed and {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in masked} and all(1 <= r["copies"] <= 3 for r in mixed)
    run = {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert run == {r["doc_id"] for r in mixed}


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, copies string"
    for rows in ([], [(None, None, None, None, None, None, None)], [(1, "word " * 60, "en", "s", 1, "x", "y")] * 3):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        assert docs.count() <= len(rows)


def test_exact_rows_of_first_stages(spark):
    docs = corpus_pipeline.table(spark, FOLDER, "documents")
    rows = lambda d: sorted(map(tuple, d.collect()))
    good = [r for r in docs.collect() if not measures(r["text"])["base_failed"]]  # no line is above the limits here
    assert rows(corpus_pipeline.quality(spark, docs, FOLDER)) == sorted(map(tuple, good))


def test_texts_that_share_an_id(spark, docs_of, prose):
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, a), (2, b), (2, c), (2, c), (3, c + " more"), (4, a), (None, a), (5, a, "t"), (5, prose(70, 5), "u")]
    stage = lambda rows: sorted((str(r["doc_id"]), r["text"], r["source"]) for r in corpus_pipeline.near_duplicates(
        spark, docs_of(rows), "").collect())
    got = stage(rows)
    assert sorted(x for x in got if "more" not in x[1] and x[1] != c) == sorted(
        [("1", a, "s"), ("2", b, "s"), ("None", a, "s"), ("5", prose(70, 5), "u")])
    assert len([x for x in got if x[1].startswith(c)]) == 1  # of doc 2's second text and doc 3's, which are linked
    assert stage(rows[::-1]) == got
    twice = [(1, a, "x"), (1, a, "y")]
    assert stage(twice) == stage(twice[::-1]) and len(stage(twice)) == 1


def test_mix_of_texts_that_share_an_id(spark, docs_of, prose):
    """Every row has its own size and copies, and all of them come out as by hand."""
    from ledgerloom.llm.mixing import pareto_mix

    rows = [(5, prose(10, 1), "a"), (5, prose(700, 2), "b"), (None, prose(3, 3), "a"), (None, prose(90, 4), "b"), (None, prose(90, 4), "b"),
            (7, prose(60, 5), "b"), (7, prose(60, 6), "b"), (8, None, "a"), (9, "", None), (10, prose(40, 7), None)]
    rows += [(100 + i, prose(20 + i, 50 + i), "abc"[i % 3]) for i in range(60)]
    stage = lambda rows: sorted(((r["doc_id"], r["text"], r["source"], r["size"], r["copies"], r["taken"]) for r in corpus_pipeline.mix(
        spark, docs_of(rows, "copies target"), "").collect()), key=str)
    got = stage(rows)
    assert got == stage(rows[::-1])
    assert all(size == len((text or "").split()) and taken == size * copies and copies > 0 for _, text, _, size, copies, taken in got)
    from collections import Counter
    have, drawn = Counter((i, t, s) for i, t, s in rows), Counter((i, t, s) for i, t, s, *_ in got)
    assert all(n <= have[k] for k, n in drawn.items())
    # the same rows as the operator takes, one by one
    taken = Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in pareto_mix(docs_of(rows)).where("copies > 0").collect())
    assert sorted(taken.items(), key=str) == sorted(Counter((i, s, n, c) for i, _, s, n, c, _ in got).items(), key=str)
    # words taken come near the targets: by the half of the largest text of the source at most
    for source in "abc":
        of = [r for r in pareto_mix(docs_of(rows)).collect() if r["source"] == source]
        assert abs(sum(r["taken"] for r in of) - of[0]["target"]) <= max(r["size"] for r in of)
