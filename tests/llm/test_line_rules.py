import corpus_pipeline
from ledgerloom.llm.line_rules import clean_documents, judge_quality, measures


def test_base_figures():
    text = "a b c a b c\nx é#\n\na b c a b c\n \t\nx é#"
    m = measures(text)
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"]) == (16, 18, 2, 2)
    words, seen = text.split(), set()
    for i in range(len(words) - 2):
        if sum(words[j:j + 3] == words[i:i + 3] for j in range(len(words) - 2)) > 1:
            seen |= {i, i + 1, i + 2}
    assert m["n_repeat_words"] == len(seen) and m["base_failed"]
    assert measures("a b c d\x1ce")["n_words"] == 2 and measures(None)["n_words"] == 0


def test_host_lines(docs_of, prose):
    notice = prose(60, 7)
    rows = [(i, prose(60, 100 + i) + "\n" + notice, "h") for i in range(40)]  # half of their words are the notice
    rows += [(100 + i, f"{notice}\n{notice[:0]}{prose(8, 300 + i)}", "h") for i in range(30)]  # almost only the notice
    rows += [(200 + i, prose(70, 5), "h") for i in range(60)]  # copies are one document
    rows += [(300, notice + "\n" + prose(10, 1), "elsewhere"), (301, None, "h"), (302, "", None), (None, prose(60, 9), None), (303, "one " * 20_000, "h"),
             (0, rows[0][1], "h")]
    got = judge_quality(docs_of(rows, "key lines removed"))
    kept = {(r["doc_id"], r["kept"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert all((i, True) in kept for i in range(40)) and all((100 + i, False) in kept for i in range(30))
    assert all((200 + i, True) in kept for i in range(60))
    assert {(300, True), (301, False), (302, False), (None, True), (303, False)} <= kept
    assert judge_quality(docs_of([])).count() == 0


def test_host_lines_go_from_texts(spark, docs_of, prose):
    notice = "All rights reserved, 2019: " + prose(10, 7)
    other = notice.upper().replace("2019", "7") + "!"  # the same line once levelled
    own = {i: f"{prose(40, 100 + i)}\n\n{prose(40, 200 + i)}" for i in range(40)}
    rows = [(i, f"{other if i % 2 else notice}\n{own[i]}\n{notice}", "h") for i in range(40)]
    rows += [(50, f"{notice}\n{prose(60, 1)}", "elsewhere"), (51, notice, "h"), (52, None, "h"), (None, rows[3][1], "h"),
             (4, rows[4][1], "h"), (4, rows[4][1], "elsewhere")]
    wanted = [(i, own[i]) for i in range(40)] + [(50, rows[40][1]), (None, own[3]), (4, own[4]), (4, rows[4][1])]
    docs = docs_of(rows, "key host gone kept")
    order = lambda r: (str(r[0]), r[1])
    got = clean_documents(docs)
    assert got.columns == docs.columns and {r["gone"] for r in got.collect()} == {"clash"}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=order) == sorted(wanted, key=order)
    stage = corpus_pipeline.quality(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in stage), key=order) == sorted(wanted, key=order)
    assert all(r["n_chars"] == len(r["text"]) for r in stage)


def test_large_hosts_and_words_left(docs_of, prose):
    """The limit is the same in a large host as in a small one, and the query judges as the texts that go on are."""
    notice, rare, short = prose(12, 7), prose(12, 6), prose(45, 8)
    rows = [(i, prose(60, 1000 + i) + (f"\n{notice}" if i < 21 else f"\n{rare}" if i < 41 else ""), "h") for i in range(700)]
    rows += [(1000 + i, f"{prose(60 if i % 2 else 15, 9000 + i)}\n{short}", "k") for i in range(30)]  # 15 of 60 words left
    docs = docs_of(rows)
    got = {r["doc_id"]: r["text"] for r in clean_documents(docs).collect()}
    assert all(got[i] == rows[i][1].split("\n")[0] for i in range(21))  # in 21 texts: over 20
    assert all(got[i] == rows[i][1] for i in range(21, 700))  # in 20 texts
    assert {i for i in got if i >= 1000} == {1000 + i for i in range(1, 30, 2)}
    judged = judge_quality(docs).collect()
    assert {r["doc_id"] for r in judged if r["kept"]} == set(got) and not any(r["base_failed"] for r in judged)
    assert sum(not r["kept"] for r in judged) == 15  # the method's verdict, beyond the base rules
