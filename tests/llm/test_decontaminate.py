import random

from ledgerloom.llm.decontaminate import WORDS_PER_ERROR, best_match, find_passages, normal_words, without_passages


def brute_distance(pattern, words):
    """Least edit distance of the pattern to any part of words, by the full table."""
    row = [0] * (len(words) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != w)))
        row = new
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    draw = random.Random(1)
    for _ in range(400):
        pattern = [draw.choice("abc") for _ in range(draw.randint(1, 90))]
        words = [draw.choice("abc") for _ in range(draw.randint(0, 60))]
        assert best_match(pattern, words)[0] == brute_distance(pattern, words)


def test_equals_brute_force(spark, docs_of, prose):
    draw = random.Random(2)
    items = [(i, prose(draw.choice([1, 3, 7, 20, 45]), i)) for i in range(25)] + [(90, ""), (91, None), (92, "?!")]
    rows = []
    for d in range(60):
        words = prose(draw.randint(0, 120), 1000 + d).split()
        if d % 3:
            passage = normal_words(items[draw.randrange(25)][1])
            for _ in range(draw.randint(0, len(passage) // 4)):
                passage[draw.randrange(len(passage))] = draw.choice(["", "new", "two words"])
            at = draw.randint(0, len(words))
            words[at:at] = passage
        rows.append((d, " ".join(words).upper().replace(" ", draw.choice([" ", "\n", ", "]))))
    rows += [(60, None), (61, ""), (0, rows[0][1]), (None, items[3][1])]
    want = set()
    for d, text in rows:
        for i, item in items:
            pattern, words = normal_words(item), normal_words(text)
            if pattern and words and brute_distance(pattern, words) <= len(pattern) // WORDS_PER_ERROR:
                want.add((d, i))
    docs = docs_of(rows, "item_id distance")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (40, 1_000_000):
        got = find_passages(docs, bench, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        kept = without_passages(docs, bench, block)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in {x for x, _ in want})
    assert find_passages(docs, bench.limit(0)).count() == 0 and find_passages(docs.limit(0), bench).count() == 0
