import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                counts.setdefault(lang, Counter()).update(zip(*[words[i:] for i in range(size)]))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in some.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], a)
        rows_ = []
        for p, a in some.items():
            score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                rows_.append((-score, -a, " ".join(p).encode(), a, l, r))
        rows_.sort()
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for i, (s, _, p, a, l, r) in enumerate(rows_[:top])]
    return sorted(out)


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "lang string, text string, phrase string, n int")


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed, count):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé\U0001F600") for _ in range(draw.randint(1, 4))) for _ in range(60)]
    passage = " ".join(draw.choice(vocabulary) for _ in range(70))
    out = []
    for _ in range(count):
        parts = []
        for _ in range(draw.randint(0, 60)):
            word = draw.choice(vocabulary[: draw.choice((5, 20, 60))])
            parts.append(word.upper() if draw.random() < 0.1 else word)
            parts.append(draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", " ", "\x0b"]))
        if draw.random() < 0.3:
            parts.append(passage)
        out.append((draw.choice(["en", "en", "fr", None]), "".join(parts)))
    return out


def test_equals_brute_force(spark):
    rows = texts(1, 500)
    rows += [("de", "a rose is a rose is a rose " * 40)] * 3 + [("de", None), (None, ""), ("xx", " \t.\n"), ("yy", "one two")]
    rows += [("es", "la la " * 20000)]  # a long text of one word: no place starts a chunk, or every one does
    assert got(collocations.mine_collocations(rows_of(spark, rows))) == brute(rows)
    assert got(collocations.mine_collocations(rows_of(spark, rows), reported=5)) == brute(rows, top=5)


def test_a_full_filter_changes_nothing(spark):
    rows = texts(2, 300)
    assert got(collocations.mine_collocations(rows_of(spark, rows), filter_bits=64)) == brute(rows)


def cut(*texts, **limits):
    """The tokens of the texts and the ranges of them that belong to each chunk."""
    parts = [collocations.levelled(t.encode()) for t in texts]
    joined = b"".join(parts)
    found = collocations.Tokens(joined)
    heads = np.searchsorted(found.start, np.cumsum([0, *map(len, parts[:-1])]))
    first, next_ = collocations.chunk_edges(found.hash, heads, **limits)
    return [joined[a:b] for a, b in zip(found.start, found.stop)], list(zip(first.tolist(), next_.tolist()))


def test_tokens(monkeypatch):
    draw = random.Random(9)
    text = "".join(draw.choice(["a", "bc", " ", " ", ".", "\xa0", "é" * 30, "\t"]) for _ in range(3000))
    wanted = re.findall(rb"[^ .]+|\.", collocations.levelled(text.encode()))
    hashes = None
    for segment in (1 << 21, 64, 1):  # cut in few and in many parts, and words longer than a part
        monkeypatch.setattr(collocations, "SEGMENT", segment)
        found = collocations.Tokens(collocations.levelled(text.encode()))
        assert [collocations.levelled(text.encode())[a:b] for a, b in zip(found.start, found.stop)] == wanted
        assert (found.word == np.array([w != b"." for w in wanted])).all()
        assert len(set(zip(wanted, found.hash.tolist()))) == len(set(wanted)) == len(set(found.hash.tolist()))
        assert hashes is None or (hashes == found.hash).all()
        hashes = found.hash
    assert len(collocations.Tokens(b"").start) == 0


def test_chunks_cover_each_token_once():
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a", "b", "c.", "d", "ü"]) for _ in range(n)) for n in (0, 1, 3, 4, 0, 5, 100, 3000, 0)]
    found, edges = cut(*texts, every=8, most=50)
    assert all(a < b <= a + 50 for a, b in edges)
    covered = [i for a, b in edges for i in range(a, b)]
    assert covered == sorted(set(covered))
    tails, at = set(), 0
    for t in texts:
        at += len(cut(t)[0])
        tails |= {at - 1, at - 2, at - 3}
    assert set(covered) == set(range(len(found))) - tails


def test_a_passage_is_cut_alike_in_other_surroundings():
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [draw.choice(vocabulary) for _ in range(1000)]

    def chunks(text):
        found, edges = cut(text)
        return {b" ".join(found[a:b + 3]) for a, b in edges}

    one, two = (chunks(" ".join([draw.choice(vocabulary) for _ in range(200)] + passage)) for _ in range(2))
    assert len(one & two) >= 20


def test_counting_with_equal_hashes():
    left, right = np.array([1, 2, 1, 1], np.uint64), np.array([5, 5, 5, 7], np.uint64)
    first, total = collocations._counted(np.array([9, 9, 9, 3], np.uint64), left, right, np.array([10, 20, 30, 40]))
    assert sorted(zip(left[first].tolist(), right[first].tolist(), total.tolist())) == [(1, 5, 40), (1, 7, 40), (2, 5, 20)]


@pytest.mark.parametrize("rows", [[], [(None, None)], [("en", "...")]])
def test_no_words(spark, rows):
    df = collocations.mine_collocations(rows_of(spark, rows))
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not df.count()


def test_score_of_large_counts(spark):
    big = 9 * 10 ** 12
    phrases = spark.createDataFrame([(7, big, [(1, 1, 2)])], "h bigint, a bigint, cuts array<struct<cut:int,left:bigint,right:bigint>>")
    known = spark.createDataFrame([(1, big + 1), (2, big + 2)], "h bigint, f bigint")
    found = collocations.scored(phrases, known).collect()
    assert [(r["l"], r["r"], r["score"]) for r in found] == [(big + 1, big + 2, 2000000 * big // (2 * big + 3))]
