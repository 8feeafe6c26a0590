import random

import numpy as np
import pytest

from ledgerloom.llm import near_dups, sketch


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    ids = sorted({d for d, _ in rows if d is not None})
    of = {d: shingles(t) for d, t in rows if d is not None}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(of[a] & of[b])
            if of[a] and of[b] and 100 * both >= 75 * (len(of[a]) + len(of[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.fixture(scope="module")
def corpus(prose):
    draw = random.Random(11)
    rows = []
    for d in range(150):
        rows.append((d, prose(draw.choice([1, 3, 4, 5, 30, 120, 400]), d)))
    base = prose(150, 9000).split()
    for d in range(150, 260):  # a dense group with similarities around the limit
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"new{draw.random():.4f}"
        rows.append((d, " ".join(words)))
    rows += [(300 + i, rows[40 + i][1].upper()) for i in range(20)] + [(400 + i, "short text") for i in range(8)]
    rows += [(500, None), (501, ""), (502, " \n"), (None, rows[0][1]), (3, rows[3][1]), (503, "long " + prose(20_000, 1)), (504, prose(20_000, 1))]
    draw.shuffle(rows)
    return rows


def test_equals_brute_force(docs_of, corpus):
    docs = docs_of(corpus, "id n component registers")
    got = near_dups.link_near_duplicates(docs).collect()
    want = brute(corpus)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (want[r["doc_id"]] == r["doc_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] in (500, 501, 502)} == {500: 0, 501: 0, 502: 0}
    assert near_dups.link_near_duplicates(docs.limit(0)).count() == 0


def test_small_blocks_give_the_same(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    got = near_dups.link_near_duplicates(docs_of(corpus)).collect()
    want = brute(corpus)
    assert all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_registers_merge_and_estimate(prose):
    sketcher = sketch.Sketcher()
    a, b = (np.unique(np.random.default_rng(s).integers(0, 1 << 63, 4000, np.uint64)) for s in (1, 2))
    whole = np.union1d(a, b)
    assert (np.maximum(sketcher.registers(a), sketcher.registers(b)) == sketcher.registers(whole)).all()
    same = (sketcher.registers(a) == sketcher.registers(whole)).mean()
    assert abs(same - 0.5) < 0.12
    n = np.array([float(len(a))])
    r = sketcher.registers(a)[None, :]
    assert sketch.plausible(r, r, n, n)[0] and not sketch.plausible(r, sketcher.registers(b)[None, :], n, n)[0]
