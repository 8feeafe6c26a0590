import math

import numpy as np
import pytest

from ledgerloom.llm import adaptive_scan


def table_of(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id bigint, embedding array<{kind}>, rank string, score int")


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k, every=20):
    """query_id -> [(vec_id, score)] for distinct ids."""
    held = {i: np.array(v) for i, v in rows if i is not None and usable(v)}
    out = {}
    for q, v in held.items():
        if q % every == 0:
            hits = sorted((-float((v * w).sum()), i) for i, w in held.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in hits[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, wanted):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in wanted.items()) / sum(map(len, wanted.values()))


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(0, 1, 8).tolist()) for i in range(200)]
    rows += [(200 + i, [0.25] * 8) for i in range(150)]  # one vector with many ids, queries among them
    rows += [(-20, [9.0] + [0.0] * 7), (400, [1.0, 2.0]), (401, [3.0, 1.0]), (420, [1.0] * 5), (440, None), (460, [0.0] * 8),
             (480, [float("nan")] * 8), (500, [float("inf")] + [0.0] * 7), (520, [None] * 8), (None, [1.0] * 8), (540, [])]
    got, wanted = found(adaptive_scan.nearest_vectors(table_of(spark, rows + rows[:30]))), brute(rows, 20)
    wanted = {q: w for q, w in wanted.items() if w}  # a vector alone of its length has no candidates
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in wanted.items()}
    assert all(abs(a - b) < 1e-12 for q in wanted for (_, a), (_, b) in zip(got[q], wanted[q]))


@pytest.mark.parametrize("spread", [0.15, 10.0])
def test_recall_over_many_lists(spark, spread, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "LEAST_ROWS", 128)
    monkeypatch.setattr(adaptive_scan, "MOST_ROWS", 256)
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 1, (40, 24))
    rows = [(i, (centres[i % 40] + draw.normal(0, spread, 24)).astype(np.float32).tolist()) for i in range(6000)]
    df = table_of(spark, rows, "float")
    got, wanted = found(adaptive_scan.nearest_vectors(df)), brute(rows, 20)
    assert recall(got, wanted) >= 0.97
    nodes, _ = adaptive_scan.distinct_vectors(adaptive_scan.usable(df), adaptive_scan.F.col("vec_id") % 20 == 0, 20)
    index = adaptive_scan.fit_index(nodes, 20)
    assert len(index.centres) >= 20
    if spread < 1:
        assert index.probes < len(index.centres) / 2  # clustered data need few lists


def test_early_abandoning_drops_most_pairs_and_few_neighbours():
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (20, 64))
    rows = centres[np.arange(1024) % 20] + draw.normal(0, 0.3, (1024, 64))
    square = float((rows * rows).sum(1).max())
    turn, _ = np.linalg.qr(draw.standard_normal((65, 65)))
    index = adaptive_scan.Index(turn, np.zeros((1, 65)), np.zeros(1), rows[:256], 1.0, square, 1)
    part = adaptive_scan._List(index, rows, np.arange(1024))
    queries = rows[::64]
    asked = index.asked(queries)
    scores = queries @ rows.T
    limit = (asked * asked).sum(1) + square - 2 * np.sort(scores, axis=1)[:, -21]
    blocks = [asked[:, a:b].astype(np.float32) for a, b in part.cuts]
    kept, tested = 0, blocks[0].shape[1]
    first = np.abs(adaptive_scan._distances(asked[:, :tested], index.placed(rows)[:, :tested]))
    bound = limit * (tested / 65) * (1 + adaptive_scan.ERRORS / math.sqrt(tested)) ** 2
    assert (first > bound[:, None]).mean() > 0.5  # gone after the first column block
    q, x = adaptive_scan._survivors(part.groups[0][1], blocks, limit, 1e-4 * square, 65)
    pairs = set(zip(q.tolist(), x.tolist()))
    for i, s in enumerate(scores):
        kept += sum((i, int(j)) in pairs for j in np.argsort(-s)[:21])
    assert kept >= 0.98 * 21 * len(queries) and len(pairs) < 2 * 21 * len(queries)


def test_very_large_and_small_components(spark):
    rows = [(i, [float(i + 1) * 1e30, -1e30, 1e-30]) for i in range(60)]
    got, wanted = found(adaptive_scan.nearest_vectors(table_of(spark, rows), k=3)), brute(rows, 3)
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in wanted.items()}


def test_empty(spark):
    df = adaptive_scan.nearest_vectors(table_of(spark, []))
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and not df.count()
    assert found(adaptive_scan.nearest_vectors(table_of(spark, [(20, [1.0])]))) == {}
