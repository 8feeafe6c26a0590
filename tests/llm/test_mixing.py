from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import MAX_COPIES, WEIGHTS, pareto_mix


def targets(sizes):
    """Resharing in rounds, as the rule is worded."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    out, held, rest = {}, set(), float(sum(sizes.values()))
    while True:
        free = [s for s in order if s not in held]
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        over = [s for s in free if share[s] > MAX_COPIES * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(MAX_COPIES * sizes[s])
            held.add(s)
            rest -= out[s]
        if len(held) == len(order):
            return out


def test_mix(docs_of, prose):
    rows = [(i, prose(20 + i % 200, i), ["big", "big", "big", "b", "c", "\U0001F600", "�", None][i % 8] if i % 50 else "tiny") for i in range(900)]
    rows += [(900, None, "c"), (901, "", "empty"), (None, "a b c", "b"), (5, rows[5][1], "b"), (902, "w " * 30_000, "big")]
    docs = docs_of(rows, "size key u q")
    got = pareto_mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pareto_mix(docs).collect()), key=str)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= MAX_COPIES * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max([r["size"] for r in got if r["source"] == s])
    assert pareto_mix(docs.limit(0)).count() == 0
    assert [r["taken"] for r in pareto_mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_unequal_expectations(docs_of):
    docs = docs_of([(i, "five words in this text", "s") for i in range(2000)])
    expected = F.when(F.col("doc_id") % 2 == 0, F.lit(1.6)).otherwise(F.lit(0.2))
    got = pareto_mix(docs, expected=expected).collect()
    mean = lambda odd: sum(r["copies"] for r in got if r["doc_id"] % 2 == odd) / 1000
    assert abs(mean(0) - 1.6) < 0.06 and abs(mean(1) - 0.2) < 0.06 and abs(sum(r["copies"] for r in got) - 1800) <= 1
    assert all(r["copies"] >= 1 for r in got if r["doc_id"] % 2 == 0)


def test_native_plan(docs_of):
    from test_catalog import plan_of

    plan = plan_of(pareto_mix(docs_of([(1, "a b")])))
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
