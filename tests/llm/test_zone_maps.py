import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import zone_maps


def brute(rows, k=zone_maps.CENTROIDS, rounds=zone_maps.ROUNDS):
    """(vec_id, cluster, distance) and centroids, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and abs(x) < 2 ** 19 for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds if centroids else 0):
        found = assign()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, x, _) in zip(kept, found) if x == c]
            if mine:
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    return assign() if centroids else [], centroids


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    side = np.arange(1 << bits)
    points = np.stack(np.meshgrid(*[side] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = zone_maps.hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(len(points)))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_boxes_rule_out_no_nearest_centroid():
    draw = np.random.default_rng(3)
    for _ in range(50):
        rows = draw.integers(-300, 300, (20, 8))
        rows[:, 1:] //= 20
        centroids = draw.integers(-300, 300, (30, 8))
        centroids[5] = centroids[4]  # a tie
        some = zone_maps.candidates(rows.min(0), rows.max(0), centroids)
        every = np.arange(30)
        assert all((a == b).all() for a, b in zip(zone_maps.nearest(rows, centroids, some), zone_maps.nearest(rows, centroids, every)))
    assert len(zone_maps.candidates(np.full(8, 5), np.full(8, 5), np.arange(30)[:, None] * np.ones(8, int))) == 1


def test_large_components_are_exact():
    rows = np.array([[2 ** 26 + 1, -2 ** 26], [2 ** 26, -2 ** 26 + 1]], np.int64)
    centroids = np.array([[-2 ** 26, 2 ** 26], [-2 ** 26 + 1, 2 ** 26]], np.int64)
    cluster, distance = zone_maps.nearest(rows, centroids, np.arange(2))
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in centroids] for r in rows]
    assert cluster.tolist() == [w.index(min(w)) for w in wanted] and distance.tolist() == [min(w) for w in wanted]


def table_of(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, cluster string, place string")


def result(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    draw = np.random.default_rng(7)
    centres = draw.normal(0, 1, (12, 64))
    rows = [(i, (centres[i % 12] + draw.normal(0, 0.2, 64)).tolist()) for i in range(600)]
    rows += [(1000 + i, [0.5] * 64) for i in range(300)]  # one vector holds a third of the rows
    rows += [(5, rows[5][1]), (None, rows[6][1]), (7000, None), (7001, [1.0] * 63), (7002, [float("nan")] + [0.0] * 63),
             (7003, [float("inf")] + [0.0] * 63), (7004, [None] + [0.0] * 63), (7005, []), (7006, [1e9] + [0.0] * 63),
             (7007, [0.0] * 64), (7008, [500000.0] + [-1.0] * 63)]
    found = zone_maps.cluster_vectors(table_of(spark, [(*r, "x", "y") for r in rows], "double"))
    wanted, centroids = brute([(i, v if v is None or not any(x is not None and not math.isfinite(x) for x in v) else None)
                               for i, v in rows])
    assert result(found) == sorted(wanted, key=str)
    total = {}
    for _, c, d in wanted:
        total[c] = total.get(c, 0) + d
    for r in found.collect():
        assert r["cluster_inertia"] == total[r["cluster"]] and r["inertia"] == sum(total.values())
        digest = hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["centroid_sha256"] == digest


def test_few_rows_and_ties(spark):
    for rows in ([], [(None, [1.0] * 64)], [(1, None)], [(1, [0.5] * 64)], [(1, [0.5] * 64)] * 3,
                 [(i, [float(i % 2)] * 64) for i in range(6)]):
        found = zone_maps.cluster_vectors(table_of(spark, [(*r, None, None) for r in rows]))
        assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert result(found) == sorted(brute(rows)[0], key=str)
