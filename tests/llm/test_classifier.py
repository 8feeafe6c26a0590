import zlib

import numpy as np

from ledgerloom.llm import classifier


def test_scores(spark, docs_of, prose):
    rows = [(i, prose(80, i) if i % 3 else " ".join(w.upper() + "!!" for w in prose(60, i).split())) for i in range(600)]
    extra = [(1000, None), (1001, ""), (None, "no id here"), (1, rows[1][1]), (1002, "long words " * 20_000)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(5, None, 0), (7, 9, 0), (None, 1, 0), (9999, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    docs = docs_of(rows + extra, "x score quality")
    got = classifier.score_quality(docs, labels)
    result = got.collect()
    assert len(result) == len(rows) + len(extra)
    for r in result:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in result if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r["doc_id"]: r["score"] for r in classifier.score_quality(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in result)
    assert {r["score"] for r in classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.score_quality(docs.limit(0), labels).count() == 0


def test_density_difference_equals_the_formula():
    draw = np.random.default_rng(3)
    d = len(classifier.FEATURES)
    mean, cov = draw.normal(size=d), np.eye(d) + 0.3
    inverse = np.linalg.inv(np.linalg.cholesky(cov))
    model = classifier.Discriminant([(np.log(0.4), mean, inverse, np.linalg.slogdet(cov)[1]), (np.log(0.6), mean + 1, inverse, np.linalg.slogdet(cov)[1])])
    x = draw.normal(size=(5, d))
    log = lambda m: -0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    gap = (np.log(0.6) + log(mean + 1) - np.log(0.4) - log(mean)) / classifier.TEMPER
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-gap)))
