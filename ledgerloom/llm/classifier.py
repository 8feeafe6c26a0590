"""Quality scores by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_rows, words, written

FEATURES = ("log_words", "word_length", "upper", "symbols", "bars", "marks", "digits", "repeated_next", "top_word",
            "distinct", "line_repeats", "line_words", "ends")
HELD_OUT = 2
PREDICT_AT = 0.7
#: A class covariance is this much the pooled one, and that much the identity times its mean variance.
POOLED, RIDGE = 0.2, 0.02
#: Differences of log densities are divided by this before the logistic function, which keeps scores apart.
TEMPER = 4.0
_SYMBOL = re.compile(r"[#*$%&<>@=_~^{}\[\]\\]")
_MARK = re.compile(r"[!?]")
_DIGIT = re.compile(r"[0-9]")


def _rate(count: float, total: float) -> float:
    """A share on a scale where small shares differ: its square root."""
    return math.sqrt(count / total) if total else 0.0


def features(text: str | None) -> list[float]:
    """Statistics of a whole text; for one without words, those of a text of length 0."""
    found = words(text)
    n = len(found)
    if not n:
        return [0.0] * len(FEATURES)
    n_bytes = sum(map(len, found))
    lines = [line for line in text.split("\n") if line.strip()]
    counts = Counter(found)
    upper = sum(map(str.isupper, text))
    return [
        math.log1p(n), math.log1p(n_bytes / n), _rate(upper, len(text)), _rate(len(_SYMBOL.findall(text)), n_bytes),
        _rate(counts[b"|"], n), _rate(len(_MARK.findall(text)), n_bytes), _rate(len(_DIGIT.findall(text)), n_bytes),
        _rate(sum(a == b for a, b in zip(found, found[1:])), n), _rate(max(counts.values()) - 1, n),
        math.log(len(counts)) / math.log(n + 1), _rate(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))), _rate(text.count("."), n)]


def doc_features(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of FEATURES) for every row of docs, written once."""
    def each(row):
        yield {"doc_id": row["doc_id"], "x": features(row["text"])}

    return written(map_rows(docs.select("doc_id", "text"), each, "doc_id bigint, x array<double>"), "quality-features")


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant."""

    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), 0.5)
        logs = [prior - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - 0.5 * logdet
                for prior, mean, inverse, logdet in self.classes]
        gap = np.clip((logs[1] - logs[0]) / TEMPER, -700, 700)
        return 1 / (1 + np.exp(-gap))


def fit(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """The discriminant from rows (x, quality in 0, 1).

    Spark sums counts, features and their products by class; the driver gets two rows of a fixed number of sums,
    whatever the number of labels. Without rows of both classes all scores are one half.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = [F.col("x")[i] for i in range(d)]
    sums = (labelled.where("quality IN (0, 1)").groupBy("quality")
            .agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)],
                 *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]).orderBy("quality").collect())
    if len(sums) < 2:
        return Discriminant([])
    moments = []
    for row in sums:
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / row["n"] - mean[i] * mean[j]
        moments.append((row["n"], mean, cov))
    total = sum(n for n, _, _ in moments)
    common = sum(n * cov for n, _, cov in moments) / total
    classes = []
    for n, mean, cov in moments:
        cov = (1 - pooled) * cov + pooled * common
        cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        classes.append((math.log(n / total), mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))
    return Discriminant(classes)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    labels (doc_id, quality) with a doc_id whose CRC-32 leaves 2 by 4 are not learned from; labels other than 0 and 1,
    or without a document, count for nothing, repeated rows count each time. Null and empty texts are scored by
    statistics of 0; rows without a doc_id are scored and not held out. Other columns are ignored; an empty table gives
    no rows.
    """
    rows = doc_features(docs)
    train = labels.select("doc_id", "quality").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    classes = fit(train.join(rows, "doc_id")).classes  # two, of a fixed size, sent with the function

    def score(batches):
        import pyarrow as pa

        model = Discriminant(classes)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= predict_at).cast("int").alias("predicted"))
