import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=""):
        """Documents from (doc_id, text[, source]) rows; extra adds a column whose name an operator uses itself."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in extra.split():
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make


@pytest.fixture(scope="session")
def prose():
    def make(n, seed):
        draw = random.Random(seed)
        vocabulary = ["".join(draw.choice("abcdeilnorst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
        return " ".join(draw.choice(vocabulary) for _ in range(n))
    return make
