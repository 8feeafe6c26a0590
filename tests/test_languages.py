import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import languages

WORDS = {"en": "the house of with that this water think which through", "fr": "les maison avec que eau pense quel travers été à",
         "de": "das haus mit dass wasser denken welche durch für über"}


def text_of(lang, n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text_of(lang, 40, i), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(None, "teaches nothing", "en"), (900, None, "fr"), (901, "xx xx xx", "xx"), (902, "no label", None)]
    return languages.learn_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def detected(spark, model, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gram string, n_grams int")
    got = languages.detect_languages(docs, model, ["doc_id"]).collect()
    assert len(got) == len(texts)
    return [r["lang_code"] for r in sorted(got, key=lambda r: r["doc_id"])]


def test_model_table_is_bounded(model):
    assert set(model.unseen) == {"en", "fr", "de"}
    rows = model.grams.collect()
    assert len(rows) <= 3 * languages.GRAMS and len({r["gram"] for r in rows}) == len(rows)
    assert all(r[f"w_{c}"] >= model.unseen[c] for r in rows for c in model.unseen)
    few = next(r for r in rows if r["gram"] == " ho")  # an English trigram that isn't German: the same weight as unseen
    assert few["w_fr"] == model.unseen["fr"] < few["w_en"]


def test_detects(spark, model):
    texts = [text_of(c, 8, s) for s in range(5) for c in WORDS]
    assert detected(spark, model, texts) == ["en", "fr", "de"] * 5


def test_odd_texts(spark, model):
    texts = [None, "", "maison", "1234567890 1234567890 +++", "счёт на оплату товара", "x" * 300_000, "a b " * 50_000 + "maison " * 40_000,
             "これは請求書です。合計金額は千円です。お支払いください。"]
    assert detected(spark, model, texts)[:5] == ["en", "en", "en", "en", "ru"]
    assert detected(spark, model, texts)[6:] == ["fr", "ja"]


def test_trigrams_have_a_letter_in_the_middle(spark):
    df = spark.createDataFrame([("Ab, é1c\U0001F600d",), (None,), ("--",)], "t string")
    got = [r[0] for r in df.select(languages.trigrams(F.col("t"))).collect()]
    assert got == [[" ab", "ab ", " é ", " c ", " d "], [], []]


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert languages.detect_languages(none, model, ["doc_id"]).count() == 0
    empty = languages.learn_languages(none)
    assert empty.unseen == {} and empty.grams.count() == 0
    assert detected(spark, empty, ["les maisons avec de l'eau", "счёт на оплату товара"]) == ["en", "ru"]


def test_ties_take_the_first_code(spark):
    rows = [(i, "same same words", lang) for i, lang in enumerate(["fr", "de"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fair = languages.LanguageModel(spark.createDataFrame([("sam", -5, -5)], "gram string, w_de bigint, w_fr bigint"), {"de": -9, "fr": -9})
    best = languages.score_languages(docs, fair, ["doc_id"], F.col("text")).collect()
    assert len(best) == 40 and {r["best"]["lang"] for r in best} == {"de"}
    assert {(r["best"]["score"], r["n_grams"]) for r in best} == {(-5 * 2 - 9 * 11, 13)}


def test_repeated_rows_stay(spark, model):
    docs = spark.createDataFrame([(1, text_of("de", 9, 1))] * 3, "doc_id bigint, text string")
    assert languages.detect_languages(docs, model, ["doc_id"]).count() == 3
