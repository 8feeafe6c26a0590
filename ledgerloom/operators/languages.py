"""Language detection by character trigrams, learned from labelled texts.

A naive Bayes model over the trigrams inside words. The model is a table of fixed size: the most frequent trigrams of
each language with one integer weight per language, so scores are exact sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.language import stripped, with_script
from ledgerloom.session import stage

#: Texts to learn from at most (about), chosen by a hash of the key; and the thousandths of the keys that are left out
#: of learning whatever their number, to measure on.
TRAIN_TEXTS = 5_000
HELD_OUT = 250
#: Trigrams kept of each language, and what a weight of one stands for.
GRAMS = 1000
WEIGHT_SCALE = 1000


@dataclass(frozen=True)
class LanguageModel:
    """gram, w_<lang> for every language; unseen[lang] is the weight of a trigram that the table doesn't have."""

    grams: DataFrame
    unseen: dict[str, int]


def trigrams(text: Column) -> Column:
    """All three-character pieces of the words of a text whose middle is a letter, words framed by blanks."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")
    return F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit("(?s)(?=(.[^ ].))"), F.lit(1))


def slice_of(key: Column) -> Column:
    """0 to 999 by a hash of the key."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint"), F.lit(1000))


def held_out(key: Column) -> Column:
    return slice_of(key) >= 1000 - HELD_OUT


def learn_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                    train_texts: int = TRAIN_TEXTS, grams: int = GRAMS) -> LanguageModel:
    """The model of the rows whose lang is one of the known codes; the table has `grams` rows per language at most.

    Rows without a key, text or known lang teach nothing. A weight is 1000 times the logarithm of a trigram's share
    among its language's trigrams, with one added to each count, rounded. Without any row the model is empty.
    """
    known = docs.where(F.col(lang).isin(list(fixed.LANGUAGE_NAMES)) & F.col(key).isNotNull() & F.col(text).isNotNull())
    share = min(1000 - HELD_OUT, 1000 * train_texts // max(1, known.count()))
    rows = known.where(slice_of(F.col(key)) < share).select(F.col(lang).alias("lang"), F.explode(trigrams(F.col(text))).alias("gram"))
    counts = stage(rows.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n")), "trigrams")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = (counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= grams)
            .select("gram").distinct())
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # known codes only
    size = kept.count()

    def weight(n: Column, total: int) -> Column:
        return F.round(WEIGHT_SCALE * F.log((n + 1) / F.lit(float(total + size)))).cast("bigint")

    table = counts.join(kept, "gram").groupBy("gram").agg(
        F.sum("n").alias("n"), *[weight(F.coalesce(F.sum(F.when(F.col("lang") == c, F.col("n"))), F.lit(0)), t).alias(f"w_{c}")
          for c, t in sorted(totals.items())])
    unseen = {c: round(WEIGHT_SCALE * math.log(1 / (t + size))) for c, t in sorted(totals.items())}
    return LanguageModel(stage(table, "languages"), unseen)


def score_languages(docs: DataFrame, model: LanguageModel, keep: Sequence[str], text: Column) -> DataFrame:
    """keep, n_grams, best (struct of score and lang; NULL without trigrams) of every row of docs.

    Trigrams meet the model in a join with the small table and are summed up before the one shuffle, which has one row
    per text. Of equal scores the first code wins.
    """
    codes = sorted(model.unseen)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())  # before the rows become several
    rows = rows.select(*keep, "_row", F.explode_outer(trigrams(text)).alias("gram"))
    weighed = rows.join(F.broadcast(model.grams), "gram", "left")  # GRAMS rows per known language at most
    sums = [F.sum(F.coalesce(F.col(f"w_{c}"), F.lit(model.unseen[c]))).alias(f"s_{c}") for c in codes]
    scored = weighed.groupBy("_row", *keep).agg(F.count("gram").alias("n_grams"), *sums)
    best = F.array_max(F.array(*[F.struct(F.col(f"s_{c}").alias("score"), F.lit(-i).alias("place"), F.lit(c).alias("lang"))
                                 for i, c in enumerate(codes)])) if codes else None
    found = (F.when(F.col("n_grams") > 0, F.struct(best["score"].alias("score"), best["lang"].alias("lang"))) if codes
             else F.lit(None).cast("struct<score:bigint,lang:string>"))
    return scored.select(*keep, "n_grams", found.alias("best"))


def detect_languages(docs: DataFrame, model: LanguageModel, keep: Sequence[str], text: str = "text",
                     out: str = "lang_code") -> DataFrame:
    """keep and the language of every row: 'en' for short texts, else by script (Chinese script with kana is Japanese),
    else by the model, else 'en'.

    Only the text of rows that script and length leave open is scored. A NULL text is short.
    """
    docs = with_script(docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))), "_text", "_script")
    short = F.length(stripped(F.col("_text"))) < fixed.MIN_DETECT_LENGTH
    sure = (F.when(short, "en").when((F.col("_script") == "zh") & F.col("_text").rlike(fixed.KANA), "ja")
            .otherwise(F.nullif("_script", F.lit(""))))
    docs = docs.withColumn("_sure", sure)
    scored = score_languages(docs, model, [*keep, "_sure"], F.when(F.col("_sure").isNull(), F.col("_text")))
    return scored.select(*keep, F.coalesce("_sure", "best.lang", F.lit("en")).alias(out))
