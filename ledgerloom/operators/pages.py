"""Recognised words -> page text -> document text.

A page is one row with its words in order, as recognisers deliver it, so page
text needs no shuffle. Only the document assembly groups rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.language import stripped, with_language


def _page(words: Column, keep) -> tuple[Column, Column]:
    kept = F.filter(words, keep)
    text = F.array_join(F.transform(kept, lambda w: w["word"]), " ")
    total = F.aggregate(kept, F.lit(0.0), lambda acc, w: acc + w["conf"])
    return text, F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def page_text(pages: DataFrame, words: str = "words") -> DataFrame:
    """First engine: words that are not blank and have a positive confidence (0-100)."""
    text, conf = _page(F.col(words), lambda w: (stripped(w["word"]) != "") & (w["conf"] > 0))
    return pages.withColumns({"text": text, "conf": conf})


def page_text_alt(pages: DataFrame, words: str = "words") -> DataFrame:
    """Second engine: words that are not blank; word confidence 0-1, page confidence 0-100."""
    text, conf = _page(F.col(words), lambda w: stripped(w["word"]) != "")
    return pages.withColumns({"text": text, "conf": conf * 100})


def pages_from_words(words: DataFrame) -> DataFrame:
    """Long form (one row per word) -> page rows. The words of one page become one
    row, which is what a page is; pages of all documents spread over all tasks."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "word", "conf")))
    return words.groupBy("doc_id", "page_no", "engine").agg(ordered.alias("words"))


def choose_engine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per page the first engine's text, unless it is weak or short and the second's is longer."""
    a = first.select("doc_id", "page_no", F.col("text").alias("a_text"), F.col("conf").alias("a_conf"))
    b = second.select("doc_id", "page_no", F.col("text").alias("b_text"), F.col("conf").alias("b_conf"))
    size = lambda c: F.length(stripped(F.col(c)))
    weak = (F.col("a_conf") < fixed.RECOGNISER_THRESHOLD) | (size("a_text") < fixed.RECOGNISER_MIN_LENGTH)
    use_b = F.coalesce(weak & (size("b_text") > size("a_text")), F.lit(False))
    return a.join(b, ["doc_id", "page_no"], "left").select(
        "doc_id", "page_no",
        F.when(use_b, F.col("b_text")).otherwise(F.col("a_text")).alias("text"),
        (F.when(use_b, F.col("b_conf")).otherwise(F.col("a_conf")) / 100).alias("conf"),
        F.when(use_b, "easyocr").otherwise("tesseract").alias("engine"),
    )


def assemble_documents(pages: DataFrame) -> DataFrame:
    """Pages in order joined by line feeds, mean confidence to four places, engine of
    the last page, language of the first page."""
    rows = F.sort_array(F.collect_list(F.struct("page_no", "text", "engine", "conf")))
    docs = pages.groupBy("doc_id").agg(rows.alias("pages"), F.avg("conf").alias("mean"))
    docs = docs.select(
        "doc_id",
        F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"),
        F.size("pages").cast("bigint").alias("pages"),
        (F.floor(F.col("mean") * 10000 + 0.5) / 10000).alias("ocr_confidence"),
        F.element_at("pages", -1)["engine"].alias("ocr_engine"),
        F.col("pages")[0]["text"].alias("_first"),
    )
    return with_language(docs, "_first").drop("_first")
