"""Quality rules: what a text says about itself, and lines that a host repeats across documents."""

from __future__ import annotations

import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import hot_join, map_rows, words, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line in more distinct texts of its host than this is boilerplate, whatever the size of the host.
LINE_DOCUMENTS = 20
#: A document is depleted if more than this share of its words is in boilerplate lines, or fewer than MIN_WORDS are left.
DEPLETED_SHARE = 0.8
_SYMBOL = re.compile(r"[#*$%&|<>]")
_PLAIN = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"[0-9]+")


def repeated_words(found: list[bytes]) -> int:
    """Words that are in a three-word window which the text has at least twice."""
    windows = list(zip(found, found[1:], found[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_key(line: str) -> int | None:
    """Hash of a line in lower case with numbers and punctuation levelled; None for a line without letters or digits."""
    plain = _PLAIN.sub(" ", _DIGITS.sub("0", line.lower())).strip()
    return xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63) if plain else None


def measures(text: str | None) -> dict:
    """The base figures of a text and its lines: distinct keys with the words they hold."""
    text = text or ""
    found = words(text)
    lines, n_dup, seen = Counter(), 0, set()
    for line in text.split("\n"):
        n = len(words(line))
        if not n:
            continue
        n_dup += line in seen
        seen.add(line)
        key = line_key(line)
        if key is not None:
            lines[key] += n
    # code points in words: bytes that don't continue a character
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_repeat = repeated_words(found)
    return {"n_words": len(found), "word_chars": chars, "n_symbols": len(_SYMBOL.findall(text)), "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat,
            "base_failed": len(found) < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(found),
            "lines": [{"key": k, "n": n} for k, n in lines.items()]}


_SCHEMA = ("doc_id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
           "n_repeat_words bigint, base_failed boolean, lines array<struct<key:bigint,n:bigint>>")


def boilerplate(measured: DataFrame, line_documents: int) -> DataFrame:
    """(host, key, n) of lines above the limit. Exact copies are one document, so a copied text isn't boilerplate."""
    lines = measured.select("host", "text_hash", F.explode("lines.key").alias("key"))
    return (lines.groupBy("host", "key", "text_hash").agg(F.lit(1).alias("x"))
            .groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > line_documents))


def without_lines(text: str | None, gone: list[int] | None) -> str | None:
    """The text without the lines whose keys are in gone; the other lines stay as they are."""
    if not text or not gone:
        return text
    keys = set(gone)
    return "\n".join(line for line in text.split("\n") if line_key(line) not in keys)


def _host(host: Column | None) -> Column:
    return F.coalesce((host if host is not None else F.col("source")).cast("string"), F.lit("\0"))


def _judged(docs: DataFrame, host: Column | None, line_documents: int, depleted_share: float,
            least_left: int) -> DataFrame:
    """The columns of judge_quality with host and gone, the keys of the row's lines above the limit."""
    rows = docs.select("doc_id", "text", _host(host).alias("host"), F.xxhash64("text").alias("text_hash"))

    def each(row):
        yield {"doc_id": row["doc_id"], "host": row["host"], "text_hash": row["text_hash"], **measures(row["text"])}

    measured = map_rows(rows, each, _SCHEMA).withColumn("row_id", F.monotonically_increasing_id())
    measured = written(measured, "line-measures")
    common = written(boilerplate(measured, line_documents), "line-boilerplate")
    lines = measured.select("row_id", "host", F.explode("lines").alias("line")).select("row_id", "host", "line.*")
    removed = (hot_join(lines, common.select("host", "key"), ["host", "key"], "row_id")
               .groupBy("row_id").agg(F.sum("n").alias("removed"), F.collect_list("key").alias("gone")))
    judged = measured.drop("lines").join(removed, "row_id", "left")
    n = F.coalesce("removed", F.lit(0)).cast("bigint")
    return judged.select(
        "doc_id", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        n.alias("n_removed_words"),
        (~F.col("base_failed") & (n <= depleted_share * F.col("n_words"))
         & (F.col("n_words") - n >= least_left)).alias("kept"), "host", "gone")


def judge_quality(docs: DataFrame, host: Column | None = None, line_documents: int = LINE_DOCUMENTS,
                  depleted_share: float = DEPLETED_SHARE, least_left: int = MIN_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, the base figures, n_removed_words, kept.

    Lines are counted per host (default: the column source) by distinct texts that have them. A document is kept if its
    base figures pass, at most depleted_share of its words are in lines above the limit and least_left words are outside
    them. A null text is a text without words, a null host is a host, rows without a doc_id and repeated rows are judged
    like others, other columns are ignored, and an empty table gives no rows.
    """
    return _judged(docs, host, line_documents, depleted_share, least_left).drop("host", "gone")


def clean_documents(docs: DataFrame, host: Column | None = None, line_documents: int = LINE_DOCUMENTS,
                    depleted_share: float = DEPLETED_SHARE, least_left: int = MIN_WORDS) -> DataFrame:
    """The rows of docs that judge_quality keeps, their texts without the host's lines above the limit.

    All columns stay; only text changes. The keys come back to a row by doc_id, host and hash of the text, on which both
    the verdict and the lines depend, so repeated rows stay repeated.
    """
    judged = _judged(docs, host, line_documents, depleted_share, least_left).where("kept")
    keys = judged.select("doc_id", "host", "text_hash", "gone").dropDuplicates(["doc_id", "host", "text_hash"])
    columns, schema = docs.columns, docs.schema
    left = docs.withColumn("__host", _host(host)).withColumn("__hash", F.xxhash64("text")).alias("d")
    joined = left.join(keys.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) &
                       (F.col("d.__host") == F.col("x.host")) & (F.col("d.__hash") == F.col("x.text_hash")))
    joined = joined.select(*[F.col(f"d.`{c}`") for c in columns], F.col("x.gone").alias("__gone"))

    def each(row):
        gone = row.pop("__gone")
        row["text"] = without_lines(row["text"], gone)
        yield row

    return map_rows(joined, each, schema)
