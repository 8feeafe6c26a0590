"""Entities from tables of known names: an equi-join of word windows with names, no model and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import salted_join

#: Bits of the filter of names: 4 MB; a full one costs shuffle, never a result.
_FILTER_BITS = 1 << 25
_WORDS = r"[\p{L}\p{M}\p{N}]+|\n"


def _words(text: str):
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(_WORDS), F.lit(0))


def known_names(names: DataFrame) -> DataFrame:
    """gram, n, text, label: one row per different name (name, label), its words in lower case with single blanks.

    Names without a letter or digit are left out. Of names with equal words, the least label and spelling stay.
    """
    rows = names.select(_words("name").alias("_w"), F.col("name").alias("text"), "label").where("size(_w) > 0")
    best = rows.groupBy(F.array_join("_w", " ").alias("gram"), F.size("_w").alias("n")).agg(
        F.min(F.struct("label", "text")).alias("best"))
    return best.select("gram", "n", "best.text", "best.label")


def _places(gram: Column) -> list[Column]:
    """Two places of a name among the bits of the filter."""
    return [F.pmod(F.xxhash64(gram, F.lit(i)), F.lit(_FILTER_BITS)) for i in range(2)]


def _bits(known: DataFrame) -> Column:
    """A Bloom filter of the names: array of 64-bit words, of one size however many names there are."""
    at = known.select(F.explode(F.array(*_places(F.col("gram")))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = known.sparkSession.range(_FILTER_BITS // 64).join(words, F.col("id") == F.col("word"), "left")
    held = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("held"))
    return held.select(F.col("held.bits")).scalar()


def _may_be_known(gram: str, bits: str) -> Column:
    """False only for a gram that is no name."""
    tests = [F.call_function("getbit", F.get(F.col(bits), F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
             for at in _places(F.col(gram))]
    return tests[0] & tests[1]


def find_known_names(docs: DataFrame, names: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with entities: array<struct<text,label,pos>>, the known names in each text; an empty array where none is.

    names has name and label. A name is found where its words stand in order on one line, whatever their case and the
    signs between them; pos counts words from 0. A name inside a longer name found there is left out. doc_id must be
    unique and not NULL. Only windows of lengths that names have are made; their number of lengths is small even
    where names are many, and a filter of fixed size drops nearly all that are no names before the join. Names are salted, since one name may stand in a large share of the texts.
    """
    known = known_names(names)
    # one number per length of a name
    sizes = known.agg(F.sort_array(F.collect_set("n")).alias("sizes")).scalar()
    rows = docs.select(F.col(doc_id).alias("_id"), _words(text).alias("_w")).withColumn("_n", F.explode(sizes))
    starts = F.when(F.size("_w") >= F.col("_n"), F.sequence(F.lit(0), F.size("_w") - F.col("_n")))
    grams = F.transform(starts, lambda at: F.struct(
        at.alias("at"), F.array_join(F.slice("_w", at + 1, F.col("_n")), " ").alias("gram")))
    windows = rows.select("_id", F.inline(grams)).where(~F.contains("gram", F.lit("\n")))
    windows = windows.withColumn("_bits", _bits(known)).where(_may_be_known("gram", "_bits")).drop("_bits")
    hits = salted_join(windows, known, ["gram"], F.struct("_id", "at"), "inner")
    # of hits that start together the longest comes first; one that ends inside what came before lies in another name
    before = (Window.partitionBy("_id").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("at") + F.col("n")
    hits = hits.withColumn("_reach", F.max(end).over(before)).where(F.col("_reach").isNull() | (end > F.col("_reach")))
    entity = F.struct(F.col("at").cast("bigint").alias("pos"), "text", "label")
    found = hits.groupBy("_id").agg(F.sort_array(F.collect_list(entity)).alias("_found"))
    joined = docs.join(found, docs[doc_id] == found["_id"], "left")
    entities = F.transform(F.coalesce("_found", F.array().cast("array<struct<pos:bigint,text:string,label:string>>")),
                           lambda e: F.struct(e["text"].alias("text"), e["label"].alias("label"), e["pos"].alias("pos")))
    return joined.select(*[docs[c] for c in docs.columns if c != "entities"], entities.alias("entities"))
