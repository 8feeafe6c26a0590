"""Phrase, prefix and any-of requests, many in one job, by postings that know the places of their terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.stem import porter
from ledgerloom.functions.text import tokens
from ledgerloom.operators.search import with_terms
from ledgerloom.session import salted_join, stage

PHRASE, PREFIX, ANY = "phrase", "prefix", "any"


def positional_postings(docs: DataFrame, text: str, doc_id: str = "id") -> DataFrame:
    """word, term, doc_id, places (ascending): where each word of a text stands, counted over all its words.

    Stop words and single characters keep their places but have no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens(F.coalesce(F.col(text), F.lit("")))).alias("place", "word"))
    rows = rows.where((F.length("word") >= 2) & ~F.col("word").isin(fixed.SEARCH_STOP_WORDS))
    found = rows.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places"))
    return with_terms(found).select("word", "term", "doc_id", "places")


def _phrases(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, n: places at which all words of a phrase follow each other as asked."""
    words = asked.select("query_id", F.posexplode("words").alias("at", "word"))
    words = words.where((F.length("word") >= 2) & ~F.col("word").isin(fixed.SEARCH_STOP_WORDS))
    words = words.withColumn("term", porter(F.col("word")))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    costs = words.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    plan = costs.groupBy("query_id").agg(F.min(F.struct("df", "at", "term")).alias("rarest"),
                                         F.collect_list(F.struct("at", "term")).alias("all"), F.count(F.lit(1)).alias("needed"))
    # documents of the rarest term only; a frequent term has many rows, requests are few per term
    rarest = plan.select("query_id", "all", "needed", F.col("rarest.term").alias("term"))
    seeds = salted_join(postings.select("term", "doc_id"), rarest, ["term"], F.col("doc_id"), "inner")
    wanted = seeds.select("query_id", "doc_id", "needed", F.explode("all").alias("w")).select("query_id", "doc_id", "needed", "w.*")
    # words with one stem (search, searches) are one term; equal seeds come from them too
    places = postings.groupBy("term", "doc_id").agg(F.flatten(F.collect_list("places")).alias("places"))
    hits = wanted.distinct().join(places, ["term", "doc_id"])
    starts = F.transform("places", lambda p: p - F.col("at"))
    # a request has few words, so few rows meet here
    together = hits.groupBy("query_id", "doc_id", "needed").agg(F.collect_list(starts).alias("starts"))
    common = F.aggregate(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.get("starts", F.lit(0)),
                         lambda found, more: F.array_intersect(found, more))
    n = F.size(F.array_distinct(common)).cast("bigint")
    return together.where(F.size("starts") == F.col("needed")).select("query_id", "doc_id", n.alias("n")).where("n > 0")


def _prefixes(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, n: words of a document that begin as asked.

    A word begins with a text only if it has the text's first two letters, which makes the test an equi-join of texts
    and distinct words.
    """
    texts = asked.select("query_id", F.get("words", F.lit(0)).alias("text")).where(F.length("text") >= 2)
    vocabulary = postings.select("word").distinct().withColumn("head", F.substring("word", 1, 2))
    words = salted_join(vocabulary, texts.withColumn("head", F.substring("text", 1, 2)), ["head"], F.col("word"), "inner")
    words = words.where(F.startswith("word", "text")).select("word", "query_id")
    return _counted(words, postings, "word")


def _any_of(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, doc_id, n: terms of the request that a document has."""
    terms = asked.select("query_id", F.explode("words").alias("word")).where(F.length("word") >= 2)
    terms = terms.where(~F.col("word").isin(fixed.SEARCH_STOP_WORDS)).select("query_id", porter(F.col("word")).alias("term"))
    return _counted(terms.distinct(), postings.select("term", "doc_id").distinct(), "term")


def _counted(wanted: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    found = salted_join(postings.select(key, "doc_id"), wanted, [key], F.col("doc_id"), "inner")
    return found.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def answer_requests(requests: DataFrame, postings: DataFrame) -> DataFrame:
    """query_id, kind, doc_id, n of every document that a request finds.

    requests has query_id, kind and words (array). `phrase`: the words, by their stems, in this order without a gap, n
    places; a stop word stands for any one word. `prefix`: words that begin with the first of the words, of two letters
    or more, n words. `any`: at least one of the words by its stem, n of them. Words are put in lower case. A request
    that holds no word worth indexing, is NULL or of another kind finds nothing. query_id must be unique.
    """
    lower = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isNotNull() & (w != ""))
    asked = stage(requests.select("query_id", "kind", lower.alias("words")), "requests")
    parts = [run(asked.where(F.col("kind") == kind), postings).select("query_id", F.lit(kind).alias("kind"), "doc_id", "n")
             for kind, run in ((PHRASE, _phrases), (PREFIX, _prefixes), (ANY, _any_of))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
