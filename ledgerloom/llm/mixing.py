"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SALTS, WORD, hot_join, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Classes of the order; only the class that the last sampled document is in is ranked row by row.
ORDER_CLASSES = 4096
SEED = "mix"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("bigint")


def _uniform(*columns: str) -> Column:
    """A number strictly between 0 and 1 from the row's id: 52 bits of a digest and a half."""
    text = F.concat_ws(":", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target from sizes (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn; targets share the sum of all sizes. No target is above
    max_copies times its source's size: sources are taken by the weight level at which they reach that limit, and
    those below the level that the others end at are held there. The table has a row per source, so its two windows
    are over sources, not documents.
    """
    everything = Window.partitionBy()
    ordered = sizes.withColumn("i", F.row_number().over(
        Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("i") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * max_copies).cast("double")
    level = ordered.withColumn("w", weight).withColumn("cap", cap).withColumn("at", F.col("cap") / F.col("w"))
    before = Window.orderBy("at", "i").rowsBetween(Window.unboundedPreceding, -1)
    level = (level.withColumn("total", F.sum("source_size").over(everything).cast("double"))
             .withColumn("all_w", F.sum("w").over(everything))
             .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             .withColumn("rest_w", F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
             .withColumn("share", F.col("rest") / F.col("rest_w"))
             .withColumn("held", F.col("at") <= F.col("share")))
    free = F.min(F.when(~F.col("held"), F.struct("at", "i", "share"))).over(everything)["share"]
    return level.select("source", "source_size",
                        F.when(F.col("held"), F.col("cap")).otherwise(F.col("w") * free).alias("target"))


def pareto_mix(docs: DataFrame, weights: tuple = WEIGHTS, max_copies: int = MAX_COPIES,
               expected: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, text, source).

    With carry, each row also has its own columns of that name in a struct `row`, so nothing has to be joined back, and
    rows of one doc_id and size stand in the order of the hash of these.

    A document is expected `expected` times (default: target / size of its source), at most max_copies. The whole part
    is certain. For the rest f, documents stand in the order of (u / (1 - u)) / (f / (1 - f)) with u from the doc_id,
    and the first of them are taken until the words of their source are reached: all before, and the one that reaches
    the sum if that is nearer. Equal orders stand by doc_id, size. Reruns agree.

    A null text has 0 words and is not taken more than its certain copies; a null source is a source. Rows without a
    doc_id share one random number; repeated rows count as documents. An empty table gives no rows. If the sizes are
    all 0, so are the targets.

    The order is cut into classes of equal probability; words per source and class are summed first, and only rows of
    the class where the sum is reached are ranked, so no task holds a source.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       *([expected.cast("double").alias("expected")] if expected is not None else []),
                       *([F.struct(*carry).alias("row")] if carry else []))
    ties = [F.xxhash64("row")] if carry else []
    rows = written(rows, "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    targets = written(targets, "mix-targets")
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    keyed = targets.select(key.alias("key"), "source_size", "target")
    spread = F.xxhash64("doc_id", "size")
    mixed = hot_join(rows.withColumn("key", key), keyed, ["key"], spread, salts=SALTS)
    if expected is None:
        mixed = mixed.withColumn("expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                                 .otherwise(F.lit(0.0)))
    mixed = (mixed.withColumn("expected", F.least(F.greatest("expected", F.lit(0.0)), F.lit(float(max_copies))))
             .withColumn("whole", F.floor("expected").cast("bigint"))
             .withColumn("f", F.col("expected") - F.col("whole"))
             .withColumn("u", _uniform("doc_id")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f")))
    mixed = (mixed.withColumn("q", F.when(F.col("f") > 0, odds))
             .withColumn("class", F.floor(F.col("q") / (1 + F.col("q")) * ORDER_CLASSES).cast("int")))
    # words of a source by class of the order, and the class in which its wanted words are reached
    sums = mixed.where("q IS NOT NULL").groupBy("key", "class").agg(
        F.sum("size").alias("words"), F.sum(F.col("f") * F.col("size")).alias("want"))
    upto = Window.partitionBy("key").orderBy("class")
    sums = (sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
            .withColumn("want", F.round(F.sum("want").over(Window.partitionBy("key")), 6)))
    cut = (sums.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("words") >= F.col("want")))
           .select("key", F.col("class").alias("cut"), "before", "want"))
    cut = written(cut, "mix-cuts")
    mixed = hot_join(mixed, cut, ["key"], spread, how="left", salts=SALTS)
    inside = mixed.where(F.col("q").isNotNull() & (F.col("class") == F.col("cut")))
    order = Window.partitionBy("key").orderBy("q", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("size").over(order)
    start = end - F.col("size")
    inside = inside.withColumn("more", (F.col("want") > start) & (
        (end <= F.col("want")) | (end - F.col("want") < F.col("want") - start)))
    outside = mixed.where(F.col("q").isNull() | F.col("cut").isNull() | (F.col("class") != F.col("cut")))
    outside = outside.withColumn("more", F.coalesce(F.col("q").isNotNull() & (F.col("class") < F.col("cut")),
                                                    F.lit(False)))
    copies = F.col("whole") + F.col("more").cast("bigint")
    return inside.unionByName(outside).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(["row"] if carry else []))
