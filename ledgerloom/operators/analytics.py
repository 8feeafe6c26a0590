"""Dashboard aggregates, status counts, error reports and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.session import salted_join


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding of a non-negative double to some places."""
    return F.floor(value * 10**places + 0.5) / 10**places


def cents(amount: Column) -> Column:
    return F.floor(amount * 100 + 0.5)


def count_by(invoices: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Row count per value; NULL is a group of its own."""
    return invoices.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def totals_by_currency(invoices: DataFrame) -> DataFrame:
    return invoices.groupBy("currency").agg(
        F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(cents(F.col("total_amount"))), F.lit(0)) / 100).alias("total")
    )


def summary(invoices: DataFrame) -> DataFrame:
    """One row: counts, mean confidence, sum of totals, duplicates, two count maps.

    One pass over the table. The first aggregate leaves a handful of rows
    (language x status), the second one folds them into scalars and maps.
    """
    cells = invoices.groupBy("detected_language", "validation_status").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("avg_field_confidence").alias("conf_n"),
        F.sum(F.floor(F.col("avg_field_confidence") * 10000 + 0.5)).alias("conf"),
        F.sum(cents(F.col("total_amount"))).alias("total_c"),
        F.count_if(F.col("is_duplicate")).alias("dup"),
    )
    languages = Window.partitionBy("detected_language")
    statuses = Window.partitionBy("validation_status")
    cells = cells.withColumns({"lang_n": F.sum("n").over(languages), "status_n": F.sum("n").over(statuses)})
    entry = lambda key, n: F.struct(F.coalesce(F.col(key), F.lit("")).alias("k"), F.col(n).alias("v"))
    count_map = lambda key, n: F.map_from_entries(F.sort_array(F.collect_set(entry(key, n))))
    mean = F.sum("conf") / F.sum("conf_n") / 10000
    return cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_invoices"),
        count_map("detected_language", "lang_n").alias("by_language"),
        count_map("validation_status", "status_n").alias("by_validation_status"),
        F.coalesce(rounded(F.when(F.sum("conf_n") > 0, mean), 3), F.lit(0.0)).alias("avg_confidence"),
        (F.coalesce(F.sum("total_c"), F.lit(0)) / 100).alias("total_amount_processed"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_count"),
        F.count_distinct("detected_language").alias("languages"),
    )


def map_text(counts: Column) -> Column:
    """'ar=12;de=3' for a count map."""
    pairs = F.transform(F.array_sort(F.map_entries(counts)),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, ";")


def status_summary(invoices: DataFrame) -> DataFrame:
    """Total and count per status in one row; an absent status counts 0."""
    per_status = [F.count_if(F.col("validation_status") == s).alias(s.lower()) for s in fixed.STATUSES]
    return invoices.agg(F.count(F.lit(1)).alias("total"), *per_status)


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("succeeded"), F.count(F.lit(1)).alias("total"))


def error_messages(reports: DataFrame, column: str = "validation_report") -> DataFrame:
    """One row per error of a report; the report may be a struct or its JSON text."""
    if dict(reports.dtypes)[column] == "string":
        shape = "status string, passed array<string>, warnings array<string>, errors array<string>, is_duplicate boolean"
        reports = reports.withColumn(column, F.from_json(column, shape))
    return reports.select("id", "filename", F.explode(f"{column}.errors").alias("error"))


def error_frequency(reports: DataFrame, column: str = "validation_report") -> DataFrame:
    return error_messages(reports, column).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def exact_median(df: DataFrame, group: str, value: str, *more: Column) -> DataFrame:
    """group, median and the aggregates `more` (with names of their own), in two scans and without holding a group in one task.

    A mergeable sketch brackets the middle ranks with five times the room of its
    error bound. The second scan counts all that lies below the bracket as one
    cell, and each distinct value inside it (about a thousandth of the group);
    only these are ranked.
    """
    rows = df.where(F.col(value).isNotNull())
    sketch = rows.groupBy(group).agg(
        F.percentile_approx(value, [0.4995, 0.5005], 10000).alias("_q"), F.count(F.lit(1)).alias("_n"), *more)
    names = [c for c in sketch.columns if c not in (group, "_q")]
    sketch = sketch.select(group, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"), *names)
    cells = (
        salted_join(rows.select(group, value), sketch, [group], F.col(value), "inner")
        .where(F.col(value) <= F.col("_hi"))
        .groupBy(group, *names, F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    w = Window.partitionBy(group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = cells.withColumn("_upto", F.sum("_c").over(w))
    covers = lambda rank: (F.col("_upto") - F.col("_c") < rank) & (rank <= F.col("_upto"))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.groupBy(group, *names).agg(
        ((F.max(F.when(covers(low), F.col("_v"))) + F.max(F.when(covers(high), F.col("_v")))) / 2).alias("median")
    ).drop("_n")


def latency_stats(timings: DataFrame, baseline: str, strategy: str = "strategy", value: str = "ms") -> DataFrame:
    """n, mean, median, min, max per strategy, and its gain over the baseline's mean."""
    timings = timings.where(F.col(value).isNotNull())
    stats = exact_median(
        timings, strategy, value, F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    base = timings.where(F.col(strategy) == baseline).agg(F.avg(value)).scalar()
    stats = stats.withColumn("_base", base)
    gain = (1 - F.col("_mean") / F.col("_base")) * 100
    return stats.select(
        strategy, "n", rounded(F.col("_mean"), 4).alias("mean"), rounded(F.col("median"), 4).alias("median"), "min", "max",
        rounded(F.col("_base") / F.col("_mean"), 4).alias("speedup"),
        (F.floor(gain * 100 + 0.5) / 100).alias("gain_percent"),
        (gain >= fixed.SPEEDUP_TARGET_PERCENT).alias("target_met"),
    )
