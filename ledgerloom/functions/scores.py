"""Confidence labels, badges, bars and status classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import fixed


def confidence_label(score: Column) -> Column:
    return (
        F.when(score >= 0.85, "High")
        .when(score >= 0.60, "Medium")
        .when(score >= 0.35, "Low")
        .otherwise("Very Low")
    )


def whole_percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5)


def confidence_badge(score: Column) -> Column:
    """Three bands with a whole percentage; '' for a missing score."""
    band = F.when(score >= 0.85, "High").when(score >= 0.60, "Med").otherwise("Low")
    text = F.concat(band, F.lit(" "), whole_percent(score).cast("string"), F.lit("%"))
    return F.when(score.isNull(), "").otherwise(text)


def bar_percent(score: Column) -> Column:
    """Percentage cut to a whole number; a missing score counts as 0."""
    return (F.coalesce(score, F.lit(0.0)) * 100).cast("int")


def bar_colour(percent: Column) -> Column:
    return F.when(percent >= 85, "green").when(percent >= 60, "amber").otherwise("red")


def status_class(status: Column) -> Column:
    """Style class of a status; an unknown one is shown as a warning."""
    return (
        F.when(status == "PASSED", "status-passed")
        .when(status == "FAILED", "status-failed")
        .otherwise("status-warning")
    )


def score_map(scores: dict[str, Column]) -> Column:
    """Map of field -> confidence in the fixed key order."""
    return F.create_map(*[c for key in fixed.CONFIDENCE_KEYS for c in (F.lit(key), scores[key])])


def average_confidence(scores: Column) -> Column:
    """Mean of a score map to four places, 0 when it is empty."""
    total = F.aggregate(
        F.map_values(scores),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.floor(x * 10000 + 0.5),
    )
    n = F.size(scores)
    return F.when(n > 0, F.floor(total / n + 0.5) / 10000).otherwise(F.lit(0.0))
