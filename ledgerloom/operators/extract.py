"""Field extraction: text table -> sixteen field columns and a confidence map.

Projections in steps, so that every pattern runs once per text: prepared text,
raw captures, then fields derived from the captures. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.dates import iso_or_text, read_date
from ledgerloom.functions.language import with_language
from ledgerloom.functions.scores import average_confidence, score_map
from ledgerloom.functions.text import ascii_digits_of_page, first_match, has_any, line_text, parse_amount, quick_pattern, squeeze


def _hit(text: str, patterns: list[str]) -> Column:
    return first_match(F.col(text), patterns, F.col("_low"))


# raw capture name -> expression over the prepared text columns
_CAPTURES: dict[str, Callable[[], Column]] = {
    "number": lambda: _hit("_t", fixed.NUMBER_PATTERNS),
    "number_bare": lambda: _hit("_t", [fixed.NUMBER_FALLBACK]),
    "date": lambda: squeeze(_hit("_u", fixed.DATE_PATTERNS)),
    "date_bare": lambda: _hit("_d", [fixed.DATE_FALLBACK]),
    "due": lambda: squeeze(_hit("_d", fixed.DUE_PATTERNS)),
    "vendor": lambda: _hit("_t", fixed.VENDOR_PATTERNS),
    "buyer": lambda: _hit("_t", fixed.BUYER_PATTERNS),
    "total": lambda: _hit("_m", fixed.TOTAL_PATTERNS),
    "subtotal": lambda: _hit("_d", fixed.SUBTOTAL_PATTERNS),
    "rate": lambda: _hit("_m", fixed.TAX_RATE_PATTERNS),
    "tax": lambda: _hit("_m", fixed.TAX_AMOUNT_PATTERNS),
    "discount": lambda: _hit("_d", fixed.DISCOUNT_PATTERNS),
    "currency": lambda: _hit("_t", fixed.CURRENCY_PATTERNS),
    "tax_id": lambda: _hit("_t", fixed.TAX_ID_PATTERNS),
    "po": lambda: _hit("_t", fixed.PO_PATTERNS),
    "address": lambda: _hit("_t", fixed.ADDRESS_PATTERNS),
    "terms": lambda: squeeze(_hit("_t", fixed.TERMS_PATTERNS)),
}
# a fallback pattern runs only where the labelled one found nothing
_FALLBACK_OF = {"number_bare": "number", "date_bare": "date"}

# output group -> captures it needs
_GROUPS = {
    "number": ["number", "number_bare"],
    "date": ["date", "date_bare"],
    "due": ["due"],
    "parties": ["vendor", "buyer"],
    "total": ["total"],
    "subtotal": ["subtotal"],
    "tax": ["rate", "tax"],
    "discount": ["discount"],
    "currency": ["total", "currency"],
    "tax_id": ["tax_id"],
    "po": ["po"],
    "address": ["address"],
    "terms": ["terms"],
}


def prepare_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """_t lines with single blanks, _low the same in lower case, _d with ASCII digits,
    _m with subtotal labels masked, _u with due-date labels masked."""
    def masked(pattern: str, words: list[str]) -> Column:
        return F.when(has_any(F.col("_low"), words), F.regexp_replace("_d", quick_pattern(pattern), "~")).otherwise(F.col("_d"))

    docs = docs.withColumn("_t", line_text(F.coalesce(F.col(text), F.lit(""))))
    docs = docs.withColumns({"_d": ascii_digits_of_page(F.col("_t")), "_low": F.lower("_t")})
    return docs.withColumns({
        "_m": masked(fixed.NOT_TOTAL, fixed.SUBTOTAL_WORDS), "_u": masked(fixed.DUE_LABEL, fixed.DUE_WORDS),
    })


def capture(docs: DataFrame, groups: Iterable[str]) -> DataFrame:
    """Adds one raw column _<name> per capture of the groups."""
    names = list(dict.fromkeys(n for g in groups for n in _GROUPS[g]))
    first = {f"_{n}": _CAPTURES[n]() for n in names if n not in _FALLBACK_OF}
    docs = docs.withColumns(first)
    second = {
        f"_{n}": F.when(F.col(f"_{_FALLBACK_OF[n]}") == "", _CAPTURES[n]()).otherwise("")
        for n in names if n in _FALLBACK_OF
    }
    return docs.withColumns(second) if second else docs


def currency_of(total_raw: Column, text_hit: Column) -> Column:
    """Code next to the total, then its symbol, then the first mention in the text."""
    code = F.upper(F.regexp_extract(total_raw, fixed.CURRENCY_CODE_IN_AMOUNT, 1))
    near = F.when(code != "", code)
    for symbol, name in fixed.CURRENCY_SYMBOLS.items():
        near = near.when(F.contains(total_raw, F.lit(symbol)), name)
    near = near.when(total_raw.rlike(fixed.RAND_AMOUNT), "ZAR")
    far = F.when(text_hit.rlike(fixed.ISO_CURRENCY), text_hit)
    for symbol, name in fixed.CURRENCY_SYMBOLS.items():
        far = far.when(text_hit == symbol, name)
    return F.coalesce(near, far, F.lit(""))


def _text(name: str) -> Column:
    return F.col(f"_{name}")


def _entity(position: int, label: str) -> Column:
    """Text of the n-th entity with this label, from the optional entities column."""
    hits = F.filter(F.col("entities"), lambda e: e["label"] == label)
    ordered = F.sort_array(F.transform(hits, lambda e: F.struct(e["pos"].alias("pos"), e["text"].alias("text"))))
    return F.coalesce(F.get(ordered, position)["text"], F.lit(""))


def extract_columns(docs: DataFrame, text: str = "text", language: Column | None = None) -> DataFrame:
    """Adds the sixteen fields and a score_<field> column per scored field.

    A caller that selects some of the columns pays for their patterns only.

    An optional column entities array<struct<text,label,pos>> (see with_entities)
    supplies date, vendor and buyer where no pattern hits, with MEDIUM confidence.
    """
    keep = [c for c in docs.columns if c != "entities"]
    kept = [*keep, *fixed.FIELD_COLUMNS, *[f"score_{k}" for k in fixed.CONFIDENCE_KEYS]]
    has_entities = "entities" in docs.columns
    docs = capture(prepare_text(docs, text), _GROUPS)

    entity = {
        "date": _entity(0, "DATE") if has_entities else F.lit(""),
        "vendor": _entity(0, "ORG") if has_entities else F.lit(""),
        "buyer": _entity(1, "ORG") if has_entities else F.lit(""),
    }
    docs = docs.withColumns({f"_e_{k}": v for k, v in entity.items()})
    pick = lambda *cols: F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))
    docs = docs.withColumn("_date_text", pick(_text("date"), F.col("_e_date"), _text("date_bare")))
    if language is None:
        docs = with_language(docs, text, "_language")
    else:
        docs = docs.withColumn("_language", language)
    docs = docs.withColumns({"_day": read_date(F.col("_date_text")), "_due_day": read_date(_text("due"))})

    fields = {
        "invoice_number": pick(_text("number"), _text("number_bare")),
        "invoice_date": iso_or_text(F.col("_day"), F.col("_date_text")),
        "due_date": iso_or_text(F.col("_due_day"), _text("due")),
        "vendor_name": pick(_text("vendor"), F.col("_e_vendor")),
        "buyer_name": pick(_text("buyer"), F.col("_e_buyer")),
        "total_amount": parse_amount(_text("total")),
        "subtotal": parse_amount(_text("subtotal")),
        "tax_amount": parse_amount(_text("tax")),
        "tax_rate": F.nullif(_text("rate"), F.lit("")),
        "discount": parse_amount(_text("discount")),
        "currency": currency_of(_text("total"), _text("currency")),
        "tax_id": _text("tax_id"),
        "po_number": _text("po"),
        "address": squeeze(_text("address")),
        "payment_terms": _text("terms"),
        "detected_language": F.col("_language"),
    }
    docs = docs.withColumns(fields)

    found = lambda name: _text(name) != ""
    high, medium, low = fixed.CONF_HIGH, fixed.CONF_MEDIUM, fixed.CONF_LOW
    grade = lambda hit, score, backup=F.lit(False): (
        F.when(hit, score).when(backup, medium).otherwise(low)
    )
    scores = {
        "invoice_number": grade(found("number"), high, found("number_bare")),
        "invoice_date": grade(found("date"), high, F.col("_e_date") != ""),
        "due_date": grade(found("due"), medium),
        "vendor_name": grade(found("vendor"), high, F.col("_e_vendor") != ""),
        "buyer_name": grade(found("buyer"), high, F.col("_e_buyer") != ""),
        "total_amount": grade(found("total"), high),
        "subtotal": grade(found("subtotal"), medium),
        "tax_amount": grade(found("tax") | found("rate"), medium),
        "currency": grade(F.col("currency") != "", medium),
        "tax_id": grade(found("tax_id"), high),
        "po_number": grade(found("po"), high),
        "address": grade(found("address"), medium),
        "payment_terms": grade(found("terms"), medium),
    }
    docs = docs.withColumns({f"score_{key}": score for key, score in scores.items()})
    return docs.select(*kept)


def extract_fields(docs: DataFrame, text: str = "text", language: Column | None = None) -> DataFrame:
    """Adds the sixteen fields, the confidence map and its mean to a text table."""
    scored = extract_columns(docs, text, language)
    names = [f"score_{key}" for key in fixed.CONFIDENCE_KEYS]
    scores = score_map({key: F.col(f"score_{key}") for key in fixed.CONFIDENCE_KEYS})
    scored = scored.withColumn("confidence_scores", scores).drop(*names)
    return scored.withColumn("avg_field_confidence", average_confidence(F.col("confidence_scores")))


def with_entities(docs: DataFrame, find: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Hook for a user's entity model: find maps a batch of texts to lists of
    {text, label, pos}; its result becomes the optional entities column."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    entity = StructType([
        StructField("text", StringType()), StructField("label", StringType()), StructField("pos", LongType()),
    ])
    hook = F.pandas_udf(find, ArrayType(entity))
    return docs.withColumn("entities", hook(F.col(text)))
