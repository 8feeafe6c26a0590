"""Column helpers for text and numbers; all native expressions but normal_form."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom import fixed


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, fixed.WHITESPACE, " "))


def strip_control(text: Column) -> Column:
    """Drop control characters other than tab and line feed, then squeeze."""
    return squeeze(F.regexp_replace(text, fixed.CONTROL, ""))


@F.pandas_udf(StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no expression for it."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def clean_text(text: Column) -> Column:
    """Compatibility composition where it can matter, then strip_control.

    Pure ASCII text is its own composed form: the helper gets NULL for it.
    """
    foreign = text.rlike(r"[^\x00-\x7F]")
    return strip_control(F.coalesce(normal_form(F.when(foreign, text)), text))


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic and Devanagari digits as ASCII digits."""
    return F.translate(text, fixed.FOREIGN_DIGITS, fixed.ASCII_DIGITS)


def beyond_ascii(text: Column) -> Column:
    """True when the text has a character outside ASCII: a length test, no search."""
    return F.octet_length(text) > F.length(text)


def has_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words])


def ascii_digits_of_page(text: Column) -> Column:
    """ascii_digits for long texts, most of which have no such digit."""
    return F.when(beyond_ascii(text) & text.rlike(fixed.ODD_DIGITS), ascii_digits(text)).otherwise(text)


def line_text(text: Column) -> Column:
    """Blanks squeezed inside the lines, line ends kept: the input of all field patterns."""
    odd = has_any(text, fixed.ODD_ASCII_BLANKS) | (beyond_ascii(text) & text.rlike(fixed.ODD_BLANKS))
    return F.when(odd, F.regexp_replace(text, fixed.LINE_BLANKS, " ")).otherwise(text)


def parse_amount(value: Column) -> Column:
    """'$1,234.56' -> 1234.56, '1.234,56' -> 1234.56, unreadable -> NULL."""
    kept = F.regexp_replace(ascii_digits(value), r"[^0-9.,\-]", "")
    dotted = F.translate(F.translate(kept, ".", ""), ",", ".")
    plain = F.translate(kept, ",", "")
    is_dotted = kept.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?\z")
    return F.when(is_dotted, dotted).otherwise(plain).try_cast("double")


def parse_int(value: Column) -> Column:
    """All digits of the value as one number, NULL when there are none."""
    return F.regexp_replace(ascii_digits(value), r"[^0-9]", "").try_cast("bigint")


def quick_pattern(pattern: str, every: bool = False) -> str:
    """The pattern for Java, with the first letter tested before all else; finds the same first hit and group 1.

    Most places of a text fail the letter's test, which is cheap; the edge before a label is then looked back at, where
    the plain pattern reads it as a character of the hit. With every, all hits are the same too: an edge must lie behind
    the hit before, so a hit doesn't begin where that one ends.
    """
    starts = fixed.PATTERN_STARTS.get(pattern)
    if starts is None:
        return fixed.QUICK_PATTERNS.get(pattern, pattern)
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    for edge, test in fixed.PATTERN_EDGES.items():
        if rest.startswith(edge):
            behind = f"(?<![A-Za-z]){test}"
            return f"{flag}(?=[{starts}]){rf'(?:\A|(?!\G){behind})' if every else behind}{rest[len(edge):]}"
    return f"{flag}(?=[{starts}])(?:{rest})"


def first_match(text: Column, patterns: Sequence[str], low: Column | None = None) -> Column:
    """Group 1 of the first pattern that hits, trimmed; '' when none does.

    With low, the text in lower case, a pattern with known words or a known shape
    is not tried on a text that has none of them: a cheap test saves the search.
    """
    hits = []
    for pattern in patterns:
        hit = F.trim(F.regexp_extract(text, quick_pattern(pattern), 1))
        hit = F.get(F.array_remove(F.array(hit), F.lit("")), 0)  # NULL for ''; nullif would search the text twice
        if low is not None and pattern in fixed.PATTERN_WORDS:
            hit = F.when(has_any(low, fixed.PATTERN_WORDS[pattern]), hit)
        elif low is not None and pattern in fixed.PATTERN_SHAPES:
            hit = F.when(text.rlike(fixed.PATTERN_SHAPES[pattern]), hit)
        hits.append(hit)
    return F.coalesce(*hits, F.lit(""))


def all_matches(text: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of all hits, pattern by pattern, trimmed, first occurrences kept. text is used once per pattern: hand in a column."""
    quick = [F.lit(quick_pattern(p, every=True)) for p in patterns]
    hits = [F.transform(F.regexp_extract_all(text, p, F.lit(1)), lambda hit: F.trim(hit)) for p in quick]
    return F.array_distinct(F.concat(*hits))


def money_text(amount: Column) -> Column:
    """Plain two-decimal text of a money value, never in exponent form."""
    return amount.cast("decimal(38,2)").cast("string")


def cents_text(cents: Column, symbol: Column) -> Column:
    """Whole cents as '$1,234.56'."""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, "-").otherwise(""),
        symbol,
        F.format_number((size - size % 100) / 100, 0),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def file_extension(path: Column) -> Column:
    """Lower-case suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def is_supported_file(path: Column) -> Column:
    return file_extension(path).isin(fixed.SUPPORTED_EXTENSIONS)


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of the whole content."""
    if algorithm == "md5":
        return F.md5(content)
    if algorithm == "sha1":
        return F.sha1(content)
    bits = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if algorithm not in bits:
        raise ValueError(f"unknown hash algorithm: {algorithm}")
    return F.sha2(content, bits[algorithm])


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(fixed.LOWER_TOKEN), F.lit(0))
