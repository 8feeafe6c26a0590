"""Date reading: shape tests plus an ISO cast, so that an odd text costs no exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import ascii_digits, squeeze

# Accepted shapes in order of preference (fixed values): pattern and its ISO
# rewriting; {m} is the month number of group 1 or 2, {c} the century of the year.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SHORT_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ANY_MONTH = f"(?i:({MONTHS}|{SHORT_MONTHS}))"
SHAPES = [
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", "3-2-1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})\z", "3-1-2"),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})\z", "1-2-3"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})\z", "3-2-1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})\z", "1-2-3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\z", "3-2-1"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})\z", "3-1-2"),
    (rf"^{ANY_MONTH} (\d{{1,2}}), (\d{{4}})\z", "3-m1-2"),
    (rf"^(\d{{1,2}}) {ANY_MONTH} (\d{{4}})\z", "3-m2-1"),
    (r"^(\d{4})(\d{2})(\d{2})\z", "1-2-3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})\z", "c3-2-1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})\z", "c3-1-2"),
    (r"^(\d{2})-(\d{1,2})-(\d{1,2})\z", "c1-2-3"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{2})\z", "c3-2-1"),
    (rf"^(\d{{1,2}}) {ANY_MONTH} (\d{{2}})\z", "c3-m2-1"),
]
MONTH_KEYS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month(key: Column) -> Column:
    return F.floor((F.instr(F.lit(MONTH_KEYS), key) + 2) / 3).cast("string")


def _part(text: Column, pattern: str, code: str) -> Column:
    value = F.regexp_extract(text, pattern, int(code[-1]))
    if code[0] == "m":
        return _month(F.lower(F.substring(value, 1, 3)))
    if code[0] == "c":
        return F.concat(F.when(value >= "69", "19").otherwise("20"), value)
    return value


def read_date(clean: Column) -> Column:
    """The first accepted shape that names a real day; NULL when none does.

    clean is a squeezed text with ASCII digits. It is used many times, so hand
    in a column of an earlier projection rather than a long expression.
    """
    reads = []
    for pattern, order in SHAPES:
        iso = F.concat_ws("-", *[_part(clean, pattern, code) for code in order.split("-")])
        reads.append(F.when(clean.rlike(pattern), iso.try_cast("date")))
    return F.coalesce(*reads)


def parse_date(text: Column) -> Column:
    """read_date for a raw text."""
    return read_date(squeeze(ascii_digits(text)))


def iso_or_text(day: Column, text: Column) -> Column:
    """ISO text of a date that was read, else the text itself."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), text)


def format_date_iso(text: Column) -> Column:
    return iso_or_text(parse_date(text), text)
