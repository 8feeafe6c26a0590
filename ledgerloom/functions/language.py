"""Language and script detection over the whole text.

with_language works in steps of its own columns, so that each count is taken
once per text; the word lists go to Spark as SQL text, one expression per list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed
from ledgerloom.functions.text import beyond_ascii

_ANY_SCRIPT = f"[{''.join(fixed.SCRIPT_CLASSES.values())}]"
# the characters of all scripts lie above U+03FF
_NO_SCRIPT = r"[\x00-\x{03FF}]+"

# The function words as one pattern over a text with a blank at both ends: their characters, as many as the longest has,
# between two characters that belong to no token. Those of ASCII stand one by one, which Java looks up in a table.
_KNOWN_WORDS = sorted({w for words in fixed.LANGUAGE_WORDS.values() for w in words})
_GAP = "[" + "".join(rf"\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]"
_FOREIGN_GAP = r"[[^\x00-\x7F]&&[^\p{L}\p{M}\p{N}]]"
_SHORT_WORD = f"{_GAP}([{''.join(sorted(set(''.join(_KNOWN_WORDS))))}]{{1,{max(map(len, _KNOWN_WORDS))}}}+)(?={_GAP})"


def stripped(text: Column) -> Column:
    """The text without white space at both ends; NULL counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(fixed.WHITESPACE_CHARS))


def _in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def with_script(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the language of the most frequent script; '' when no script has enough characters.

    Of equally frequent scripts the one seen first in the text wins. All is counted in what is left of the text without
    the characters below the scripts, which is in the same order and mostly short.
    """
    docs = docs.withColumn("_high", F.when(beyond_ascii(F.col(text)), F.regexp_replace(text, _NO_SCRIPT, "")))
    size = F.length("_high")
    counts = F.struct(*[(size - F.length(F.regexp_replace("_high", f"[{b}]+", ""))).alias(c)
                        for c, b in fixed.SCRIPT_CLASSES.items()])
    docs = docs.withColumn("_scripts", F.when((size > fixed.MIN_SCRIPT_CHARS) & F.col("_high").rlike(_ANY_SCRIPT), counts))
    n = {code: F.col(f"_scripts.{code}") for code in fixed.SCRIPT_CLASSES}
    docs = docs.withColumn("_most", F.greatest(*n.values()))
    first = [
        F.when(n[code] == F.col("_most"),
               F.struct(F.regexp_instr("_high", F.lit(f"[{blocks}]")).alias("at"), F.lit(code).alias("code")))
        for code, blocks in fixed.SCRIPT_CLASSES.items()
    ]
    enough = F.col("_most") > fixed.MIN_SCRIPT_CHARS
    docs = docs.withColumn(out, F.when(enough, F.least(*first)["code"]).otherwise(""))
    return docs.drop("_high", "_scripts", "_most")


def with_profile(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Adds struct<hits, rank, lang> of the language with most function words, in list
    order on a tie. Only tokens that can be function words are taken from the text."""
    docs = docs.withColumn("_low", F.lower(text))
    plain = F.when(beyond_ascii(F.col("_low")), F.regexp_replace("_low", _FOREIGN_GAP, " ")).otherwise(F.col("_low"))
    docs = docs.withColumn("_framed", F.concat(F.lit(" "), plain, F.lit(" ")))
    docs = docs.withColumn("_tokens", F.regexp_extract_all("_framed", F.lit(_SHORT_WORD), F.lit(1)))
    docs = docs.withColumn("_words", F.expr(f"filter(_tokens, w -> w IN {_in_list(_KNOWN_WORDS)})"))
    scores = ", ".join(
        f"named_struct('hits', size(filter(_words, w -> w IN {_in_list(words)})), 'rank', {-rank}, 'lang', '{lang}')"
        for rank, (lang, words) in enumerate(fixed.LANGUAGE_WORDS.items())
    )
    return docs.withColumn(out, F.expr(f"array_max(array({scores}))")).drop("_low", "_framed", "_tokens", "_words")


def with_language(docs: DataFrame, text: str = "text", out: str = "lang_code") -> DataFrame:
    """Adds the language: 'en' for short texts, else by script (Chinese script with kana is Japanese), by function words, else 'en'.

    The function words are counted only where the script has not decided.
    """
    docs = with_script(docs, text, "_script")
    docs = docs.withColumn("_size", F.length(stripped(F.col(text))))
    open_text = F.when((F.col("_size") >= fixed.MIN_DETECT_LENGTH) & (F.col("_script") == ""), F.col(text))
    docs = with_profile(docs.withColumn("_open", open_text), "_open", "_best")
    code = (
        F.when(F.col("_size") < fixed.MIN_DETECT_LENGTH, "en")
        .when((F.col("_script") == "zh") & F.col(text).rlike(fixed.KANA), "ja")
        .when(F.col("_script") != "", F.col("_script"))
        .when(F.col("_best.hits") > 0, F.col("_best.lang"))
        .otherwise("en")
    )
    return docs.withColumn(out, code).drop("_script", "_size", "_open", "_best")
