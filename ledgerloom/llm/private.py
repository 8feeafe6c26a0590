"""Personal data: fixed shapes, and bootstrapped patterns that find identifiers the shapes miss.

Identifiers found by shape are seeds. The words around them are patterns; a pattern is trusted by the share of its
values that are trusted, a value by the patterns it occurs in. Rounds over that graph, until nothing moves, find values of
a looser shape, such as a telephone number without a country code behind the words that precede other telephone numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from ipaddress import AddressValueError, IPv6Address
from itertools import accumulate

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import hot_join, map_rows, written

KINDS = ("email", "ip", "card", "phone")
#: A round that moves no value's trust by more than this is the last.
SETTLED = 1e-6
#: A pattern needs so many distinct trusted values, and this share of all its values.
PATTERN_SUPPORT = 3
PATTERN_CONFIDENCE = 0.8
VALUE_CONFIDENCE = 0.8

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is never taken from its middle, so looking behind changes no match but spares a second look at each digit
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Looser shapes, by kind, for values that only patterns may confirm.
LOOSE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)[0-9A-Fa-f:]{3,39})(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w.-])"),
}
#: A longer context stands as its hash, so that very long words make no long rows.
LONG_PATTERN = 200


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start: leftmost non-overlapping matches of each kind that pass its test."""
    if not text:
        return []
    spans: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        part = text[done:at]
        start = done + len(part.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            spans.append(("email", start, domain.end()))
            done = domain.end()
        else:
            done = at + 1  # an @ is in no local part
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (g.lstrip("0") or "0" for g in m.groups())):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _compressed(text: str) -> bool:
    try:
        return bool(int(IPv6Address(text)))
    except AddressValueError:
        return False


def loose_spans(text: str | None, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Matches of the looser shapes that touch no span found by shape, nor one of an earlier kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    blocked = sorted((s, e) for _, s, e in taken)
    for kind in KINDS:
        ends = list(accumulate((e for _, e in blocked), max))  # the farthest end of any span up to here
        starts = [s for s, _ in blocked]
        for m in LOOSE[kind].finditer(text):
            if "::" in m[0] and not _compressed(m[0]):
                continue
            before = bisect_left(starts, m.end())
            if not before or ends[before - 1] <= m.start():
                found.append((kind, *m.span()))
        blocked = sorted([*blocked, *((s, e) for k, s, e in found if k == kind)])
    return found


def _level(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower())


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[list[str]]:
    """Per span what stands around it: the two words before it, and the word before with the word after.

    Words are whole, in lower case with digits levelled. A neighbouring value stands as its kind and nothing beyond it is
    looked at, so each part of a text is read a few times only, however many values it has.
    """
    by_end = sorted((e, k) for k, _, e in spans)
    by_start = sorted((s, k) for k, s, _ in spans)
    ends, starts = [e for e, _ in by_end], [s for s, _ in by_start]
    out = []
    for _, start, end in spans:
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        before = [_level(w) for w in text[ends[i - 1] if i else 0:start].rsplit(None, 2)[-2:]]
        if i and len(before) < 2:
            before = [f"<{by_end[i - 1][1]}>", *before]
        after = [_level(w) for w in text[end:starts[j] if j < len(starts) else len(text)].split(None, 1)[:1]]
        if not after and j < len(starts):
            after = [f"<{by_start[j][1]}>"]
        found = [" ".join(before) + " _"] if len(before) == 2 else []
        if before and after:
            found.append(f"{before[-1]} _ {after[0]}")
        out.append([p if len(p) <= LONG_PATTERN else xxhash.xxh3_128_hexdigest(p.encode("utf-8", "surrogatepass"))
                    for p in found])
    return out


def value(kind: str, text: str) -> str:
    """One form for the ways to write a value."""
    return _NOT_DIGIT.sub("", text) if kind in ("card", "phone") else re.sub(r"\s", "", text.lower())


def join_spans(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


_MENTION = "struct<kind:string,start:bigint,stop:bigint,value:string,patterns:array<string>>"


def mentions(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, the spans by shape, and all mentions with their patterns; written once."""
    def each(row):
        text = row["text"] or ""
        base = base_spans(text)
        loose = loose_spans(text, base)

        found = [{"kind": k, "start": s, "stop": e, "value": value(k, text[s:e]), "patterns": around}
                 for (k, s, e), around in zip(base + loose, contexts(text, base + loose))]
        yield {"doc_id": row["doc_id"], "text_hash": row["text_hash"],
               "seeds": found[:len(base)], "others": found[len(base):]}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = map_rows(rows, each, f"doc_id bigint, text_hash bigint, seeds array<{_MENTION}>, others array<{_MENTION}>")
    return written(found.withColumn("row_id", F.monotonically_increasing_id()), "private-mentions")


def trusted_values(found: DataFrame, support: int = PATTERN_SUPPORT,
                   pattern_confidence: float = PATTERN_CONFIDENCE, value_confidence: float = VALUE_CONFIDENCE) -> DataFrame:
    """(kind, value, confidence) of values that patterns confirm, without the seeds.

    The graph has one edge for each pattern and value of a kind, however often they occur, so copies count once. Trust
    only grows from round to round and is 1 at most, so the rounds come to an end by themselves.
    """
    def edges(column: str, seed: bool) -> DataFrame:
        return (found.select(F.explode(column).alias("m")).select("m.kind", "m.value", F.explode("m.patterns").alias("pattern"))
                .withColumn("seed", F.lit(seed)))

    graph = (edges("seeds", True).unionByName(edges("others", False))
             .groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")))
    # patterns that no seed ever had can't become trusted in the first round, yet in a later one: all edges stay
    graph = written(graph.withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(0.0)), "private-graph")
    moved = not found.where(F.size("others") > 0).isEmpty()
    while moved:
        pattern = (graph.groupBy("kind", "pattern")
                   .agg(F.count("*").alias("n"), F.sum("trust").alias("sure"),
                        F.sum((F.col("trust") >= value_confidence).cast("int")).alias("k"))
                   .where((F.col("k") >= support) & (F.col("sure") / F.col("n") >= pattern_confidence))
                   .select("kind", "pattern", (F.col("sure") / F.col("n")).alias("p")))
        value_trust = (hot_join(graph.where(~F.col("seed")), pattern, ["kind", "pattern"], "value")
                       .groupBy("kind", "value")
                       .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("new")))
        scored = (graph.drop("moved").join(value_trust, ["kind", "value"], "left")
                  .withColumn("new", F.when(F.col("seed"), 1.0).otherwise(F.greatest("trust", F.coalesce("new", F.lit(0.0)))))
                  .select("kind", "pattern", "value", "seed", F.col("new").alias("trust"),
                          (F.col("new") - F.col("trust") > SETTLED).alias("moved")))
        graph = written(scored, "private-graph")
        moved = not graph.where("moved").isEmpty()
    return (graph.where(~F.col("seed") & (F.col("trust") >= value_confidence))
            .groupBy("kind", "value").agg(F.max("trust").alias("confidence")))


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, counts by kind of the spans by shape, base and all (spans, comma-joined) for every row.

    A null or empty text has no spans, rows without a doc_id are results without one, repeated rows give repeated
    results and other columns are ignored; an empty table gives no rows.
    """
    found = mentions(docs)
    values = trusted_values(found)
    extra = (hot_join(found.select("row_id", F.explode("others").alias("m")).select("row_id", "m.*"),
                      values, ["kind", "value"], "row_id")
             .groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra")))
    both = found.join(extra, "row_id", "left")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def text_of(spans):
        ordered = F.array_sort(F.transform(spans, lambda m: F.struct(
            rank[m["kind"]].alias("rank"), m["start"].alias("start"), m["stop"].alias("stop"), m["kind"].alias("kind"))))
        return F.array_join(F.transform(ordered, lambda m: F.concat_ws(
            ":", m["kind"], m["start"].cast("string"), m["stop"].cast("string"))), ",")

    def count_of(kind):
        return F.size(F.filter("seeds", lambda m: m["kind"] == kind)).cast("bigint")

    seeds = F.transform("seeds", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"),
                                                    m["stop"].alias("stop")))
    everything = F.concat(seeds, F.coalesce("extra", F.array().cast("array<struct<kind:string,start:bigint,stop:bigint>>")))
    return both.select(
        "doc_id", "text_hash",
        *[count_of(k).alias(f"n_{k}") for k in KINDS],
        text_of(seeds).alias("base"), text_of(everything).alias("spans"))


def mask(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    if not text or not spans:
        return text
    parts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",")))
    out, done = [], 0
    for s, e, k in parts:
        if s >= done:
            out += [text[done:s], f"[{k.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def mask_private(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all columns and rows stay."""
    extra = (find_private(docs).where(F.col("spans") != "").select("doc_id", "text_hash", "spans")
             .dropDuplicates(["doc_id", "text_hash"]))
    columns, schema = docs.columns, docs.schema
    left = docs.withColumn("__hash", F.xxhash64("text")).alias("d")
    joined = left.join(extra.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) &
                       (F.col("d.__hash") == F.col("x.text_hash")), "left")
    joined = joined.select(*[F.col(f"d.`{c}`") for c in columns], F.col("x.spans").alias("__spans"))

    def each(row):
        spans = row.pop("__spans")
        row["text"] = mask(row["text"], spans)
        yield row

    return map_rows(joined, each, schema)
