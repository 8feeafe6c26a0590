"""Phrase collocations counted on a dictionary of repeated chunks, by prefix-free parsing.

Texts are cut into chunks at places that their own words choose, so a passage that comes back is cut alike. Neighbouring
chunks share three tokens. Each distinct chunk is kept once with its number of occurrences, and phrases are counted in
the distinct chunks, weighted; a phrase belongs to the chunk in which it starts before the shared end. Single words are
counted while parsing.

A phrase is known by the hashes of the phrase without its last and without its first word, so the frequent phrases of
one length name those of the length below, and words need to be looked up only for what is reported. Longer phrases are
counted only where both of these may be frequent. What may be is a filter of fixed size over the frequent shorter
phrases: it lets some others through, whose counts then show that they aren't, and drops none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import SALTS, bounded_batches, skew_join, written

LEAST_COUNT = 30
LONGEST = 4
#: A candidate goes if a longer one around it has so many percent of its count.
INSIDE_PERCENT = 80
REPORTED = 2000
SCORE_SCALE = 2_000_000
NO_LANGUAGE = "und"
#: One place in so many starts a chunk; a chunk without one ends after so many tokens.
CHUNK_EVERY, CHUNK_MOST = 32, 4096
#: Tokens that neighbouring chunks share: a phrase that starts before them ends inside the chunk.
SHARED = LONGEST - 1
#: Bits of the filter over frequent phrases, which every task gets; more than this many phrases only make it let more
#: through.
FILTER_BITS = 1 << 26
#: Bytes of text that are cut into tokens together (more for a longer word), bytes of chunks whose phrases are counted
#: together, and words whose counts a task holds.
SEGMENT, BATCH_BYTES, REMEMBERED = 1 << 21, 12 << 20, 1 << 19

END = b"."  # of a piece; no word holds it
_LEVEL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\v\f\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")
_TURN = np.cumprod(np.full(LONGEST + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93


def levelled(text: bytes | None) -> bytes:
    """A text in UTF-8 with A-Z in lower case, END for what ends a piece, blanks for tabs, and SHARED times END."""
    return (text or b"").translate(_LEVEL) + END * SHARED


class Tokens:
    """The words and ENDs of a levelled text, with hashes of the words.

    A word's hash is a polynomial of random numbers that stand for its bytes, modulo 2^64, read off running sums.
    """

    _bytes = np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 64, 256, np.uint64)
    _powers = np.ones((2, 1), np.uint64)

    def __init__(self, text: bytes):
        parts, done = [], 0
        while done < len(text):
            parts.append(self._segment(text, done, self._cut(text, done + SEGMENT)))
            done = parts[-1][-1]
        self.start, self.stop, self.hash = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind)
                                            for i, kind in enumerate((np.int64, np.int64, np.uint64)))
        self.word = self.hash != 0

    @staticmethod
    def _cut(text: bytes, at: int) -> int:
        """The first place from `at` on where no word is cut."""
        if at >= len(text):
            return len(text)
        after = [x for x in (text.find(b" ", at), text.find(END, at)) if x >= 0]
        return min(after, default=len(text))

    @classmethod
    def _powers_to(cls, n: int) -> np.ndarray:
        if cls._powers.shape[1] < n:
            base = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64).repeat(n, axis=1)
            base[:, 0] = 1
            cls._powers = np.cumprod(base, axis=1, dtype=np.uint64)
        return cls._powers

    def _segment(self, text: bytes, begin: int, end: int) -> tuple:
        read = np.frombuffer(text, np.uint8, end - begin, begin)
        dot = read == END[0]
        inside = np.zeros(len(read) + 2, np.int8)
        inside[1:-1] = (read != 32) & ~dot
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        start = np.flatnonzero((edge[:-1] == 1) | dot)
        word = ~dot[start]
        stop = start + 1
        stop[word] = last
        powers = self._powers_to(len(read))
        sums = np.zeros(len(read) + 1, np.uint64)
        np.cumsum(self._bytes[read] * powers[0, :len(read)], out=sums[1:])
        hashes = np.zeros(len(start), np.uint64)
        hashes[word] = _mixed((sums[last] - sums[first]) * powers[1, first]) | np.uint64(1)
        return start + begin, stop + begin, hashes, end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its beginning and its end."""
    return _mixed(left * _TURN[0] + _mixed(right ^ _TURN[1]))


def chunk_edges(hashes: np.ndarray, heads: np.ndarray, every: int = CHUNK_EVERY,
                most: int = CHUNK_MOST) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk the first token and the first that it shares with the next; heads are the first tokens of texts.

    A chunk starts with a text and wherever the hash of the next three tokens says so; a text's last three start none.
    """
    tails = np.append(heads[1:], len(hashes)) - SHARED
    window = np.zeros(len(hashes), np.uint64)
    for k in range(SHARED):
        window[:len(hashes) - k] += hashes[k:] * _TURN[k]
    starts = _mixed(window) % np.uint64(every) == 0
    starts[heads] = True
    for k in range(SHARED):
        starts[tails + k] = False
    first = np.flatnonzero(starts)
    next_ = np.minimum(np.append(first[1:], len(hashes)), tails[np.searchsorted(heads, first, "right") - 1])
    parts = -(-(next_ - first) // most)
    if (parts > 1).any():
        at = np.repeat(first, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        first, next_ = at, np.minimum(at + most, np.repeat(next_, parts))
    return first, next_


class _Counts:
    """Counts of words with their language, by hash."""

    def __init__(self):
        self.keys, self.ids, self.n = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.words: list[tuple[str, bytes]] = []

    def add(self, keys: np.ndarray, n: np.ndarray, words) -> None:
        """Adds n to sorted distinct keys; words(indexes) gives the words of those that are new."""
        at = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == keys[inside]
        self.n[self.ids[at[old]]] += n[old]
        new = np.flatnonzero(~old)
        self.keys = np.insert(self.keys, at[new], keys[new])
        self.ids = np.insert(self.ids, at[new], len(self.n) + np.arange(len(new)))
        self.n = np.concatenate([self.n, n[new]])
        self.words += words(new)

    def rows(self) -> tuple:
        return [lang for lang, _ in self.words], True, [w for _, w in self.words], self.n


def parse(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (lang, chunk: levelled text, n: occurrences) and words (lang, word, h, f), both in UTF-8.

    Both come out of one pass and one shuffle, which is written.
    """
    schema = pa.schema([("lang", pa.string()), ("word", pa.bool_()), ("part", pa.binary()), ("n", pa.int64())])

    def table(langs, word: bool, parts, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([word] * len(parts), pa.bool_()),
                                           pa.array(parts, pa.binary()), pa.array(n, pa.int64())], schema=schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts = _Counts()

        def cut(texts: list[bytes], langs: list[str]) -> pa.RecordBatch:
            joined = b"".join(texts)
            found = Tokens(joined)
            heads = np.searchsorted(found.start, np.cumsum([0, *map(len, texts[:-1])]))
            names, of = np.unique(langs, return_inverse=True)
            lang = np.repeat(of, np.diff(np.append(heads, len(found.start))))
            at = np.flatnonzero(found.word)
            key = found.hash[at] ^ _seeds(names.tolist())[lang[at]]
            key, place, n = np.unique(key, return_index=True, return_counts=True)
            place = at[place]
            counts.add(key, n, lambda new: [(w, joined[a:b]) for w, a, b in zip(
                names[lang[place[new]]].tolist(), found.start[place[new]].tolist(), found.stop[place[new]].tolist())])
            first, next_ = chunk_edges(found.hash, heads)
            parts = [joined[a:b] for a, b in zip(found.start[first].tolist(), found.stop[next_ + SHARED - 1].tolist())]
            return table(names[lang[first]].tolist(), False, parts, [1] * len(parts))

        texts, langs = [], []
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                texts.append(levelled(text))
                langs.append(lang)
            if sum(map(len, texts)) >= SEGMENT:
                yield cut(texts, langs)
                texts, langs = [], []
                if len(counts.words) >= REMEMBERED:
                    yield table(*counts.rows())
                    counts = _Counts()
        if texts:
            yield cut(texts, langs)
        yield table(*counts.rows())

    def hashed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word, n = (batch.column(c) for c in ("lang", "part", "n"))
            h = Tokens(b" ".join(word.to_pylist())).hash
            names, of = np.unique(np.array(lang.to_pylist(), object), return_inverse=True) if len(h) else ([], [])
            yield pa.RecordBatch.from_arrays([lang, word, _signed(_mixed(h ^ _seeds(list(names))[of]) if len(h) else h), n],
                                             names=["lang", "word", "h", "f"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    both = rows.mapInArrow(run, "lang string, word boolean, part binary, n bigint")
    both = written(both.groupBy("lang", "word", "part").agg(F.sum("n").alias("n")), "phrase-chunks")
    words = both.where("word").select("lang", "part", "n").mapInArrow(hashed, "lang string, word binary, h bigint, f bigint")
    return both.where(~F.col("word")).select("lang", F.col("part").alias("chunk"), "n"), written(words, "phrase-words")


def _seeds(langs: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=1) for x in langs], np.uint64)


class _Batch:
    """Tokens of many chunks in a row, with the hashes of their phrases."""

    def __init__(self, chunks: list[bytes], counts: np.ndarray, langs: list[str]):
        found = Tokens(b" ".join(chunks))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        heads = np.searchsorted(found.start, np.cumsum(sizes) - sizes)
        lengths = np.diff(np.append(heads, len(found.start)))
        names, of = np.unique(np.array(langs, object), return_inverse=True)
        self.weight = np.repeat(counts, lengths)
        self.hash = {1: _mixed(found.hash ^ np.repeat(_seeds(names.tolist())[of], lengths))}
        self.own = np.ones(len(found.start), bool)
        last = np.cumsum(lengths)
        for k in range(1, SHARED + 1):
            self.own[last - k] = False
        # words from here to the end of the piece, LONGEST at most
        self.run = np.zeros(len(found.start), np.int8)
        for _ in range(LONGEST):
            self.run[:-1] = np.where(found.word[:-1], 1 + np.minimum(self.run[1:], LONGEST - 1), 0)

    def at(self, n: int) -> np.ndarray:
        """Where phrases of n words start."""
        return np.flatnonzero(self.own & (self.run >= n))

    def hashes(self, n: int) -> np.ndarray:
        """Hash of the n tokens from each place on; of no use where they leave the chunk."""
        if n not in self.hash:
            shorter = self.hashes(n - 1)
            self.hash[n] = pair_hash(shorter, np.roll(shorter, -1))
        return self.hash[n]


def _counted(key: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each distinct (left, right), of which key is a hash, and its sum of weights."""
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(key)
    a, b, c = key[order], left[order], right[order]
    other = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    if (other & (a[1:] == a[:-1])).any():  # two phrases share their hash
        order = np.lexsort((right, left))
        b, c = left[order], right[order]
        other = (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    new = np.flatnonzero(np.concatenate([[True], other]))
    return order[new], np.add.reduceat(weight[order], new)


def _slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [hashes % np.uint64(bits), (hashes >> np.uint64(32)) % np.uint64(bits)]


def _may_be(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    first, second = ((filled[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                     for slot in _slots(hashes, 64 * len(filled)))
    return (first & second) == 1


def _batches(chunks: DataFrame, work, schema: str) -> DataFrame:
    """work(_Batch) -> RecordBatch, over rows of BATCH_BYTES or so."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        size, parts, counts, langs = 0, [], [], []
        for rows in batches:
            parts += rows.column("chunk").to_pylist()
            langs += rows.column("lang").to_pylist()
            counts.append(rows.column("n").to_numpy())
            size += rows.column("chunk").nbytes
            if size >= BATCH_BYTES:
                yield work(_Batch(parts, np.concatenate(counts), langs))
                size, parts, counts, langs = 0, [], [], []
        if parts:
            yield work(_Batch(parts, np.concatenate(counts), langs))

    return chunks.select("lang", "chunk", "n").mapInArrow(run, schema)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def count_phrases(chunks: DataFrame, n: int, least: int, shorter: DataFrame | None = None,
                  filter_bits: int = FILTER_BITS) -> DataFrame:
    """h, l, r, f of the phrases of n words that occur `least` times or more: own hash, those without the last and
    without the first word, occurrences; written.

    If the frequent phrases one shorter are given, only phrases both of whose parts may be among them are counted.
    """
    held = chunks.sparkSession.sparkContext.broadcast(phrase_filter(shorter, filter_bits)) if shorter is not None else None

    def work(batch: _Batch) -> pa.RecordBatch:
        at, parts = batch.at(n), batch.hashes(n - 1)
        if held is not None:
            at = at[_may_be(held.value, parts[at])]
            at = at[_may_be(held.value, parts[at + 1])]
        left, right = parts[at], parts[at + 1]
        first, total = _counted(pair_hash(left, right), left, right, batch.weight[at])
        return pa.RecordBatch.from_arrays([_signed(left[first]), _signed(right[first]), pa.array(total)], names=["l", "r", "f"])

    def named(batches):
        for batch in batches:
            l, r = (batch.column(c).to_numpy().view(np.uint64) for c in "lr")
            yield pa.RecordBatch.from_arrays([_signed(pair_hash(l, r)), *batch.columns], names=["h", "l", "r", "f"])

    parts = _batches(chunks, work, "l bigint, r bigint, f bigint")
    counted = parts.groupBy("l", "r").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(counted.mapInArrow(named, "h bigint, l bigint, r bigint, f bigint"), "phrase-counts")


def phrase_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of phrases (h): two bits each, as bits / 64 words of 64 bits."""
    def slots(batches):
        for batch in batches:
            found = np.concatenate(_slots(batch.column("h").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([_signed(found)], names=["slot"])

    word = F.shiftright("slot", 6).alias("word")
    set_bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    rows = (phrases.select("h").mapInArrow(slots, "slot bigint").select(word, set_bit.alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # bits / 64 rows at most
    filled = np.zeros(bits // 64, np.uint64)
    filled[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return filled


def candidates(two: DataFrame, three: DataFrame, four: DataFrame) -> DataFrame:
    """h, a, words, cuts (cut, left, right), inner: hashes of the words, of both parts of each cut and of the shorter
    phrases inside, for every frequent phrase; written."""
    def cut(i: int, left: str, right: str):
        return F.struct(F.lit(i).alias("cut"), F.col(left).alias("left"), F.col(right).alias("right"))

    def side(phrases: DataFrame, names: list[str], key: str) -> DataFrame:
        return phrases.select(F.col("h").alias(key), *[F.col(old).alias(new) for old, new in zip(("l", "r"), names) if new])

    def shape(phrases: DataFrame, words: str, cuts: list, inner: list[str]) -> DataFrame:
        empty = F.array().cast("array<bigint>")
        return phrases.select("h", F.col("f").alias("a"), F.array(*words.split()).alias("words"), F.array(*cuts).alias("cuts"),
                              (F.array(*inner) if inner else empty).alias("inner"))

    pairs = shape(two, "l r", [cut(1, "l", "r")], [])
    # a beginning or an end such as "of the" may be that of a large share of the phrases
    triples = skew_join(three, side(two, ["w1", "w2"], "l"), ["l"], "r")
    triples = written(skew_join(triples, side(two, [None, "w3"], "r"), ["r"], "l"), "phrase-triples")
    quads = four.select("h", "f", F.col("l").alias("w123"), F.col("r").alias("w234"))
    first = triples.select(F.col("h").alias("w123"), F.col("l").alias("w12"), F.col("r").alias("w23"), "w1", "w2", "w3")
    second = triples.select(F.col("h").alias("w234"), F.col("r").alias("w34"), F.col("w3").alias("w4"))
    quads = skew_join(skew_join(quads, first, ["w123"], "w234"), second, ["w234"], "w123")
    return written(
        pairs.unionByName(shape(triples, "w1 w2 w3", [cut(1, "w1", "r"), cut(2, "l", "w3")], ["l", "r"]))
        .unionByName(shape(quads, "w1 w2 w3 w4", [cut(1, "w1", "w234"), cut(2, "w12", "w34"), cut(3, "w123", "w4")],
                           ["w12", "w23", "w34", "w123", "w234"])), "phrase-candidates")


def scored(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """h, l, r, score of every candidate, from the counts (h, f): the cut with the least score, the earliest on ties."""
    cuts = phrases.select("h", "a", F.explode("cuts").alias("c")).select("h", "a", "c.*")
    cuts = skew_join(cuts, known.select(F.col("h").alias("left"), F.col("f").alias("l")), ["left"], "h")
    cuts = skew_join(cuts, known.select(F.col("h").alias("right"), F.col("f").alias("r")), ["right"], "h")
    # a product may pass 64 bits, the quotient is SCORE_SCALE / 2 at most
    wide = F.lit(SCORE_SCALE).cast("decimal(19,0)") * F.col("a").cast("decimal(19,0)")
    cuts = cuts.withColumn("wide", wide).withColumn("both", F.col("l").cast("decimal(19,0)") + F.col("r"))
    cuts = cuts.withColumn("score", F.expr("wide div both").cast("bigint"))
    return (cuts.groupBy("h").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
            .select("h", "best.l", "best.r", "best.score"))


def mine_collocations(docs: DataFrame, least: int = LEAST_COUNT, inside_percent: int = INSIDE_PERCENT,
                      reported: int = REPORTED, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `reported` collocations of every language.

    Texts are put in lower case (A-Z) and split into pieces at `.,;:!?` and line ends, pieces into words at blanks and
    tabs. Candidates are phrases of two to four words that occur a >= least times within pieces. A cut into two parts of
    l and r occurrences scores floor(2000000 * a / (l + r)); the lowest-scoring cut counts. A candidate inside a longer
    one that occurs inside_percent of a times or more is dropped. The order is score, a, both falling, then the
    phrase's bytes. n is the number of words of the language.

    A null text is empty, a null lang is `und`; other columns are ignored, repeated rows count each, and a table without
    words gives no rows. Words are told apart by 64 bits of hash with their language, phrases by the two hashes of their
    beginning and end.
    """
    chunks, words = parse(docs)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = [count_phrases(chunks, 2, least)]
    for n in range(3, LONGEST + 1):
        counts.append(count_phrases(chunks, n, least, counts[-1], filter_bits))
    known = words.where(F.col("f") >= least).select("h", "f")
    for more in counts:
        known = known.unionByName(more.select("h", "f"))
    every = candidates(*counts)
    around = (every.select("a", F.explode("inner").alias("h")).groupBy("h").agg(F.max("a").alias("around")))
    left = every.join(scored(every, written(known, "phrase-known")), "h").join(around, "h", "left")
    left = left.where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    # the first word of a large share of the phrases may be the same
    left = written(left.select("h", "a", "l", "r", "score", "words", F.col("words")[0].alias("w1")), "phrase-scored")
    left = skew_join(left, words.select(F.col("h").alias("w1"), "lang"), ["w1"], "h")

    # first without the texts, ties kept, in parts of a language, so that few phrases need their words
    part = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy(F.desc("score"), F.desc("a"))
    whole = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    for window in (part, whole):
        left = left.withColumn("place", F.rank().over(window)).where(F.col("place") <= reported)
    left = written(left, "phrase-ranked")
    text = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    named = (left.select("h", F.posexplode("words").alias("at", "w"))
             .join(words.select(F.col("h").alias("w"), F.col("word").cast("string").alias("word")), "w")
             .groupBy("h").agg(F.array_join(text, " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (left.join(named, "h").withColumn("rank", F.row_number().over(order).cast("bigint"))
              .where(F.col("rank") <= reported))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
