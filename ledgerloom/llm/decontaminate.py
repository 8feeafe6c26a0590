"""Benchmark passages in documents, up to a budget of word edits.

An item of n words may have k = n // WORDS_PER_ERROR edits. Cut into k + 1 pieces, at least one piece is unchanged in
every passage within the budget, so exact hits of pieces find all of them; Myers' bit-parallel edit distance over words
then decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_rows

WORDS_PER_ERROR = 6
#: Words of the items that are searched for in one pass over the documents; further items take further passes.
BLOCK_WORDS = 1_000_000
_WORD = re.compile(r"\w+")


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n, parts = len(words), min(budget + 1, len(words))
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(pattern: list[str], words: list[str]) -> tuple[int, int]:
    """(least distance, its last word's index) of the pattern to any part of words; bit i stands for pattern word i."""
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, -1
    for j, w in enumerate(words):
        same = masks.get(w, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise = down | ~(across | up) & full
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = fall | ~(vertical | rise) & full
        down = rise & vertical
        if score < best:
            best, at = score, j
    return best, at


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Windows that meet as one, so that each word is looked at once."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


class Matcher:
    """Finds the items of one block in texts; made once per task."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        import ahocorasick

        self.items, self.where = items, {}
        for i, (_, words) in enumerate(items):
            for offset, piece in pieces(words, len(words) // WORDS_PER_ERROR):
                self.where.setdefault(" " + " ".join(piece) + " ", []).append((i, offset, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece in self.where:
            self.automaton.add_word(piece, piece)
        if self.where:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, distance, index of the last matching word), the best for each item within its budget."""
        words = normal_words(text)
        if not words or not self.where:
            return []
        line = " " + " ".join(words) + " "
        starts: list[int] = []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, piece in self.automaton.iter(line):
            if not starts:
                at = 0
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            first = bisect_left(starts, end - len(piece) + 1)
            for i, offset, _ in self.where[piece]:
                n = len(self.items[i][1])
                k = n // WORDS_PER_ERROR
                windows.setdefault(i, []).append((max(0, first - offset - k), first - offset + n + k))
        out = []
        for i, spans in windows.items():
            item_id, pattern = self.items[i]
            found: tuple[int, int] | None = None
            for a, b in _joined(spans):
                distance, at = best_match(pattern, words[a:b])
                if distance <= len(pattern) // WORDS_PER_ERROR and (found is None or distance < found[0]):
                    found = distance, a + at
            if found:
                out.append((item_id, *found))
        return sorted(out, key=lambda x: (x[0] is None, x))


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of bounded size, one after the other; items without a word are left out."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").dropDuplicates().toLocalIterator():
        words = normal_words(row["text"])
        if words and block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((row["item_id"], words))
            size += len(words)
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, distance, last_word for every item found in a row of docs (doc_id, text).

    Words are compared in lower case without punctuation. Items of fewer than WORDS_PER_ERROR words must occur
    unchanged; items without a word are never found, nor is anything in null or empty texts. last_word is the index of
    the passage's last word. Of places with equal distance the first counts. Repeated documents give repeated results;
    other columns are ignored. Empty tables give no rows.

    Documents aren't shuffled: a pass reads them once for each block of items.
    """
    schema = "doc_id bigint, item_id bigint, distance int, last_word bigint"

    def each(row, matcher):
        for item, distance, last in matcher.hits(row["text"]):
            yield {"doc_id": row["doc_id"], "item_id": item, "distance": distance, "last_word": last}

    found = None
    for block in item_blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)  # bounded by block_words
        part = map_rows(docs.select("doc_id", "text"), each, schema, setup=lambda sent=sent: Matcher(sent.value))
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def without_passages(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns."""
    schema = docs.schema

    def each(row, matcher):
        if not matcher.hits(row["text"]):
            yield row

    for block in item_blocks(benchmark, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = map_rows(docs, each, schema, setup=lambda sent=sent: Matcher(sent.value))
    return docs
