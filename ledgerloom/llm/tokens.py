"""Token counts with a whole-token shortcut.

A text is cut into units that no merge can cross. Which units are a single token is proved once, from the vocabulary;
those are only counted, and the tokenizer is asked for the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_rows

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
#: Units of other lengths that a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000
SPACE = "▁"
_UNIT = re.compile(rf"\n|{SPACE}+(?:[^{SPACE}\n]+)?|[^{SPACE}\n]+")


@dataclass(frozen=True)
class Proof:
    """single: units that encode alone as one token; cut: whether units may be counted apart."""

    single: frozenset
    cut: bool


def _alone(processor, unit: str) -> int:
    """Tokens of a unit that stands by itself."""
    if unit.startswith(SPACE):
        return len(processor.encode(unit[1:].replace(SPACE, " "))) if len(unit) > 1 else 1
    # the library puts a space mark before a text; after a line feed, which is never merged, it has no effect
    return len(processor.encode("\n" + unit)) - len(processor.encode("\n"))


def prove(model_file: str) -> Proof:
    """Checks the vocabulary: units are independent if no piece has a space mark after another character or a line
    feed beside one, and the model changes no characters. Then every piece is encoded alone."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())
              if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i))]
    cut = not any(re.search(rf"[^{SPACE}]{SPACE}", p) or ("\n" in p and len(p) > 1) for p in pieces)
    cut = cut and processor.normalize("  Å  a ") == f"{SPACE * 3}Å{SPACE * 2}a{SPACE}"
    single = frozenset(p for p in pieces if _UNIT.fullmatch(p) and _alone(processor, p) == 1)
    return Proof(single, cut)


class Counter:
    """Counts tokens in one task."""

    def __init__(self, model_file: str, proof: Proof):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.proof = proof
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.proof.cut:
            return len(self.processor.encode(text))
        single, known, total = self.proof.single, self.known, 0
        for unit in _UNIT.findall(SPACE + text.replace(" ", SPACE)):
            if unit in single:
                total += 1
                continue
            n = known.get(unit)
            if n is None:
                n = _alone(self.processor, unit)
                if len(unit) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[unit] = n
            total += n
        return total


def count_tokens(docs: DataFrame, model_file: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    A null or empty text has no bytes and no tokens. Repeated rows give repeated results, other columns are ignored,
    an empty table gives none. The model file must be at the same path on every executor.
    """
    proved = prove(model_file)
    sent = docs.sparkSession.sparkContext.broadcast((proved.single, proved.cut))  # bounded by the vocabulary

    def each(row, counter):
        text = row["text"]
        n = counter.count(text)
        size = len(text.encode("utf-8", "surrogatepass")) if text else 0
        yield {"doc_id": row["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": n > limit}

    return map_rows(docs.select("doc_id", "text"), each, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
                    setup=lambda: Counter(model_file, Proof(*sent.value)))
