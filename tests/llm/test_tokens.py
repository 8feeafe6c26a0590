import random

import public_tokenizers
import sentencepiece

from ledgerloom.llm.tokens import MODEL, count_tokens, prove

TEXTS = ["", None, " ", "  a", "a  ", "\n", "\nbar", "a\n\n b", "a▁b ▁ c", "<s> <unk> <0x0A> </s>", "é ü　x", "汉字 and 漢字かな", "\x00\t\r", "🙂🙂 🙂",
         "The the THE thE", "x" * 3000, "word " * 6000]


def test_equals_the_library(docs_of):
    path = public_tokenizers.path(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    draw = random.Random(8)
    texts = TEXTS + ["".join(draw.choice("ab e\n▁.,0é漢🙂<>") for _ in range(draw.randint(1, 60))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(None, "a b"), (14, TEXTS[14])]
    got = count_tokens(docs_of(rows, "n_tokens n_bytes"), path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]]
        want = len(library.encode(text)) if text else 0
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len((text or "").encode()), want > 4096), repr(text)
    assert count_tokens(docs_of([]), path).count() == 0


def test_proof_covers_most_of_the_vocabulary():
    proof = prove(public_tokenizers.path(MODEL))
    assert proof.cut and len(proof.single) > 25_000 and "▁the" in proof.single
