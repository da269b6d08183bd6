"""Ids of the cutting encoder are those of the tokenizers library."""

import random

import pyarrow as pa
import pytest

from quarry.llm import tokens
from quarry.llm.tokens import encoder, tokenizer_path

PARTS = [
    "’s", "“", "…", "×", "÷", "ÿ", "Ā", "ж", "҂", "a1", "'", "-", "@", "ñ", "a", "b", "foo", "Bar", "é", "ß", "中", "文", " ", "  ", "   ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", "'s", "'ll",
    "1", "23", "²", ".", ",", "!", "...", "</s>", "<|endoftext|>", "👍", "\0", "\r\n", "́", " \n ",
]


@pytest.mark.parametrize("window, memo", [(8 << 20, 1_000_000), (37, 50)])
def test_ids_are_the_librarys(monkeypatch, window, memo):
    monkeypatch.setattr(tokens, "SPLIT_BYTES", window)
    monkeypatch.setattr(tokens, "MEMO_PIECES", memo)
    rng = random.Random(window)
    enc = encoder(tokenizer_path())
    enc.clear()
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20_000 if memo > 50 else 2_000)] + [None, "", "x" * 500, "word " * 300]
    begins, ids = enc.encode_column(pa.array(texts, pa.string()).slice(1))
    for i, text in enumerate(texts[1:]):
        assert ids[begins[i] : begins[i + 1]].tolist() == enc.tok.encode(text or "", add_special_tokens=False).ids, repr(text)
    assert begins[-1] == len(ids)
    assert enc.encode_column(pa.array([], pa.string()))[0].tolist() == [0] and not len(enc.encode(None))
