"""Words of letters reach the merges without the tokenizer's cutting, with the ids it gives."""

import random

import numpy as np
import public_tokenizers
import pytest

from airtrail.llm import tokens


@pytest.fixture(scope="module")
def words():
    return tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_only_words_with_other_signs_are_cut(words, monkeypatch):
    asked, plain = [], words.ids
    monkeypatch.setattr(words, "ids", lambda text: asked.append(text) or plain(text))
    texts = ["Über die grüne Brücke, señor!!", "Unlisted wordlets theranedtiha*** ÉCOLE déjà.", "don't x2"]
    got = list(words.encode(texts))
    assert got == [np.array(plain(t), "<u4").tobytes() for t in texts]
    seen = set(" ".join(asked).split()) - {tokens.MARK}
    assert seen == {",", "!!", "***", ".", "don't", "x2"}


def test_ids_of_odd_words(words):
    draw = random.Random(3)
    signs = [*map(chr, range(33, 0x180)), "İ", "Σ", "ſ", "ﬁ", "ǆ", "ẞ", "́", "̸", "K", "­"]
    signs += list("abcdeéöß.,'&!stSTÉÖ") * 30
    texts = [" ".join("".join(draw.choices(signs, k=draw.randint(1, 8))) for _ in range(40)) for _ in range(300)] + ["", None, "<|endoftext|>a endoftext"]
    want = [np.array(words.ids(t or ""), "<u4").tobytes() for t in texts]
    assert list(words.encode(texts)) == want
