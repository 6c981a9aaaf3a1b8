"""Words of the language model: the pattern's matches, without its cost for every letter."""

from __future__ import annotations

import random
import re
import time

from airtrail.llm import langid


def test_words_are_the_matches_of_the_pattern():
    rng = random.Random(4)
    pool = [*langid.SIGNS[:200], *"abcéßñ日本İ_ 12\n٣" * 12]
    texts = ["", " ", "½", "x²y", "".join(pool), *("".join(rng.choice(pool) for _ in range(120)) for _ in range(200))]
    assert all(langid.words_of(t) == langid.WORD.findall(t) for t in texts)


def test_letters_are_not_compared_with_every_number_sign():
    text = "the quick brown fox été " * 20_000

    def least(split):
        times = []
        for _ in range(3):
            began = time.thread_time()
            split(text)
            times.append(time.thread_time() - began)
        return min(times)

    assert least(langid.words_of) < 4 * least(re.compile(r"[^\W\d_]+").findall)
