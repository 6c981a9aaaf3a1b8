"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack

import numpy as np

from .common import pieces, worker_store

MARK = "\x01"  # stands between words encoded in one call
KEPT = 250_000  # words of a generation; a worker remembers two
LETTERS = [c for c in map(chr, (*range(0x61, 0x7B), *range(0xDF, 0x100))) if c.isalpha()]  # lower case, one sign each in composed form
CLOSING = ".,!?;:*&#)%"  # signs that often end a word


class Encoder:
    """Ids of texts, word by word: the tokenizer cuts at white space before it merges, so a word's ids never depend on its neighbours.

    Words are remembered as packed little-endian 32-bit ids, so that a text is one join of byte strings. When ``KEPT`` words
    are held they become the old generation: those met again come back, the others go with the next change. That bounds the memory and
    changes no result. ``whole=True`` encodes whole
    texts instead, for a tokenizer that merges across white space.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole, self.known, self.old = Tokenizer.from_file(path), whole, {}, {}
        mark = self.ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.model, self.forms = self.tokenizer.model, {} if whole else self.letter_forms()
        small, large = "".join(map(chr, self.forms)), "".join(c.upper() for c in map(chr, self.forms) if self.same_upper(c))
        # letters, their case and closing signs are told apart before merging
        apart = self.forms and all(self.ids(f"Then{c}{c}") == self.ids("then") + self.ids(c + c) for c in CLOSING)
        self.run = re.compile(f"[{small}]+") if self.forms else None
        self.halved = re.compile(f"([{small}{large}]+)([{re.escape(CLOSING)}]*)") if apart else None

    def letter_forms(self) -> dict[int, str]:
        """The letters of ``LETTERS`` whose runs the tokenizer merges whole and unchanged, with the form in which the merges name them;
        none if it cuts or changes such runs, or if a token of its own could lie in one."""
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normal is None or cut is None:
            return {}
        forms = {}
        for c in LETTERS:
            cuts = cut.pre_tokenize_str(c)
            if len(cuts) == 1 and normal.normalize_str(c) == c:
                forms[ord(c)] = cuts[0][0]
        text = "".join(map(chr, forms))
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        able = all(normal.normalize_str(t) == t and [x for x, _ in cut.pre_tokenize_str(t)] == [t.translate(forms)] for t in (text, text[::-1]))
        return forms if able and text and not any(t.rstrip(CLOSING).isalpha() or not t.strip(CLOSING) for t in own) else {}

    def same_upper(self, letter: str) -> bool:
        """Whether the tokenizer takes the upper case of a letter for the letter."""
        upper = letter.upper()
        return len(upper) == 1 and upper.lower() == letter == self.tokenizer.normalizer.normalize_str(upper)

    def ids(self, text: str) -> list[int]:
        # without the places of tokens in the text, which nobody asks for
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: set[str]) -> None:
        """Remembers words. Runs of letters go straight to the merges, others are encoded many in one call; a word that holds the mark is encoded alone."""
        if self.run:
            tokenize, forms = self.model.tokenize, self.forms
            runs = [w for w in words if self.run.fullmatch(w)]
            for word in runs:
                ids = [t.id for t in tokenize(word.translate(forms))]
                self.known[word] = pack(f"<{len(ids)}I", *ids)
            words = words.difference(runs)
        many = [w for w in words if w and MARK not in w] if self.mark is not None else []
        for i in range(0, len(many), 2000):
            some = many[i : i + 2000]
            ids = np.array(self.ids(f" {MARK} ".join(some)), "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(some) - 1:
                raw, at = ids.tobytes(), 0
                for word, cut in zip(some, [*cuts.tolist(), len(ids)]):
                    self.known[word] = raw[4 * at : 4 * cut]
                    at = cut + 1
        for word in words.difference(self.known):
            self.known[word] = np.array(self.ids(word), "<u4").tobytes()

    def rest(self) -> None:
        """Between tasks only the newer generation stays in memory."""
        self.old = {}

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text; a null text has none."""
        for a, b in pieces(texts):
            if self.whole:
                yield from (np.array(self.ids(t or ""), "<u4").tobytes() for t in texts[a:b])
                continue
            if len(self.known) > KEPT:
                self.known, self.old = {}, self.known
            split = [t.replace("\n", " ").split(" ") if t else [] for t in texts[a:b]]
            fresh = set().union(*split).difference(self.known)
            again = [w for w in fresh if w in self.old]
            self.known.update((w, self.old[w]) for w in again)
            fresh = fresh.difference(again)
            halves = {}
            if self.halved:
                for w, found in zip(fresh, map(self.halved.fullmatch, fresh)):
                    if found:
                        body, tail = found.groups()
                        if tail or not self.run.fullmatch(body):
                            halves[w] = (body.lower(), tail)
            needed = fresh.difference(halves).union(*halves.values()).difference(self.known)
            again = [w for w in needed if w in self.old]
            self.known.update((w, self.old[w]) for w in again)
            self.learn(needed.difference(again))
            for w, (body, tail) in halves.items():
                self.known[w] = self.known[body] + self.known[tail]
            get = self.known.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def encoder(path: str, whole: bool = False) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    store = worker_store("encoders")
    if (path, whole) not in store:
        store[path, whole] = Encoder(path, whole)
    return store[path, whole]
