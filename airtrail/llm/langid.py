"""Language of documents by a linear-chain conditional random field over their words."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces, smallest_by_hash, worker_store

# number signs (fractions, roman and circled numbers) are word signs to the pattern language, but no letters
SIGNS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal() and not c.isalpha())
WORD = re.compile(rf"[^\W\d_{SIGNS}]+")
RUN = re.compile(r"[^\W\d_]+")  # words that number signs may still join
BUCKETS = 1 << 18
GRAMS = (1, 2, 3, 4, 5)
STEPS = 256  # words walked one after another; stretches of so many words are walked side by side
KEPT = 250_000  # words whose scores a worker remembers


def words_of(text: str) -> list[str]:
    """All matches of ``WORD`` in order. That pattern walks through its hundreds of signs for every letter, so it is tried only on
    the runs that hold another sign than letters."""
    found = RUN.findall(text)
    if "".join(found).isalpha() or not found:
        return found
    return [word for run in found for word in ([run] if run.isalpha() else WORD.findall(run))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, as (word number, bucket): byte n-grams with the word's edges marked, so that n-grams at an edge
    are prefixes and suffixes, and the whole word as the lexicon entry."""
    raw = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03" for w in words]
    buffer = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raw])
    owner = np.repeat(np.arange(len(raw)), sizes)
    up = np.uint64(0x100000001B3)
    at, bucket, value = [], [], np.zeros(len(buffer), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(buffer) < n:
            break
        value = value[: len(buffer) - n + 1] * up + buffer[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            inside = owner[: len(buffer) - n + 1] == owner[n - 1 :]
            at.append(owner[: len(buffer) - n + 1][inside])
            bucket.append(mix(value[inside] + np.uint64(n << 56)))
    place = np.arange(len(buffer)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.add.reduceat(mix(buffer + (place.astype(np.uint64) << np.uint64(9))), np.cumsum(sizes) - sizes)
    at.append(np.arange(len(raw)))
    bucket.append(mix(whole))
    return np.concatenate(at), (np.concatenate(bucket) % np.uint64(BUCKETS)).astype(np.int64)


def chain(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Label probabilities of every word by forward-backward: ``scores (words, labels)``, log ``moves (labels, labels)``,
    ``first`` marks the words that begin a text. With ``pairs`` also the expected number of each move.

    The words of many texts stand in one row. It is cut into stretches; their transfer matrices are combined from the front
    and from the back, then all stretches are walked side by side.
    """
    n, k = scores.shape
    width = max(1, -(-n // STEPS))
    pad = STEPS * width - n
    e = np.exp(scores - scores.max(1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, k))]).reshape(width, STEPS, k)
    head = np.concatenate([first, np.ones(pad, bool)]).reshape(width, STEPS)
    go = np.exp(moves)

    transfer = np.broadcast_to(np.eye(k), (width, k, k)).copy()
    for t in range(STEPS):
        new = np.where(head[:, t, None, None], transfer.sum(2, keepdims=True), transfer @ go) * e[:, t, None, :]
        transfer = new / new.sum((1, 2), keepdims=True)
    enter, leave = np.empty((width, k)), np.empty((width, k))
    a, b = np.full(k, 1 / k), np.ones(k)
    for c in range(width):
        enter[c] = a
        a = a @ transfer[c]
        a /= a.sum()
    for c in range(width - 1, -1, -1):
        leave[c] = b
        b = transfer[c] @ b
        b /= b.sum()

    ahead, back = np.empty((STEPS, width, k)), np.empty((STEPS, width, k))
    a, b = enter, leave
    for t in range(STEPS):
        a = np.where(head[:, t, None], a.sum(1, keepdims=True), a @ go) * e[:, t]
        a = a / a.sum(1, keepdims=True)
        ahead[t] = a
    for t in range(STEPS - 1, -1, -1):
        back[t] = b
        seen = e[:, t] * b
        b = np.where(head[:, t, None], seen.sum(1, keepdims=True), seen @ go.T)
        b = b / b.sum(1, keepdims=True)
    each = ahead * back
    each /= each.sum(2, keepdims=True)
    each = each.transpose(1, 0, 2).reshape(-1, k)[:n]
    if not pairs:
        return each
    ahead = ahead.transpose(1, 0, 2).reshape(-1, k)[:n]
    seen = (e * back.transpose(1, 0, 2)).reshape(-1, k)[:n]
    both = ahead[:-1, :, None] * go[None] * seen[1:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    return each, both[~first[1:]].sum(0)


@dataclass
class Model:
    """Learned languages in order, weights of hashed features (bucket, language), log moves between languages."""

    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Feature scores of single words."""
        at, bucket = features(words)
        return np.stack([np.bincount(at, self.weights[bucket, j], len(words)) for j in range(len(self.languages))], 1)


def sample(docs: DataFrame, per_language: int = 250) -> DataFrame:
    """Labelled texts to learn from, ``text, lang``: at most ``per_language`` whole documents a language, chosen by a hash of the id.

    The choice looks at ids and languages only, is cut before the shuffle, and names so few documents that their texts are
    found by a broadcast of ids.
    """
    chosen = smallest_by_hash(docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang"), ["lang"], per_language, "doc_id")
    return docs.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")


def fit(labelled: DataFrame, rounds: int = 25, rate: float = 0.4, decay: float = 1e-4, stretch: int = 24, seed: int = 7, most: int = 20_000) -> Model:
    """Learns from at most ``most`` rows ``text, lang`` (use ``sample``), by gradient steps on the label likelihood.

    Texts are cut into runs of about ``stretch`` words and the runs of all languages are mixed, so that moves between
    languages are seen and learned. Without any row the model knows no language.
    """
    rows = sorted((r["lang"], r["text"]) for r in labelled.limit(most).collect())
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    if not k:
        return Model([], np.zeros((1, 0), np.float32), np.zeros((0, 0)))
    index: dict[str, int] = {}
    parts = []
    rng = np.random.default_rng(seed)
    for lang, text in rows:
        ids = np.array([index.setdefault(w, len(index)) for w in words_of(text.lower())], np.int64)
        at = 0
        while at < len(ids):
            size = 1 + rng.geometric(1 / stretch)
            parts.append((languages.index(lang), ids[at : at + size]))
            at += size
    if not parts:
        return Model(languages, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)))
    parts = [parts[i] for i in rng.permutation(len(parts))]
    word = np.concatenate([p for _, p in parts])
    label = np.repeat([lang for lang, _ in parts], [len(p) for _, p in parts])
    first = np.zeros(len(word), bool)
    first[0] = True
    at, bucket = features(list(index))
    weights, moves = np.zeros((BUCKETS, k)), np.zeros((k, k))
    grown, grown_moves = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    right = np.zeros((len(word), k))
    right[np.arange(len(word)), label] = 1
    seen = np.zeros((k, k))
    np.add.at(seen, (label[:-1], label[1:]), 1)
    for _ in range(rounds):
        score = np.stack([np.bincount(at, weights[bucket, j], len(index)) for j in range(k)], 1)
        each, both = chain(score[word], moves, first, pairs=True)
        wrong = right - each
        by_word = np.stack([np.bincount(word, wrong[:, j], len(index)) for j in range(k)], 1)
        step = np.stack([np.bincount(bucket, by_word[at, j], BUCKETS) for j in range(k)], 1) / len(word) - decay * weights / BUCKETS
        grown += step**2
        weights += rate * step / np.sqrt(grown)
        step = (seen - both) / len(word)
        grown_moves += step**2
        moves += rate * step / np.sqrt(grown_moves)
    return Model(languages, weights.astype(np.float32), moves)


def identify(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score`` and with ``runs`` the languages met on the way,
    ``runs array<struct<lang, words>>``.

    A text's language has the largest sum of word probabilities (ties: first in order), ``score`` is their mean. A text that is
    null or without a letter, or any text when no language was learned, gives ``und`` with score 0. Repeated rows stay; other
    columns are not read.
    """
    kinds = [pa.int64(), pa.string(), pa.float64()]
    names = ["doc_id", "lang_pred", "score"]
    out = "doc_id long, lang_pred string, score double"
    if runs:
        kinds.append(pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())])))
        names.append("runs")
        out += ", runs array<struct<lang:string,words:int>>"
    known = model.languages
    key = hash((tuple(known), model.weights.tobytes(), model.moves.tobytes()))

    def rows(ids, texts):
        store = worker_store("language scores")
        if store.get("model") != key or len(store["index"]) > KEPT:
            store.update(model=key, index={}, table=np.zeros((0, len(known))))
        index = store["index"]
        split = [words_of(t.lower()) if t else [] for t in texts]
        fresh = list({w for words in split for w in words}.difference(index))
        if fresh:
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            store["table"] = np.concatenate([store["table"], model.scores(fresh)])
        sizes = np.array([len(words) for words in split])
        get = index.__getitem__
        word = np.fromiter((x for words in split for x in map(get, words)), np.int64, int(sizes.sum()))
        filled = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[filled]
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        each = np.zeros((0, len(known)))
        if len(word):
            first = np.zeros(len(word), bool)
            first[begin] = True
            each = chain(store["table"][word], model.moves, first)
            mean = np.add.reduceat(each, begin, axis=0) / sizes[filled, None]
            for i, j, s in zip(filled.tolist(), mean.argmax(1).tolist(), mean.max(1).tolist()):
                pred[i] = known[j]
                score[i] = min(1.0, s)
        columns = [ids, pred, score]
        if runs:
            best, at, all_runs = each.argmax(1), 0, []
            for n in sizes.tolist():
                mine = best[at : at + n]
                cuts = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), n] if n else []
                all_runs.append([{"lang": known[mine[a]], "words": b - a} for a, b in zip(cuts, cuts[1:])])
                at += n
            columns.append(all_runs)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not known:
                texts = [None] * len(texts)
            for a, b in pieces(texts):
                yield rows(ids[a:b], texts[a:b])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, out)
