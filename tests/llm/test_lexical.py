"""Ranked lexical search against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from airtrail.llm import lexical

WORD = re.compile(lexical.TERM)


def terms(text) -> list:
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs: list, items: list, k: int = 10) -> list:
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, query in asked.items():
        scores = []
        for doc_id, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if c[t])
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("block,part", [(100, 2), (3000, 3), (10**7, 500)])
def test_equals_plain_ranking(spark, block, part):
    rng = random.Random(3)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["Ärger", "été", "日本", "x1y", "THE", "the"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(150)]
    docs += [(7, None), (8, ""), (9, "!!! ..."), (20, docs[20][1]), (20, docs[20][1]), (None, docs[3][1]), (901, docs[3][1]), (900, docs[3][1]), (902, text(4000))]
    items = [(f"i{i}", text(rng.choice([1, 3, 30, 60]))) for i in range(12)] + [("none", None), ("odd", "zzz qqq"), ("i1", "the Ärger"), (None, docs[3][1]), ("all", " ".join(vocabulary))]
    rng.shuffle(docs)
    given = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id string, text string, rank int")
    found = [tuple(r) for r in lexical.search(given, asked, block=block, part=part).collect()]
    assert sorted(found, key=lambda r: (str(r[0]), r[1])) == plain(docs, items)


def test_accumulators_stop_and_stay_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = 300
        rows = [np.sort(rng.choice(n, size, replace=False)) for size in (3, 12, 20, 60, 150, 290)]
        gains = [rng.integers(1, top, len(r)) for r, top in zip(rows, (900, 500, 300, 90, 20, 5))]
        full = np.zeros(n, np.int64)
        for r, g in zip(rows, gains):
            full[r] += g
        found, sums = lexical.best(rows, gains, n, 10)
        assert (full[found] == sums).all() and len(found) < n
        assert sorted(sums)[-10:] == sorted(full)[-10:]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "two")], "item_id string, text string")
    assert lexical.search(docs.limit(0), asked).collect() == []
    assert lexical.search(docs, asked.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs, asked).collect()] == plain([(1, "one two")], [("a", "two")])
