"""Tokens of words travel back to their blocks packed, a row a block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from airtrail.llm import bytebpe


def test_tokens_return_packed_by_block(monkeypatch):
    monkeypatch.setattr(bytebpe, "HELD", 5000)
    rng = np.random.default_rng(3)
    n, blocks = 24_000, [0, 7, 1 << 33]
    block = rng.choice(blocks, n)
    code = np.empty(n, np.int64)
    for b in blocks:
        code[block == b] = rng.permutation(int((block == b).sum()))
    ids = [rng.choice([0, 5, 900, 0xD7FF, 0xD800, 49_999], size) for size in rng.integers(1, 5, n)]
    table = pa.table({"block": block, "code": pa.array(code, pa.int32()), "signs": ["".join(map(bytebpe.sign, x.tolist())) for x in ids]})
    found = pa.Table.from_batches(list(bytebpe.tokens_of_blocks(iter(table.to_batches(2000))))).to_pylist()
    assert len(found) <= len(blocks) * (n // 5000 + 1)
    assert sum(len(r["codes"]) + len(r["lengths"]) + len(r["flat"]) for r in found) < table.nbytes
    got = {}
    for r in found:
        flat, at = bytebpe.unpacked(r["flat"], r["tokens"]).tolist(), 0
        for c, size in zip(np.cumsum(bytebpe.unpacked(r["codes"], r["words"])).tolist(), bytebpe.unpacked(r["lengths"], r["words"]).tolist()):
            got[r["of"], c] = flat[at : at + size]
            at += size
        assert at == len(flat)
    assert got == {(int(b), int(c)): x.tolist() for b, c, x in zip(block, code, ids)}


def test_no_rows_no_blocks():
    assert list(bytebpe.tokens_of_blocks(iter([]))) == []
