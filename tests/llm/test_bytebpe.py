"""Byte-level BPE against the tiktoken library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airtrail.llm import bytebpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.ranks(PATH), special_tokens={})


def texts() -> list:
    rng = random.Random(5)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    return [None, "", " ", "a" * 1000, "ab" * 700 + " x", "I'll  go\n\n  home\t'S don't　  x\xa0\xa0y", some("abc ", 3000), some("etaoinshr", 2000),
            some("日本語的是がﾊ", 600), some("01", 1500), "".join(map(chr, range(0x800))) + "ࡰࢎ\U0001e030 \U00016d40½²Ⅷ\x85 \x85x", "\0\0 \0x", "= " * 50 + "=" * 777,
            "".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(1500))]


@pytest.mark.parametrize("block", [50, 10**6])
def test_equals_the_library(spark, library, block):
    given = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(given)], "doc_id long, text string, ids string").repartition(2)
    codec = bytebpe.Codec(PATH)
    rows = bytebpe.decode(bytebpe.encode(docs, codec, P.PATTERN, block), codec).withColumn("numbers", F.when(F.octet_length("ids") < 4000, bytebpe.ids(F.col("ids")))).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(given)))
    for row in rows:
        text = given[row.doc_id] or ""
        want = library.encode_ordinary(text)
        assert bytes(row.ids) == np.array(want, "<u4").tobytes() and bytes(row.bytes) == text.encode(), text[:40]
        assert row.numbers is None or row.numbers == want


def test_given_documents(spark, library):
    import hashlib

    from airtrail.llm.checks import op11_byte_bpe

    folder = "/root/testdata/sf0.001"
    want = {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(row.text or "")
        want[row.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((row.text or "").encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in op11_byte_bpe(spark, folder).collect()} == want


def test_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "same words"), (1, "same words"), (None, None)], "doc_id long, text string")
    codec = bytebpe.Codec(PATH)
    found = [(r.doc_id, bytes(r.ids)) for r in bytebpe.encode(rows, codec, P.PATTERN).collect()]
    assert len(found) == 3 and len(set(found)) == 2 and (None, b"") in found
    assert bytebpe.encode(rows.limit(0), codec, P.PATTERN).count() == 0


def test_signs_keep_the_order_of_ids():
    signs = [bytebpe.sign(i) for i in range(0xD7F0, 0xD810)]
    assert signs == sorted(signs) and all(s.encode() for s in signs)
