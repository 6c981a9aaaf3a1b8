"""Workers give back what operators leave behind."""

from __future__ import annotations

from airtrail.llm import common


def test_worker_drops_what_other_operators_remember():
    for name in ("test words", "test powers"):
        common.worker_store(name)["held"] = [0] * 1000
    seen = []

    def run(batches):
        for batch in batches:
            seen.append([bool(common.worker_store(name)) for name in ("test words", "test powers")])
            yield 2 * batch

    assert list(common.lean(run, "test powers")(iter([1, 2, 3]))) == [2, 4, 6]
    assert seen == [[False, True]] * 3
    common.give_back()
    assert not common.worker_store("test powers")


def test_near_duplicates_start_without_words_of_packing(spark):
    from pyspark.sql import functions as F

    from airtrail.llm import minhash, packing

    P = __import__("public_tokenizers")
    docs = spark.range(20, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"))
    packing.cut(docs, P.path("word_bpe_49k.json")).count()
    minhash.sketch(docs).count()

    def held(batches):
        import sys

        import pyarrow as pa

        box = sys.modules.get("_llm_worker_store")
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"words": [bool(box and getattr(box, "encoders", None)) and bool(getattr(box, "powers", None))]})

    assert not any(r.words for r in docs.select("doc_id").mapInArrow(held, "words boolean").collect())
