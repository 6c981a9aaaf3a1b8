"""The registered queries and the pipeline on the smallest given tables and on planted rows."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_pipeline_keeps_the_clean(spark, tmp_path):
    import random

    import corpus_pipeline
    from airtrail.llm import secretscan

    rng = random.Random(1)
    words = ["stone", "river", "window", "seven", "quiet", "under", "people", "letter", "morning", "answer", "field", "and", "of", "the", "winter"]

    def text(n=120):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ly"]) for _ in range(n)) + "."

    clean = [(i, text()) for i in range(60)]
    junk = [(100 + i, "WIN MONEY!! " * rng.randrange(20, 60)) for i in range(30)]
    copy = [(200, clean[5][1]), (201, clean[6][1] + " end")]
    item = text(20)
    leak = [(300, text(60) + " " + item + " " + text(60))]
    key = "9f" * 20
    secret = [(400, text(60) + f' token = "{key}" ' + text(40))]
    rows = [(d, t, "en", "s", len(t)) for d, t in clean + junk + copy + leak + secret]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, int(d < 60)) for d, *_ in rows if d < 200], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r.doc_id for r in docs.collect()})
    good = set(range(60))
    assert left == [good | {200, 201, 300, 400}, good | {300, 400}, good | {400}, good | {400}]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert key not in texts[400] and secretscan.MASK in texts[400]
    assert all(texts[d] == t for d, t in clean)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == good | {400}


def test_rows_of_null_and_repeated_ids(spark, tmp_path):
    """Copies and passages of rows without an id go; a clean row stays where another one of its id goes."""
    import corpus_pipeline

    def text(seed):
        return " ".join(f"{w}{seed}" for w in "a b c d e f g h i j k l m n o p q r s t u v w x y z".split())

    item = text("item")
    rows = [(None, text(1)), (None, text(1)), (2, text(2)), (2, text(2)), (None, text(2)), (3, text(3)), (3, "x " + item), (None, "y " + item), (4, None), (None, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def left(df):
        assert df.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    lone = [(2, text(2)), (3, text(3)), (4, None), (None, "")]
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert left(near) == sorted([*lone, (None, ""), (None, text(1)), (3, "x " + item)], key=str)
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert left(clean) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
@pytest.mark.parametrize("name", ["op7_decontamination", "op8_substring_dedup", "op9_near_duplicates"])
def test_sql(spark, name):
    import duckdb

    from airtrail.llm import checks

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = checks.QUERIES[name](spark, FOLDER)
    cursor = con.execute(checks.ORACLE[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*at).collect())) == sorted(cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no given tables")
def test_held_out_accuracy(spark):
    from airtrail.llm import checks

    docs, labels = (spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    lang = checks.op2_language_id(spark, FOLDER.replace("0.001", "0.01")).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in lang) >= 0.97 * len(lang)
    rated = checks.op6_quality_classifier(spark, FOLDER.replace("0.001", "0.01")).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    assert sum(r.quality == r.predicted for r in rated) >= 0.95 * len(rated)


def test_empty_documents(spark, tmp_path):
    """No document: every query and the pipeline give no row."""
    import corpus_pipeline
    from airtrail.llm import checks

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    for name, query in checks.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
