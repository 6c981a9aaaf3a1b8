"""Documents to packed training sequences: quality, near-duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airtrail.llm import decontaminate, minhash, packing, quality, secretscan
from airtrail.llm.checks import SIZE, tokenizer_path
from airtrail.llm.common import fold, read
from airtrail.session import configure, settle, settle_apart


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels of the training folds."""
    configure(spark)
    learn = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 3) != 1)
    return quality.select_good(docs, quality.fit(quality.sample(docs, learn), quality.shares(learn)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    configure(spark)
    rows, key = keyed(docs)

    def later() -> DataFrame:
        found = minhash.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).filter("n_shingles > 0")
        placed = settle(found.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, "doc_id"), key), "placed")
        # a null id comes last
        first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("_least"))
        return placed.join(first, "component_id").filter(F.col(key) != F.col("_least")[key]).select(key)

    return without(rows, settle_apart(spark, "copies", later), key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    configure(spark)
    rows, key = keyed(docs)

    def leaks() -> DataFrame:
        found = decontaminate.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
        return found.filter("contaminated").select(F.col("doc_id").alias(key))

    return without(rows, settle_apart(spark, "leaks", leaks), key)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts put out."""
    configure(spark)
    secrets = settle_apart(spark, "secrets", lambda: secretscan.secrets(docs, secretscan.fit(secretscan.findings(docs))))
    return secretscan.put_out(docs, secrets)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    configure(spark)
    return packing.digests(docs, tokenizer_path(), SIZE)


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a key column of their own and its name, as a doc_id may be null or stand in several rows; no column of ``docs`` is hidden by it.

    Rows read from files (a stage's input) get the same numbers each time they are read and are not written again; any others are.
    """
    key = "_row"
    while key in docs.columns:
        key = f"_{key}"
    rows = docs.withColumn(key, F.monotonically_increasing_id())
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    steps = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines()}
    return (rows if steps <= {"Relation", "Project", "Filter", ""} else settle(rows, "rows")), key


def without(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the found ones, without the key."""
    return rows.join(found.select(key), key, "left_anti").drop(key)


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # learned scores and tokenizers are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder; what each one keeps is written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
