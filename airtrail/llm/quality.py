"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import lean, pieces, smallest_by_hash

NAMES = (
    "log_words", "word_length", "upper", "digit", "white", "other_sign", "stop", "comma", "exclaim", "bar", "quote",
    "distinct_words", "top_word", "same_neighbour", "distinct_lines", "line_words", "long_words", "sign_words", "pairs_again", "empty",
)
PLAIN = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyz")


def measure(text: str | None) -> list[float]:
    """Numbers that describe a whole text, in the order of ``NAMES``; a null text is measured as an empty one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(NAMES) - 1) + [1.0]
    size = len(text)
    rest = text.translate(PLAIN)  # all but the small ASCII letters
    signs = Counter(rest)
    upper = sum(v for c, v in signs.items() if c.isupper())
    digit = sum(v for c, v in signs.items() if c.isdigit())
    white = sum(v for c, v in signs.items() if c.isspace())
    letters = sum(v for c, v in signs.items() if c.isalpha()) - upper
    common = {c: signs.get(c, 0) for c in ".,!|\"'"}
    other = sum(signs.values()) - upper - digit - white - letters - sum(common.values())
    counts = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:])))
    lines = text.split("\n")
    lengths = list(map(len, words))
    tail = sum(not w[-1].isalnum() for w in words)
    return [
        np.log1p(n), sum(lengths) / n, upper / size, digit / size, white / size, other / size, common["."] / n, common[","] / n,
        common["!"] / n, common["|"] / n, (common['"'] + common["'"]) / n, len(counts) / n, max(counts.values()) / n,
        same / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x > 14 for x in lengths) / n, tail / n,
        1 - pairs / max(1, n - 1) if n > 1 else 0.0, 0.0,
    ]


def widen(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standard values of the measures, clipped, with their squares."""
    z = np.clip((x - middle) / scale, -6, 6)
    return np.concatenate([z, z * z / 6], 1)


@dataclass
class Model:
    """Centre and scale of the measures, weights, and the score at the quantile that parts bad from good."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, measured: np.ndarray) -> np.ndarray:
        """0 to 1: the chance that the text is preferred to one that stands at the threshold."""
        raw = widen(measured, self.middle, self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, per_label: int | None = None) -> DataFrame:
    """Rows to learn from, ``doc_id, quality, measures``: all labelled documents, or with ``per_label`` at most so many of each label, chosen by a hash of the id.

    Labels other than 0 and 1, null ids and ids with both labels are left out. Whole texts are measured where they lie and only their
    measures meet the labels; ``docs`` with ``measures`` are taken as they are.
    """
    clean = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    chosen = clean.filter("quality = _most").select("doc_id", "quality")
    if per_label is not None:
        chosen = smallest_by_hash(chosen, ["quality"], per_label, "doc_id")
    known = docs.filter("doc_id IS NOT NULL")
    return (known if "measures" in docs.columns else measured(known, "doc_id")).select("doc_id", "measures").join(chosen, "doc_id").select("doc_id", "quality", "measures")


def shares(labels: DataFrame) -> float:
    """Share of label 0 among all labelled documents."""
    row = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").agg(F.avg((F.col("quality") == 0).cast("double")).alias("bad")).first()
    return 0.5 if row["bad"] is None else row["bad"]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and the measures of ``text`` as an array."""
    fields = docs.select(*keep).schema

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts, 8_000_000):
                values = pa.array([measure(t) for t in texts[a:b]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in keep), values], names=[*keep, "measures"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, "text").mapInArrow(lean(run), f"{shape}, measures array<double>")


def pairs_of(rows: DataFrame, middle: np.ndarray, scale: np.ndarray, good: int, bad: int, least: int) -> DataFrame:
    """Preference pairs ``apart, label``: differences of measures, label 1 less label 0, every other one turned round with label 0.

    Rows are dealt into buckets by a hash of their id (or number), about 500 of the rarer label each; there each row of the commoner label meets the rarer ones in turn,
    so every row is in a pair. A second turn and more follow while there are fewer than ``least`` pairs in all.
    """
    buckets = max(1, min(good, bad) // 500)
    turns = -(-least // max(good, bad))

    def pair(table: pa.Table) -> pa.Table:
        x = widen(np.array(table.column("measures").to_pylist()).reshape(-1, len(NAMES)), middle, scale)
        y = table.column("quality").to_numpy()
        order = np.lexsort([*x.T, y])
        x, y = x[order], y[order]
        up, down = x[y == 1], x[y == 0]
        few, many = min(len(up), len(down)), max(len(up), len(down))
        if not few:
            return pa.table({"apart": pa.array([], pa.list_(pa.float64())), "label": pa.array([], pa.float64())})
        at = np.arange(many * min(turns, few))
        # the longer side in order, the shorter one moved on by one each turn
        long, short = at % many, (at + at // many) % few
        apart = up[long] - down[short] if len(up) == many else up[short] - down[long]
        sign = np.where(at % 2 == 0, 1.0, -1.0)
        return pa.table({"apart": pa.array(list(apart * sign[:, None]), pa.list_(pa.float64())), "label": (sign + 1) / 2})

    number = F.col("doc_id") if "doc_id" in rows.columns else F.monotonically_increasing_id()
    dealt = rows.select("quality", "measures", F.pmod(F.xxhash64(number), F.lit(buckets)).alias("_bucket"))
    return dealt.groupBy("_bucket").applyInArrow(pair, "apart array<double>, label double")


def quantile(scores: DataFrame, share: float, good: int, bad: int, bins: int = 4096, rounds: int = 4) -> float:
    """The score below which the share ``share`` lies when each label weighs as it does among all labels; rows are counted in ever finer bins."""
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi, before, target = ends["lo"], ends["hi"], 0.0, share * (1 + 1e-9)
    for _ in range(rounds):
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            break
        place = F.least(F.floor((F.col("score") - lo) / step), F.lit(bins - 1)).alias("bin")
        counted = scores.filter((F.col("score") >= lo) & (F.col("score") <= hi)).groupBy(place).agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect()
        cells = sorted((r["bin"], r["good"] * (1 - share) / good + (r["n"] - r["good"]) * share / bad) for r in counted)
        for cell, weight in cells:
            if before + weight >= target or cell == cells[-1][0]:
                break
            before += weight
        lo, hi = lo + cell * step, lo + (cell + 1) * step
    edges = scores.agg(F.max(F.when(F.col("score") < lo, F.col("score"))).alias("low"), F.min(F.when(F.col("score") >= lo, F.col("score"))).alias("high")).first()
    low, high = (edges[0] if edges[0] is not None else edges[1]), (edges[1] if edges[1] is not None else edges[0])
    return float((low + high) / 2)


def fit(labelled: DataFrame, bad_share: float, pairs: int = 40_000, rounds: int = 100, decay: float = 1e-3) -> Model:
    """Learns from all rows ``quality, measures`` (use ``sample``; rows with ``text`` are measured).

    Every row is in a preference pair (label 1 over label 0; at least ``pairs`` of them, if there are so many); the weights minimise the
    logistic loss on differences of measures. The threshold is the quantile of the scores below which the share ``bad_share`` lies, each label weighing as
    it does among all labels. With one label or none there is no pair and every text scores 0.5.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = settle(labelled if "measures" in labelled.columns else measured(labelled, "quality"), "measured")
    one = F.col("measures")
    sums = [f(one[i]).alias(f"{name}{i}") for i in range(len(NAMES)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    facts = rows.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), *sums).first()
    good, bad = facts["good"], facts["bad"]
    if not good or not bad:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0)
    middle = np.array([facts[f"m{i}"] for i in range(len(NAMES))])
    scale = np.maximum([facts[f"s{i}"] for i in range(len(NAMES))], 1e-6)
    apart = settle(pairs_of(rows, middle, scale, good, bad, pairs), "pairs").select(array_to_vector("apart").alias("features"), "label")
    learner = LogisticRegression(maxIter=rounds, regParam=decay, fitIntercept=False, standardization=False)
    model = Model(middle, scale, learner.fit(apart).coefficients.toArray(), 0.0)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column("measures").to_pylist()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(widen(x, model.middle, model.scale) @ model.weights)], names=["quality", "score"])

    kind = rows.schema["quality"].dataType.simpleString()
    model.threshold = quantile(settle(rows.mapInArrow(lean(score), f"quality {kind}, score double"), "scores"), bad_share, good, bad)
    return model


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text (predicted 1 from a score of 0.5); null and empty texts are scored too.

    Repeated rows stay; other columns are not read. ``docs`` with ``measures`` are scored by them.
    """
    kinds = [pa.int64(), pa.float64(), pa.int32()]
    source = "measures" if "measures" in docs.columns else "text"

    def run(batches):
        for batch in batches:
            ids, values = batch.column("doc_id").to_pylist(), batch.column(source).to_pylist()
            for a, b in [(0, len(values))] if source == "measures" else pieces(values, 8_000_000):
                some = values[a:b] if source == "measures" else [measure(t) for t in values[a:b]]
                score = model.scores(np.array(some).reshape(-1, len(NAMES)))
                columns = [ids[a:b], score, (score >= 0.5).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), source).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def select_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all their columns unchanged."""
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [model.scores(np.array([measure(t) for t in texts[a:b]])) >= 0.5 for a, b in pieces(texts, 8_000_000)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
