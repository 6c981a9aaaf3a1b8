"""Benchmark passages in training documents by a positional inverted index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import ascii_lower

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST = 32 << 20  # bytes of test terms that may be sent to every task


def words(text: Column) -> Column:
    """ASCII letters in small form, ASCII digits and all other signs beyond ASCII make words; a null text has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def store(docs: DataFrame) -> DataFrame:
    """Token positions of all rows, written once: ``row, doc_id, n_words, words``. ``row`` tells rows of one doc_id apart."""
    made = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    return settle(made.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"), "tokens")


def windows(benchmark: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Different windows ``window, terms`` of the items, and which item has which: ``item_id, window``.

    An item of fewer words is one window, an item without words or id has none.
    """
    items = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter("size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))).alias("at")
    each = settle(items.select("item_id", "words", at).select("item_id", F.slice("words", F.col("at"), size).alias("terms")).distinct(), "items")
    named = settle(each.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "windows")
    return named, each.join(named, "terms").select("item_id", "window")


def small(terms: DataFrame) -> DataFrame:
    """Marked for broadcast if its measured size allows; a larger one is joined by a shuffle."""
    size = terms.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0
    return F.broadcast(terms) if size <= MOST else terms


def rarest(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """``window, terms, term, place``: for each window its term with the fewest occurrences in the tokens and where it stands.

    Windows with a term that never occurs are left out: they cannot occur.
    """
    placed = wanted.select("window", F.posexplode("terms").alias("place", "term"))
    terms = settle(placed.select("term").distinct(), "terms")
    counts = tokens.select(F.explode("words").alias("term")).join(small(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    least = placed.join(counts, "term", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "term")).alias("least"))
    return wanted.join(least.filter("least.n > 0"), "window").select("window", "terms", "least.term", "least.place")


def postings(tokens: DataFrame, anchors: DataFrame, around: int) -> DataFrame:
    """Index rows of the anchor terms: ``term, row, pos, begin, context``; the context are the words ``around`` the position,
    ``begin`` is the place of its first one."""
    terms = settle(anchors.select("term").distinct(), "terms")
    listed = tokens.select("row", "words", F.posexplode("words").alias("pos", "term")).join(small(terms), "term")
    begin = F.greatest(F.col("pos") - around, F.lit(0))
    return listed.select("term", "row", "pos", begin.alias("begin"), F.slice("words", begin + 1, 2 * around + 1).alias("context"))


def matches(tokens: DataFrame, wanted: DataFrame, size: int, slop: int = 0) -> DataFrame:
    """Occurrences ``row, window, start, length`` of windows.

    The list of each window's rarest term is shifted by the term's place; there the other terms' positions must follow it. With
    ``slop`` instead all terms must stand, in any order, within ``slop`` words more than the window has: proximity matches,
    one for each position where such a stretch starts around the anchor.
    """
    anchors = settle(rarest(tokens, wanted), "anchors")
    listed = settle(postings(tokens, anchors, size + slop), "postings").join(anchors, "term")
    length = F.size("terms")
    if not slop:
        start = F.col("pos") - F.col("place")
        same = F.slice("context", start - F.col("begin") + 1, length) == F.col("terms")
        return listed.filter(start >= F.col("begin")).filter(same).select("row", "window", start.cast("long").alias("start"), length.cast("long").alias("length"))
    # starts of stretches of length + slop words that hold the anchor
    first = F.greatest(F.col("pos") - length - slop + 1, F.lit(0))
    wide = listed.select("row", "window", "terms", "begin", "context", F.explode(F.sequence(first, F.col("pos"))).alias("start"))
    stretch = F.slice("context", F.col("start") - F.col("begin") + 1, F.size("terms") + slop)
    found = wide.filter(F.size(F.array_except("terms", stretch)) == 0)
    return found.select("row", "window", F.col("start").cast("long").alias("start"), (F.size("terms") + slop).cast("long").alias("length")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` of every row of ``docs (doc_id, text)``.

    ``n_hit`` counts words inside an occurrence of a window of ``size`` consecutive words of a benchmark item, ``items`` lists
    as sorted text the items whose windows occur. A null text has no words. Repeated rows are counted each; a null doc_id
    stays. Other columns are not read. An empty benchmark finds nothing.
    """
    tokens = store(docs)
    wanted, of_item = windows(benchmark, size)
    found = settle(matches(tokens, wanted, size), "matches")
    spots = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    hit = found.groupBy("row").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select("row", F.size(F.array_distinct(F.flatten(spots))).cast("long").alias("n_hit"))
    items = found.select("row", "window").distinct().join(of_item, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = tokens.select("row", "doc_id", "n_words").join(hit, "row", "left").join(items, "row", "left")
    count = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", count.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), (count > 0).alias("contaminated"))


def proximity(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """``doc_id, item_id, start, length``: stretches of ``size + slop`` words that hold all words of a window of an item in any order."""
    tokens = store(docs)
    wanted, of_item = windows(benchmark, size)
    found = matches(tokens, wanted, size, slop).join(of_item, "window")
    return found.join(tokens.select("row", "doc_id"), "row").select("doc_id", "item_id", "start", "length").distinct()
