"""Time lookups that never build the pairs of a key.

``first_within``: the best event no further than a tolerance from a point, for any order of preference.
``first_cover``: the earliest-started span that covers a point, exactly or within a tolerance.
``last_cover``: the latest-started span that covers a point.
``last_around``: the latest-started span that covers two points.
They cost one shuffle of the points and one sort; a key is cut into time blocks, so a hot key is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import with_running


def first_within(points: DataFrame, events: DataFrame, keys: list[str], t: str, at: str, order: list[str],
                 payload: list[str], below: int, above: int, into: str = "hit") -> DataFrame:
    """Left lookup: struct ``into`` holds order and payload of the smallest event (by ``order``) with
    ``t - below <= at <= t + above`` under equal keys; null when there is none.

    Time is a whole number. With blocks as wide as the whole range, a range covers the end of one block and the
    beginning of the next: the minimum is the smaller of a backward running minimum over the first block and a
    forward running minimum over the second. Every event is sent to its own block and to the one before.
    """
    width = below + above + 1
    pkeys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    best = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload if c not in order])
    pcols = F.struct(*points.columns)
    low = F.col(t) - below
    rows = points.select(
        *pkeys, F.floor(low / width).alias("_b"), low.alias("_x"), F.lit(None).cast("boolean").alias("_own"),
        pcols.alias("_p"),
    )
    own = F.floor(F.col(at) / width)
    marks = events.where(F.col(at).isNotNull()).select(*pkeys, F.col(at).alias("_x"), best.alias("_e"), own.alias("_own_b"))
    for k in range(len(keys)):
        marks = marks.where(F.col(f"_k{k}").isNotNull())
    marks = marks.select(
        "*", F.explode(F.array(F.struct(F.lit(0).alias("d"), F.lit(True).alias("own")),
                               F.struct(F.lit(1).alias("d"), F.lit(False).alias("own")))).alias("_s")
    ).select(*[f"_k{i}" for i in range(len(keys))], (F.col("_own_b") - F.col("_s.d")).alias("_b"), "_x",
             F.col("_s.own").alias("_own"), "_e")
    both = rows.unionByName(marks, allowMissingColumns=True)
    part = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_b")
    is_point = F.col("_p").isNotNull()
    # own block, backwards: events at or after the range start come before the point
    back = part.orderBy(F.desc("_x"), is_point.asc()).rowsBetween(Window.unboundedPreceding, 0)
    # next block, forwards: the point sits at the range end
    end = F.when(is_point, F.col("_x") + (width - 1)).otherwise(F.col("_x"))
    ahead = part.orderBy(end.asc(), is_point.asc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.min(F.when(F.col("_own"), F.col("_e"))).over(back)
    head = F.min(F.when(~F.col("_own"), F.col("_e"))).over(ahead)
    found = both.withColumn("_tail", tail).withColumn("_head", head).where(is_point)
    return found.select("_p.*", F.least("_tail", "_head").alias(into))


def unbeaten(spans: DataFrame, keys: list[str], lo: str, hi: str, tie: list[str], payload: list[str], chunk: int) -> DataFrame:
    """Spans that are the earliest-started one somewhere: keys, ``_lo``, ``_hi``, ``_before`` (where the one before it ends, null on the first) and the
    struct ``_pay``. Such a span wins from its start, or just after ``_before`` if that is later, to its end."""
    spans = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(hi) >= F.col(lo))).dropna(subset=keys)
    named = spans.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)],
                         F.struct(*[F.col(c) for c in payload]).alias("_pay"))
    ran = with_running(named, keys, ["_lo", *[f"_t{i}" for i in range(len(tie))]], F.col("_hi"), "_before", chunk, "max", inclusive=False)
    return ran.where(F.col("_before").isNull() | (F.col("_hi") > F.col("_before")))


def first_cover(points: DataFrame, spans: DataFrame, keys: list[str], t: str, lo: str, hi: str, tie: list[str],
                payload: list[str], tolerance: int = 0, chunk: int = 3_600_000, into: str = "hit",
                exact_first: bool = True, bounds: tuple[Column, Column] | None = None) -> DataFrame:
    """Left lookup: struct ``into`` holds the payload of the earliest-started span with ``lo <= t <= hi``; when no
    span covers the point and ``tolerance`` is given, of the earliest-started one that does within the tolerance.
    ``exact_first=False`` applies the tolerance straight away. Times are whole numbers, spans' keys not null.

    A span that ends before an earlier-started one does can never win. Of the rest both starts and ends grow, so span
    k wins from just after the end of span k-1 (a tolerance moves all ends alike). These pieces do not overlap; they
    are cut at time blocks, and inside (key, block) a point takes the newest piece at or before it.

    Pieces are kept only between ``bounds``, expressions of the keys that hold all times of a key's points (a day, say); by
    default between the first and the last point of all. So a span with a broken end or of many years fills no blocks in which no
    point can lie.
    """
    kept = unbeaten(spans, keys, lo, hi, tie, payload, chunk)
    levels = [0] if tolerance == 0 else ([0, tolerance] if exact_first else [tolerance])
    reach = [
        F.struct(F.lit(i).alias("level"), F.greatest(F.col("_lo") - slack, F.col("_before") + (slack + 1)).alias("from"), (F.col("_hi") + slack).alias("to"))
        for i, slack in enumerate(levels)
    ]
    if bounds is None:
        ends = points.agg(F.struct(F.min(t).alias("lo"), F.max(t).alias("hi"))).scalar()
        kept = kept.withColumn("_ends", ends)
        bounds = (F.col("_ends.lo"), F.col("_ends.hi"))
    kept = kept.withColumns({"_first": bounds[0], "_last": bounds[1]})
    pieces = kept.select(*keys, "_pay", "_first", "_last", F.explode(F.array(*reach)).alias("_r")).select(
        *keys, "_pay", F.struct(F.greatest("_r.from", "_first").alias("from"), F.least("_r.to", "_last").alias("to"), "_r.level").alias("_r")).where("_r.from <= _r.to")
    blocks = F.sequence(F.floor(F.col("_r.from") / chunk), F.floor(F.col("_r.to") / chunk))
    marks = pieces.select("*", F.explode(blocks).alias("_c")).select(
        *keys, "_c", F.greatest(F.col("_r.from"), F.col("_c") * chunk).alias("_x"), F.col("_r.level").alias("_level"),
        F.struct(F.col("_r.from").alias("from"), F.col("_r.to").alias("to"), F.col("_pay").alias("pay")).alias("_seg"))
    rows = points.select(*keys, F.floor(F.col(t) / chunk).alias("_c"), F.col(t).alias("_x"), F.struct(*points.columns).alias("_p"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    is_point = F.col("_p").isNotNull()
    inside = Window.partitionBy(*keys, "_c").orderBy(F.col("_x"), is_point.asc()).rowsBetween(Window.unboundedPreceding, 0)
    for i in range(len(levels)):
        both = both.withColumn(f"_s{i}", F.last(F.when(F.col("_level") == i, F.col("_seg")), ignorenulls=True).over(inside))
    hits = [F.when(F.col(f"_s{i}.to") >= F.col("_x"), F.col(f"_s{i}.pay")) for i in range(len(levels))]
    return both.where(is_point).select("_p.*", F.coalesce(*hits).alias(into))


STARTS, ENDS, WHOLE = 100, 101, 102  # groups of the cells of ``last_cover``, beside the levels inside a cell


def last_cover(points: DataFrame, spans: DataFrame, keys: list[str], t: str, lo: str, hi: str, order: list[str], until: Column | None = None,
               bits: int = 22, into: str = "hit") -> DataFrame:
    """Left lookup: struct ``into`` holds ``lo`` and the columns ``order`` of the greatest span (by them) with ``lo <= t <= hi``. Equal
    rows of ``points`` give one row; times are whole numbers, and a span with a null end or key, or one that ends before it begins, takes no part.

    Time is cut into cells of 2^bits. A span that crosses cells counts as a start in its first, as an end in its last and as a whole
    one between. A span inside one cell stands at the level of the highest bit in which its ends differ: its start in the lower half there, its
    end in the upper. So a point reads, in the one half it lies in at every level, either the starts up to it or the ends from it on, by a
    running maximum: whatever stands there covers it. A span takes two rows and a point one for each level that occurs; no pair is built.
    ``until``, an expression of the keys, is a time after all points of a key: longer spans fill no cells beyond it.
    """
    known = spans.where(F.col(lo).isNotNull() & (F.col(hi) >= F.col(lo))).dropna(subset=keys)
    end = F.col(hi) if until is None else F.greatest(F.col(lo), F.least(F.col(hi), until))
    named = known.select(*keys, F.struct(F.col(lo).alias(lo), *order).alias("_best"), F.col(lo).alias("_lo"), end.alias("_hi")).withColumns({
        "_a": F.shiftright("_lo", bits), "_z": F.shiftright("_hi", bits), "_level": F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi"))))})
    inside = F.array(
        F.struct(F.col("_level").alias("level"), F.expr("shiftright(_lo, _level - 1)").alias("half"), F.col("_lo").alias("x")),
        F.struct(F.col("_level").alias("level"), F.expr("shiftright(_hi, _level - 1)").alias("half"), (-F.col("_hi")).alias("x")))
    across = F.array(
        F.struct(F.lit(STARTS).alias("level"), F.col("_a").alias("half"), F.col("_lo").alias("x")),
        F.struct(F.lit(ENDS).alias("level"), F.col("_z").alias("half"), (-F.col("_hi")).alias("x")))
    ends = named.select(*keys, "_best", F.explode(F.when(F.col("_a") == F.col("_z"), inside).otherwise(across)).alias("_e")).select(*keys, "_best", "_e.*")
    whole = named.where(F.col("_z") > F.col("_a") + 1).select(*keys, "_best", F.explode(F.sequence(F.col("_a") + 1, F.col("_z") - 1)).alias("half"))
    whole = whole.groupBy(*keys, "half").agg(F.max("_best").alias("_best")).select(*keys, "_best", F.lit(WHOLE).alias("level"), "half", F.lit(0).cast("long").alias("x"))
    used = named.agg(F.collect_set(F.when(F.col("_a") == F.col("_z"), F.col("_level")))).scalar()
    levels = F.explode(F.array_union(used, F.array(F.lit(STARTS), F.lit(ENDS), F.lit(WHOLE))))
    asked = points.select(*keys, F.col(t).alias("_t"), F.struct(*points.columns).alias("_p"), levels.alias("level"))
    half = F.when(F.col("level") >= STARTS, F.shiftright("_t", bits)).otherwise(F.expr("shiftright(_t, level - 1)"))
    at = asked.withColumn("half", half)
    forward = F.when(F.col("level") >= STARTS, F.col("level") == STARTS).otherwise(F.pmod("half", F.lit(2)) == 0)
    at = at.withColumn("x", F.when(F.col("level") == WHOLE, F.lit(0)).when(forward, F.col("_t")).otherwise(-F.col("_t"))).drop("_t")
    both = at.unionByName(ends.unionByName(whole), allowMissingColumns=True)
    upto = Window.partitionBy(*keys, "level", "half").orderBy(F.col("x"), F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumn("_hit", F.max("_best").over(upto)).where(F.col("_p").isNotNull())
    return read.groupBy("_p").agg(F.max("_hit").alias(into)).select("_p.*", into)


def last_around(points: DataFrame, spans: DataFrame, keys: list[str], first: str, last: str, lo: str, hi: str, order: list[str], origin: Column,
                bits: int = 28, chunk: int = 3_600_000, into: str = "hit") -> DataFrame:
    """Left lookup: struct ``into`` holds ``lo`` and the columns ``order`` of the greatest span (by them) with ``lo <= first`` and ``hi >= last``.
    Equal rows of ``points`` give one row; ``origin``, an expression of the keys, is no later than any time, and 2^bits - 1 after it none is asked for.

    A span stands at every bit of its end that is 1, under the bits above it; a point asks at every bit of ``last`` that is 0 for the ends that
    agree above it and have a 1 there: together these are the later ends, each once. Of them it reads the greatest begun so far. So both
    sides take up to ``bits`` rows each, and no pair is built.
    """
    ends = F.least(F.col(hi) - origin + 1, F.lit((1 << bits) - 1))
    numbers = F.explode(F.array(*[F.lit(i) for i in range(bits)])).alias("_bit")
    known = spans.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).dropna(subset=keys).select(
        *keys, F.struct(F.col(lo).alias(lo), *order).alias("_best"), F.col(lo).alias("_x"), ends.cast("long").alias("_end"), numbers)
    known = known.select(*keys, "_best", "_x", "_bit", F.expr("shiftright(_end, _bit)").alias("_node"), F.lit(0).alias("_kind")).where("_node % 2 = 1")
    asked = points.select(*keys, F.col(first).alias("_x"), (F.col(last) - origin).cast("long").alias("_end"), F.struct(*points.columns).alias("_p"), numbers)
    asked = asked.where("shiftright(_end, _bit) % 2 = 0").select(*keys, "_x", "_p", "_bit", F.expr("shiftright(_end, _bit) + 1").alias("_node"), F.lit(1).alias("_kind"))
    ran = with_running(asked.unionByName(known, allowMissingColumns=True), [*keys, "_bit", "_node"], ["_x", "_kind"], F.col("_best"), "_hit", chunk, "max")
    return ran.where(F.col("_kind") == 1).groupBy("_p").agg(F.max("_hit").alias(into)).select("_p.*", into)
