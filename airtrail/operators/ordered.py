"""Ordered work inside a key that stays spread out when one key holds most rows.

A plain window over ``(key order by time)`` puts a whole key into one task. Here rows are windowed per
``(key, time chunk)``; what a chunk needs from earlier ones is one summary row per chunk, carried over by a
window on the summaries and joined back. The result equals the plain window for any chunk width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"
FAN = 4096  # chunks (or cells) that one window of summaries holds where ``levels`` asks for more than one level


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _chunk(order: list[str], width) -> Column:
    return F.floor(F.col(order[0]) / F.lit(width))


def _chunk_before(summary: DataFrame, keys: list[str], column: str, into: str, levels: int) -> DataFrame:
    """Add to one row per chunk the column of the key's chunk before; with more levels the chunks are chunked again."""
    if levels <= 1:
        return summary.withColumn(into, F.lag(column).over(Window.partitionBy(*keys).orderBy(CHUNK)))
    named = with_previous(summary.withColumnRenamed(CHUNK, "_at"), keys, ["_at"], [column], FAN, "_chunk_before", levels - 1)
    return named.withColumn(into, F.col("_chunk_before")[column]).withColumnRenamed("_at", CHUNK).drop("_chunk_before")


def _chunks_before(summary: DataFrame, keys: list[str], column: str, into: str, how: str, levels: int) -> DataFrame:
    """Add to one row per chunk the fold of a column over all the key's chunks before (null, or 0 for a sum, on the first)."""
    if levels <= 1:
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return summary.withColumn(into, FOLDS[how](column).over(before))
    named = with_running(summary.withColumnRenamed(CHUNK, "_at"), keys, ["_at"], F.col(column), into, FAN, how, False, levels - 1)
    return named.withColumnRenamed("_at", CHUNK)


def with_previous(df: DataFrame, keys: list[str], order: list[str], fields: list[str], chunk, into: str = "prev", levels: int = 1) -> DataFrame:
    """Add a struct of the previous row's fields (null on a key's first row).

    ``order`` starts with a number (time) and must be total inside a key; a null key is a key like any other.
    ``chunk`` is the width of a time chunk in the unit of ``order[0]``; None uses one window per key. The summaries of a key's chunks
    meet in one window; ``levels`` builds a tree of summaries instead, ``FAN`` chunks a node, for keys of very many chunks.
    """
    now = F.struct(*fields)
    by_time = [F.col(c) for c in order]
    if chunk is None:
        return df.withColumn(into, F.lag(now).over(Window.partitionBy(*keys).orderBy(*by_time)))
    columns = df.columns
    df = df.withColumn(CHUNK, _chunk(order, chunk))
    last = df.groupBy(*keys, CHUNK).agg(F.max(F.struct(*order, now.alias("_now"))).alias("_last"))
    carry = _chunk_before(last.select(*keys, CHUNK, F.col("_last._now").alias("_now")), keys, "_now", "_carry", levels).drop("_now")
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*by_time)
    return null_safe(df, carry, [*keys, CHUNK]).select(*columns, F.coalesce(F.lag(now).over(inside), F.col("_carry")).alias(into))


def with_running(df: DataFrame, keys: list[str], order: list[str], value: Column, into: str, chunk,
                 how: str = "sum", inclusive: bool = True, levels: int = 1) -> DataFrame:
    """Add a running sum, maximum or minimum of ``value``; ``inclusive=False`` leaves the current row out. A null key is a key like any other."""
    fold = FOLDS[how]
    by_time = [F.col(c) for c in order]
    stop = Window.currentRow if inclusive else -1
    columns = df.columns
    df = df.withColumn("_value", value)

    def merge(a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)) if how == "sum" else (F.greatest if how == "max" else F.least)(a, b)

    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*by_time).rowsBetween(Window.unboundedPreceding, stop)
        run = fold("_value").over(whole)
        return df.withColumn(into, F.coalesce(run, F.lit(0)) if how == "sum" else run).drop("_value")
    df = df.withColumn(CHUNK, _chunk(order, chunk))
    total = df.groupBy(*keys, CHUNK).agg(fold("_value").alias("_total"))
    base = _chunks_before(total, keys, "_total", "_base", how, levels).drop("_total")
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*by_time).rowsBetween(Window.unboundedPreceding, stop)
    return null_safe(df, base, [*keys, CHUNK]).select(*columns, merge(F.col("_base"), fold("_value").over(inside)).alias(into))


def with_islands(df: DataFrame, keys: list[str], order: list[str], fields: list[str], opens, chunk, into: str, levels: int = 1) -> DataFrame:
    """Number the runs of rows inside a key; ``opens(prev)`` says where a new run starts (a first row always does). A null key is a key like any other.

    ``opens`` may use the row's own ``fields`` by name and the previous row's through ``prev``. Runs are counted inside
    a chunk, and a chunk's first and last row and its count decide what the later chunks add.
    """
    columns = df.columns
    fields = list(dict.fromkeys(fields))
    now, at = F.struct(*fields), F.struct(*order)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c) for c in order])
    rows = df.withColumn(CHUNK, F.lit(0) if chunk is None else _chunk(order, chunk)).withColumn("_prev", F.lag(now).over(inside))
    rows = rows.withColumn("_open", (F.col("_prev").isNotNull() & F.coalesce(opens(F.col("_prev")), F.lit(False))).cast("long"))
    rows = rows.drop("_prev")
    if chunk is not None:
        ends = rows.groupBy(*keys, CHUNK).agg(
            F.min(F.struct(at.alias("at"), now.alias("row"))).alias("_head"), F.max(F.struct(at.alias("at"), now.alias("row"))).alias("_tail"),
            F.sum("_open").alias("_n"))
        own = [f for f in fields if f not in keys]
        ends = _chunk_before(ends.withColumn("_row", F.col("_tail.row")), keys, "_row", "_before_row", levels)
        ends = ends.select(*keys, CHUNK, "_n", F.col("_before_row").alias("_before"), *[F.col(f"_head.row.{f}").alias(f) for f in own])
        fresh = F.col("_before").isNull() | F.coalesce(opens(F.col("_before")), F.lit(False))
        ends = ends.select(*keys, CHUNK, fresh.cast("long").alias("_fresh"), (F.col("_n") + fresh.cast("long")).alias("_opened"))
        ends = _chunks_before(ends, keys, "_opened", "_passed", "sum", levels)
        base = F.coalesce(F.col("_passed"), F.lit(0)) + F.col("_fresh")
        rows = null_safe(rows, ends.select(*keys, CHUNK, base.alias("_base")), [*keys, CHUNK])
    else:
        rows = rows.withColumn("_base", F.lit(1))
    run = F.sum("_open").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(*columns, (F.col("_base") + run).alias(into))


def gap_cells(df: DataFrame, keys: list[str], ts: str, gap: int, folds: dict[str, tuple[Column, str]],
              strict: bool = False, levels: int = 1) -> DataFrame:
    """Fold rows into cells one gap wide and give every cell its session start.

    Rows in one cell lie closer than the gap, so a session is a run of whole cells. The fold is partial on the
    map side: a key sends at most (time span / gap) rows per map task, however many rows it holds. ``folds`` maps a
    name to (value, ``sum``/``min``/``max``/``count``). No window holds more than ``FAN`` cells of a key, or one row for each ``FAN`` of
    them; further ``levels`` cut those rows again.
    """
    apply = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
    cells = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.floor(F.col(ts) / F.lit(gap)).alias("_cell"))
        .agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
             *[apply[how](value).alias(name) for name, (value, how) in folds.items()])
    )
    # a key's cells meet in blocks of FAN cells; one row a block carries what later blocks need
    cells = cells.withColumn(CHUNK, F.floor(F.col("_cell") / F.lit(FAN)))
    by_cell = Window.partitionBy(*keys, CHUNK).orderBy("_cell")

    def apart(lo: Column, hi: Column) -> Column:
        return lo - hi >= gap if strict else lo - hi > gap

    cells = cells.withColumn("_opened", F.when(apart(F.col("_lo"), F.lag("_hi").over(by_cell)), F.col("_lo")))
    ends = cells.groupBy(*keys, CHUNK).agg(F.min("_lo").alias("_first"), F.max("_hi").alias("_last"), F.max("_opened").alias("_inner"))
    ends = _chunk_before(ends, keys, "_last", "_before", levels)
    head = F.when(F.coalesce(apart(F.col("_first"), F.col("_before")), F.lit(True)), F.col("_first"))
    # starts grow with time, so the latest is the largest
    ends = ends.withColumn("_head", head).withColumn("_newest", F.greatest("_head", "_inner"))
    ends = _chunks_before(ends, keys, "_newest", "_running", "max", levels).select(*keys, CHUNK, F.coalesce("_head", "_running").alias("_base"))
    start = F.coalesce(F.max("_opened").over(by_cell.rowsBetween(Window.unboundedPreceding, 0)), F.col("_base"))
    return null_safe(cells, ends, [*keys, CHUNK]).withColumn("session_start", start).drop("_opened", "_base", CHUNK)


def gap_sessions(df: DataFrame, keys: list[str], ts: str, gap: int, folds: dict[str, tuple[Column, str]],
                 strict: bool = False) -> DataFrame:
    """One row per session: start, last time and the folds, without ever shuffling single rows."""
    again = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    cells = gap_cells(df, keys, ts, gap, folds, strict)
    return cells.groupBy(*keys, "session_start").agg(
        F.max("_hi").alias("session_last"), *[again[how](name).alias(name) for name, (_, how) in folds.items()]
    )


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """Join on equal names where null equals null; keeps the left columns and the right's other ones."""
    other = right.select([F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in right.columns])
    if how in ("left_semi", "left_anti"):
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
        return left.join(other, same, how)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names])
    return left.join(other, same, how).drop(*[f"_r_{c}" for c in names])


def mark_gap_sessions(df: DataFrame, keys: list[str], ts: str, gap: int, strict: bool = False) -> DataFrame:
    """Give every row its session start. The row join is on (key, cell), so a hot key is spread over its cells."""
    cells = gap_cells(df, keys, ts, gap, {}, strict).select(*keys, "_cell", "session_start")
    rows = df.withColumn("_cell", F.floor(F.col(ts) / F.lit(gap)))
    return null_safe(rows, cells, [*keys, "_cell"]).drop("_cell")
