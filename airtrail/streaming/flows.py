"""Flow blocks from two streams: flows and request transfers of a socket are matched in the socket's state, no pair is ever sent."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BLOCK_ROWS = "block STRING, side STRING, pos LONG, matched BOOLEAN, socket STRING, flow_id LONG, seq LONG, t_us LONG"
MINUTE_US = 60_000_000
FLOW, TRANSFER = ("flow_id", "t_us"), ("conn_no", "seq", "connection", "conn_us", "req_us", "taken")
SOCKET_STATE = ("number LONG, ended BOOLEAN, flow_id ARRAY<LONG>, t_us ARRAY<LONG>, "
                "conn_no ARRAY<LONG>, seq ARRAY<LONG>, connection ARRAY<STRING>, conn_us ARRAY<LONG>, req_us ARRAY<LONG>, taken ARRAY<BOOLEAN>")
BlockRow = Row(*(field.split()[0] for field in BLOCK_ROWS.split(", ")))


class Connection:
    """Transfers of one connection, in order."""

    def __init__(self, number: int, rows: list):
        self.number, self.rows = number, rows
        first = rows[0]
        opened = first["connection"] in ("start", "unique") and first["conn_us"]
        self.align, self.first, self.last = first["conn_us"] if opened else first["req_us"], first["req_us"], rows[-1]["req_us"]
        self.closed = any(r["connection"] in ("last", "unique") for r in rows)
        self.taken = any(r["taken"] for r in rows)
        # closed ones first, then by first request
        self.rank = (not self.closed, self.first, number)


class FlowBlocks(StatefulProcessor):
    """The state of a socket: transfers that wait or belong to connections not yet sent, flows not yet decided, the latest number.

    Once the watermark has passed a transfer, it is numbered into a connection as in the batch. A flow is decided when
    no connection can appear or close any more that it would prefer; a connection is sent when it has ended and no flow can come or
    wait for it. So the state holds the rows of the last ``tol + lead`` and those of connections
    that are still open, and two values for each socket ever seen.
    """

    def __init__(self, tol: int, lead: int, idle: int):
        self.tol, self.lead, self.idle = tol, lead, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # all of a socket is one value, read and written once a call: rows of a list state travel to the JVM one by one
        self.state = handle.getValueState("socket", SOCKET_STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        flows, sent = [], []
        for _, _, flow_id, t_us, seq, connection, conn_us, req_us in rows:
            if flow_id is not None:
                flows.append({"flow_id": flow_id, "t_us": t_us})
            else:
                sent.append({"conn_no": None, "seq": seq, "connection": connection, "conn_us": conn_us, "req_us": req_us, "taken": False})
        return self.advance(key[0], flows, sent, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.advance(key[0], [], [], 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def advance(self, socket: str, flows: list, sent: list, now: int) -> Iterator[Row]:
        """Everything that the watermark ``now`` (no earlier row can come) allows."""
        # the latest connection's number and whether its last row ended it
        number, ended, *waits = self.state.get() or (0, True, *[[]] * 8)
        flows += [dict(zip(FLOW, r)) for r in zip(*waits[:2])]
        sent += [dict(zip(TRANSFER, r)) for r in zip(*waits[2:])]
        held: dict[int, list] = {}
        waiting = sorted((r for r in sent if r["conn_no"] is None), key=lambda r: (r["req_us"], r["seq"]))
        for r in sorted((r for r in sent if r["conn_no"] is not None), key=lambda r: (r["req_us"], r["seq"])):
            held.setdefault(r["conn_no"], []).append(r)
        later = [r for r in waiting if r["req_us"] >= now]
        for r in waiting[: len(waiting) - len(later)]:
            silent = number in held and r["req_us"] - held[number][-1]["req_us"] > self.idle
            if ended or silent or r["connection"] in ("start", "unique"):
                number += 1
            r["conn_no"], ended = number, r["connection"] in ("last", "unique")
            held.setdefault(number, []).append(r)
        known = [Connection(n, rows) for n, rows in held.items()]
        if known and not ended and now - held[number][-1]["req_us"] > self.idle and not any(r["req_us"] - held[number][-1]["req_us"] <= self.idle for r in later):
            ended = True
        open_ = {c.number: c for c in known if c.number == number and not ended}

        out, left = [], []
        near, ahead = deque(), deque(sorted(known, key=lambda c: c.align))
        for flow in sorted(flows, key=lambda f: (f["t_us"], f["flow_id"])):
            best = self.choice(flow, near, ahead, open_) if now > flow["t_us"] + self.tol + self.lead else self
            if best is self:
                left.append(flow)
                continue
            if best:
                best.taken = True
            name = f"{socket}#{best.number}" if best else f"flow#{flow['flow_id']}"
            out.append(BlockRow(name, "tcp", flow["flow_id"], best is not None, socket, flow["flow_id"], None, flow["t_us"]))
        kept, undecided = [], [f["t_us"] for f in left]
        for c in known:
            first = bisect_right(undecided, c.align - self.tol)
            if c.number in open_ or now <= c.align + self.tol or (first < len(undecided) and undecided[first] < c.align + self.tol):
                kept += [r | {"taken": c.taken} for r in c.rows]
                continue
            out += [BlockRow(f"{socket}#{c.number}", "http", r["seq"], c.taken, socket, None, r["seq"], r["conn_us"] if r["conn_us"] is not None else r["req_us"]) for r in c.rows]

        self.state.update((number, ended, *([f[c] for f in left] for c in FLOW), *([r[c] for r in kept + later] for c in TRANSFER)))
        times = [f["t_us"] + self.tol + self.lead for f in left] + [r["req_us"] for r in later] + [c.align + self.tol for c in known] + [c.last + self.idle for c in known if c.number in open_]
        to_come = [t for t in times if t >= now]
        if to_come:
            self.handle.registerTimer(min(to_come) // 1000 + 1)
        return iter(out)

    def choice(self, flow: dict, near: deque, ahead: deque, open_: dict):
        """The connection of a flow, None without one, or the processor itself while a connection that is still open could come first.

        Flows come in time order, connections wait by their time in ``ahead``. ``near`` holds those within reach that none of the later ones
        there comes before, so its first is the best, and each connection enters and leaves it once.
        """
        while ahead and ahead[0].align < flow["t_us"] + self.tol:
            c = ahead.popleft()
            while near and near[-1].rank > c.rank:
                near.pop()
            near.append(c)
        while near and near[0].align <= flow["t_us"] - self.tol:
            near.popleft()
        if not near:
            return None
        best = near[0]
        waits = any(c is not best and abs(flow["t_us"] - c.align) < self.tol and (False, c.first, c.number) < best.rank for c in open_.values())
        return self if waits else best


def stream_merge_blocks(tcp: DataFrame, http: DataFrame, tol: int = 3 * MINUTE_US, delay: str = "5 minutes", lead: int = 5 * MINUTE_US,
                        idle: int = 60 * MINUTE_US) -> DataFrame:
    """Rows of blocks (``BLOCK_ROWS``) of two streams as ``merge_flows`` makes them: every flow and every transfer once.

    ``tcp`` has flow_id, socket, t_us, flow_ts; ``http`` seq, socket, connection, conn_us, req_us, http_ts (the times again as timestamps).
    A row that comes more than ``delay`` after later ones of both streams is left out. ``lead`` (microseconds) is how long a connection may have been open
    before its first request; one that began earlier can miss flows from before. A connection silent for ``idle`` has ended; with an idle
    time above every silence the blocks are those of the batch.
    """
    none = {"long": F.lit(None).cast("long"), "string": F.lit(None).cast("string")}
    left = tcp.withWatermark("flow_ts", delay).select(
        "socket", F.col("flow_ts").alias("ts"), F.col("flow_id").cast("long").alias("flow_id"), F.col("t_us").cast("long").alias("t_us"), none["long"].alias("seq"),
        none["string"].alias("connection"), none["long"].alias("conn_us"), none["long"].alias("req_us"))
    right = http.withWatermark("http_ts", delay).select(
        "socket", F.col("http_ts").alias("ts"), none["long"].alias("flow_id"), none["long"].alias("t_us"), F.col("seq").cast("long").alias("seq"), "connection",
        F.col("conn_us").cast("long").alias("conn_us"), F.col("req_us").cast("long").alias("req_us"))
    return left.union(right).groupBy("socket").transformWithState(FlowBlocks(tol, lead, idle), BLOCK_ROWS, "append", "eventTime")


CELL_TOLERANCES, SPAN = 480, 1000  # length of a cell of time in tolerances; rows of a side in one row of pairs


class Pairs(StatefulProcessor):
    """The state of a key's cell of time: rows of both sides for which a partner can still come.

    Beside its own rows a cell holds copies of those of its neighbours that lie within the tolerance of its edge, so it knows all
    partners of its own rows; a pair is sent by the cell of its left row. Spark gathers what one call sends, so pairs are not sent one
    by one: a row carries up to ``SPAN`` rows of each side in time order and, for each left one, where its partners begin and how many they are.
    """

    def __init__(self, tol: int, left: list[str], right: list[str], places: list[list[int]], times: list[int]):
        self.tol, self.kinds, self.times = tol, (left, right), times
        self.row = Row(*columns(left, right))
        self.places = [[4 + k for k in side] for side in places]  # after key, cell, time stamp and kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = [f"{side}{i} ARRAY<{kind}>" for side, kinds in zip("lr", self.kinds) for i, kind in enumerate([*kinds, "LONG", "BOOLEAN", "BOOLEAN"])]
        self.state = handle.getValueState("cell", ", ".join(held))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh: tuple[list, list] = ([], [])
        for r in rows:
            own, side = divmod(r[3], 2)
            values = [r[k] for k in self.places[side]]
            fresh[side].append((*values, values[self.times[side]], own == 1, False))
        return self.advance(fresh, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.advance(([], []), 1000 * timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass

    def advance(self, fresh: tuple[list, list], now: int) -> Iterator[Row]:
        """Pairs of new rows, and rows without partner that the watermark ``now`` has passed. A row is its columns, time, whether it is the cell's own and whether it has met one."""
        held, split = self.state.get(), len(self.kinds[0]) + 3
        old = [sorted(zip(*part), key=itemgetter(-3)) for part in (held[:split], held[split:])] if held else [[], []]
        fresh = [sorted(rows, key=itemgetter(-3)) for rows in fresh]
        both = [sorted(a + b, key=itemgetter(-3)) if a and b else a or b for a, b in zip(old, fresh)]
        if fresh[0]:
            yield from self.pairs(fresh[0], both[1])
        if old[0] and fresh[1]:
            yield from self.pairs(old[0], fresh[1])
        first, after = zip(*(self.reach(both[i], both[1 - i]) for i in (0, 1)))
        kept, ahead = [], []
        for i, rows in enumerate(both):
            met = [r[-1] or a < z for r, a, z in zip(rows, first[i].tolist(), after[i].tolist())]
            alone = [r for r, m in zip(rows, met) if r[-2] and not m and r[-3] + self.tol <= now]
            for k in range(0, len(alone), SPAN):
                yield self.record(*([alone[k:k + SPAN], None] if i == 0 else [None, alone[k:k + SPAN]]))
            kept.append([(*r[:-1], m) for r, m in zip(rows, met) if r[-3] + self.tol > now])
            ahead += [r[-3] + self.tol for r in kept[i][:1]]
        if ahead:
            self.state.update(tuple(column for rows, kinds in zip(kept, self.kinds) for column in ([list(c) for c in zip(*rows)] or [[] for _ in range(len(kinds) + 3)])))
            self.handle.registerTimer(max(now, min(ahead)) // 1000 + 1)
        elif held:
            self.state.clear()

    def reach(self, rows: list, other: list) -> tuple:
        """Where the rows of the other side that lie within the tolerance begin and end, for each row; both sides are in time order."""
        import numpy as np

        at, near = (np.array([r[-3] for r in side], dtype=np.int64) for side in (rows, other))
        return np.searchsorted(near, at - self.tol, "right"), np.searchsorted(near, at + self.tol, "left")

    def pairs(self, left: list, right: list) -> Iterator[Row]:
        """Rows that hold all pairs of the cell's own left rows, with only such rows as have a partner."""
        import numpy as np

        first, after = self.reach(right, left)
        right = [r for r, a, z in zip(right, first.tolist(), after.tolist()) if a < z]
        first, after = self.reach(left, right)
        some = [k for k, r in enumerate(left) if r[-2] and first[k] < after[k]]
        left, first, after = [left[k] for k in some], first[some], after[some]
        for k in range(0, len(left), SPAN):
            part, lo, hi = left[k:k + SPAN], first[k:k + SPAN], after[k:k + SPAN]
            for begin in range(int(lo[0]), int(hi[-1]), SPAN):
                a, z = np.maximum(lo, begin), np.minimum(hi, begin + SPAN)
                these = np.nonzero(a < z)[0].tolist()
                if these:
                    yield self.record([part[j] for j in these], right[begin:begin + SPAN], (a[these] - begin).tolist(), (z - a)[these].tolist())

    def record(self, left: list | None, right: list | None, first: list | None = None, many: list | None = None) -> Row:
        """One row of both sides' columns; without ``first`` the rows have no partner."""
        sides = [[list(c) for c in list(zip(*rows))[:-3]] if rows else [None] * len(kinds) for rows, kinds in zip((left, right), self.kinds)]
        none = left and [0] * len(left)
        return self.row(*sides[0], first or none, many or none, *sides[1])


def columns(left: list, right: list) -> list[str]:
    """Columns of the rows that ``Pairs`` sends: the left side's, where partners begin, how many they are, the right side's."""
    return [*(f"_l{i}" for i in range(len(left))), "_first", "_many", *(f"_r{i}" for i in range(len(right)))]


def stream_pairs(left: DataFrame, right: DataFrame, on: tuple[str, str], times: tuple[str, str], tol: int, delay: str) -> DataFrame:
    """Full outer join of two streams on equal keys (null is a key like any other) and times less than ``tol`` microseconds apart. All columns of both.

    A key's rows are cut into cells of time that are found, held and sent apart, so neither a key's rows nor its pairs are ever together in a
    task's memory. Rows meet only those near them in time, and Python handles rows: the pairs are taken apart afterwards.
    """
    fields = [[(f.name, "long" if f.name == t else f.dataType.simpleString()) for f in df.schema.fields] for df, t in ((left, times[0]), (right, times[1]))]
    kinds = [[kind for _, kind in side] for side in fields]
    # both sides share columns of the same kind, as every value of a row costs Python time
    slots, places = list(kinds[0]), [list(range(len(kinds[0]))), []]
    for kind in kinds[1]:
        free = [k for k, other in enumerate(slots) if other == kind and k not in places[1]]
        places[1].append(free[0] if free else len(slots))
        slots += [] if free else [kind]
    width, parts = max(1, CELL_TOLERANCES * tol), []
    for i, (df, key, t) in enumerate(((left, on[0], times[0]), (right, on[1], times[1]))):
        own = [F.unix_micros(c) if c == t else F.col(c) for c, _ in fields[i]]
        shared = [(own[places[i].index(k)] if k in places[i] else F.lit(None).cast(kind)).alias(f"_v{k}") for k, kind in enumerate(slots)]
        cells = F.array_distinct(F.array(*[F.floor((F.unix_micros(t) + slack) / width) for slack in (0, 1 - tol, tol - 1)]))
        marked = df.where(F.col(t).isNotNull()).withWatermark(t, delay).select("*", F.explode(cells).alias("_cell"))
        kind = F.when(F.col("_cell") == F.floor(F.unix_micros(t) / width), 2 + i).otherwise(i)  # own rows, copies; left, right
        parts.append(marked.select(F.col(key).alias("_key"), "_cell", F.col(t).alias("_ts"), kind.alias("_kind"), *shared))
    names, at = columns(*kinds), [[c for c, _ in side].index(t) for side, t in zip(fields, times)]
    shape = ", ".join(f"{c} ARRAY<{kind}>" for c, kind in zip(names, [*kinds[0], "INT", "INT", *kinds[1]]))
    sent = parts[0].union(parts[1]).groupBy("_key", "_cell").transformWithState(Pairs(tol, *kinds, places, at), shape, "append", "eventTime")
    split = len(kinds[0]) + 2
    each = sent.select(F.arrays_zip(*names[split:]).alias("_all"), F.inline_outer(F.arrays_zip(*names[:split])))
    partners = F.when(F.col("_many") > 0, F.slice("_all", F.col("_first") + 1, F.col("_many"))).otherwise(F.col("_all"))
    met = each.select(*names[:split - 2], F.explode_outer(partners).alias("_other"))
    met = met.select(*[F.col(c).alias(f) for c, (f, _) in zip(names, fields[0])], *[F.col(f"_other.{c}").alias(f) for c, (f, _) in zip(names[split:], fields[1])])
    return met.withColumns({t: F.timestamp_micros(t) for t in times})
