"""A socket's state is walked once."""

import random
import time

from airtrail.streaming import flows


class Handle:
    """State of one socket without Spark."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        pass


def test_flows_of_a_busy_socket_walk_its_connections_once():
    """The connection chosen is the plain rule's, and eight times the rows take no 64 times the time."""
    spent = {}
    for n in (2_000, 16_000):
        rng = random.Random(5)
        sent = [{"conn_no": None, "seq": i, "connection": rng.choice(["start", "continue", "last", "unique"]), "conn_us": None, "req_us": 50 * i + rng.randrange(40), "taken": False} for i in range(n)]
        asked = [{"flow_id": i, "t_us": rng.randrange(50 * n)} for i in range(n)]
        blocks = flows.FlowBlocks(300, 0, 10**9)
        blocks.init(Handle())
        out, start = [], time.perf_counter()
        for now in (25 * n, 10**12):
            fresh = [[dict(r) for r in rows if (r[at] < 25 * n) == (now == 25 * n)] for rows, at in ((asked, "t_us"), (sent, "req_us"))]
            out += blocks.advance("s", *fresh, now)
        spent[n] = time.perf_counter() - start
        assert sorted((r.side, r.pos) for r in out) == sorted([("tcp", i) for i in range(n)] + [("http", i) for i in range(n)])
        if n == 2_000:
            made: dict = {}
            for r in out:
                if r.side == "http":
                    made.setdefault(r.block, []).append(sent[r.seq])
            known = [(not any(r["connection"] in ("last", "unique") for r in rows), min(r["req_us"] for r in rows), block) for block, rows in made.items()]
            for r in out:
                if r.side == "tcp":
                    near = [c for c in known if abs(r.t_us - c[1]) < 300]
                    assert r.block == (min(near)[2] if near else f"flow#{r.flow_id}")
    assert spent[16_000] < 30 * spent[2_000]
