"""Web-activity forests: requests linked to the request they came from.

Linking depends on everything linked before it in the same key, so it runs as a small per-key state over rows that Spark
has partitioned and sorted; rows stream through in Arrow batches and only live trees are held.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions.spans import CONJUNCT, PARALLEL, RELAYED, SERIAL, SHORTEST, UNCLASSIFIED
from ..session import settle
from .ordered import mark_gap_sessions

EDGE = "tree STRING, node STRING, parent STRING, dummy BOOLEAN, t BIGINT, url STRING"
FAT_PAGE, SLIM_PAGE = 5, 2


def _streamed(rows: DataFrame, groups: list[str], order: list[str], make_state, schema: str) -> DataFrame:
    """Run a per-group state over sorted rows. ``make_state()`` gives an object with ``take(row)`` and ``close()``, both
    returning output tuples; groups may span batches and are never gathered."""
    columns, n = rows.columns, len(groups)
    at = [columns.index(g) for g in groups]

    def run(batches: Iterator):
        import pandas as pd

        names = [part.split()[0] for part in schema.split(", ")]
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current:
                    if state is not None:
                        out.extend(state.close())
                    current, state = key, make_state()
                out.extend(state.take(row))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state is not None:
            rest = list(state.close())
            if rest:
                yield pd.DataFrame(rest, columns=names)

    placed = rows.repartition(*groups).sortWithinPartitions(*groups, *order)
    return placed.mapInPandas(run, schema)


class _Referrers:
    """Live trees of one key; a node joins the newest tree that holds its referrer. Idle trees are dropped now and then."""

    def __init__(self, slots: dict[str, int], keys: list[int], idle: int):
        self.slots, self.keys, self.idle = slots, keys, idle
        self.planted = 0
        self.last: dict[int, int] = {}               # tree number (age) -> last request time
        self.names: dict[int, str] = {}
        self.places: dict[str, list[int]] = {}       # url -> trees that hold it, oldest first
        self.nodes: dict[tuple[int, str], str] = {}  # (tree, url) -> newest node
        self.room = 10_000

    def take(self, row):
        key = [row[i] for i in self.keys]
        t, seq, url, ref = (row[self.slots[c]] for c in ("t", "seq", "url", "ref"))
        node, parent, out = f"n{seq}", None, []
        held = self.places.get(ref, []) if ref is not None else []
        while held and t - self.last[held[-1]] > self.idle:
            held.pop()  # an idle tree never lives again
        if held:
            tree = held[-1]
            parent = self.nodes[tree, ref]
        else:
            tree = self.planted
            self.planted += 1
            root = node if ref is None else f"d{seq}"
            self.names[tree] = root
            if ref is not None:
                parent = root
                out.append((*key, root, root, None, True, t, ref))
                self._hold(tree, ref, root)
        self.last[tree] = t
        out.append((*key, self.names[tree], node, parent, False, t, url))
        if url is not None:
            self._hold(tree, url, node)
        if len(self.nodes) > self.room:
            self._drop_idle(t)
        return out

    def _hold(self, tree: int, url: str, node: str):
        if (tree, url) not in self.nodes:
            insort(self.places.setdefault(url, []), tree)
        self.nodes[tree, url] = node

    def _drop_idle(self, t: int):
        self.last = {n: x for n, x in self.last.items() if t - x <= self.idle}
        self.names = {n: self.names[n] for n in self.last}
        self.nodes = {(n, u): v for (n, u), v in self.nodes.items() if n in self.last}
        kept = {u: [n for n in trees if n in self.last] for u, trees in self.places.items()}
        self.places = {u: trees for u, trees in kept.items() if trees}
        self.room = max(10_000, 2 * len(self.nodes))

    def close(self):
        return ()


def referrer_forest(http: DataFrame, keys: list[str], idle: int = 900_000_000) -> DataFrame:
    """Edges (keys, tree, node, parent, dummy, t, url) of referrer trees.

    ``http`` has the keys, t (microseconds), seq, url and ref (both without protocol). A request joins the newest tree
    that is not idle and holds its referrer, under the latest node with that address. Without referrer it starts a tree;
    an unknown referrer becomes a dummy root. Keys are first cut at silences over ``idle``: no tree lives across one.
    """
    cut = mark_gap_sessions(http.where(F.col("t").isNotNull()), keys, "t", idle)
    rows = cut.select(*keys, "session_start", "t", "seq", "url", "ref")
    slots = {c: rows.columns.index(c) for c in ("t", "seq", "url", "ref")}
    at = list(range(len(keys)))
    schema = _key_ddl(http, keys) + EDGE
    return _streamed(rows, [*keys, "session_start"], ["t", "seq"], lambda: _Referrers(slots, at, idle), schema)


def _key_ddl(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)


def _end(node) -> float:
    return node["end"] if node["end"] is not None else node["start"] + SHORTEST


def _shared(a, b) -> float:
    return min(_end(a), _end(b)) - max(a["start"], b["start"])


def _pair_class(a, b) -> int:
    """Row form of ``functions.spans.classify_pair``."""
    lasts = min(a["duration"] or SHORTEST, b["duration"] or SHORTEST)
    if abs(a["start"] - b["start"]) <= 0.5 and abs(_end(a) - _end(b)) / lasts < 0.1 and a["domain"] == b["domain"]:
        return CONJUNCT
    shared = _shared(a, b)
    if shared > 0:
        return PARALLEL
    return RELAYED if -shared < 1 else SERIAL if -shared < 10 else UNCLASSIFIED


class _Activity:
    """Trees of one session."""

    def __init__(self, columns: list[str], keys: list[int], cut_gap: float):
        self.columns, self.keys, self.cut_gap = columns, keys, cut_gap
        self.key = None
        self.nodes: dict[str, dict] = {}
        self.trees: list[dict[str, None]] = []       # node names in order; the first is the root
        self.known: list[dict[str, list[str]]] = []  # url -> its nodes in order, per tree
        self.places: dict[str, list[int]] = {}       # url -> trees that hold it, in order
        self.last = None

    def take(self, row):
        self.key = [row[i] for i in self.keys]
        node = dict(zip(self.columns, row))
        node.update(name=f"n{node['seq']}", parent=None, dummy=False, fake=True, children=0, last_class=None, pred_class=None)
        linked = False
        if self.last is not None:
            node["last_class"] = _pair_class(self.last, node)
            if node["last_class"] != UNCLASSIFIED:
                linked = self._follow(node) if node["ref"] is not None else self._append(node)
        if not linked:
            self._plant(node)
        self.last = node
        return ()

    def _add(self, tree: int, node, parent: str | None):
        self.nodes[node["name"]] = node
        node["parent"], node["kids"], node["place"] = parent, {}, len(self.nodes)
        if parent is not None:
            self.nodes[parent]["children"] += 1
            self.nodes[parent]["kids"][node["name"]] = None
        self._enter(tree, node)

    def _enter(self, tree: int, node):
        node["tree"] = tree
        self.trees[tree][node["name"]] = None
        if node["url"] is not None:
            names = self.known[tree].setdefault(node["url"], [])
            if not names:
                insort(self.places.setdefault(node["url"], []), tree)
            names.append(node["name"])

    def _leave(self, tree: int, node):
        del self.trees[tree][node["name"]]
        if node["url"] is not None:
            names = self.known[tree][node["url"]]
            names.remove(node["name"])
            if not names:
                del self.known[tree][node["url"]]
                self.places[node["url"]].remove(tree)

    def _plant(self, node):
        tree = len(self.trees)
        self.trees.append({})
        self.known.append({})
        parent = None
        if node["ref"] is not None:
            root = dict(node, name=f"d{node['seq']}", dummy=True, url=node["ref"], end=None, duration=None, ctype=None,
                        domain=None, children=0, last_class=None, pred_class=None)
            self._add(tree, root, None)
            parent = root["name"]
        self._add(tree, node, parent)

    def _append(self, node) -> bool:
        if node["last_class"] == SERIAL and abs(_shared(self.last, node)) >= self.cut_gap:
            return False
        node["pred_class"] = node["last_class"]
        self._add(self.last["tree"], node, self.last["name"])
        return True

    def _follow(self, node) -> bool:
        holders = self.places.get(node["ref"])
        if not holders:
            return False
        tree = holders[-1]
        page = self.nodes[self.known[tree][node["ref"]][-1]]
        node["fake"] = False
        node["pred_class"] = _pair_class(page, node)
        self._add(tree, node, page["name"])
        inner = page["name"] != next(iter(self.trees[tree])) and not page["fake"]
        if inner and "text" in (page["ctype"] or ""):
            full = page["children"] >= FAT_PAGE
            left = page["children"] >= SLIM_PAGE and (node["last_class"] == SERIAL or node["pred_class"] == UNCLASSIFIED)
            if full or left:
                self._cut(tree, page["name"])
        return True

    def _cut(self, tree: int, root: str):
        """Make the part of a tree under a node a tree of its own; only that part is touched."""
        top = self.nodes[root]
        above = self.nodes[top["parent"]]
        above["children"] -= 1
        del above["kids"][root]
        top["parent"] = None
        inside, left = [], [root]
        while left:
            name = left.pop()
            inside.append(self.nodes[name])
            left += self.nodes[name]["kids"]
        new = len(self.trees)
        self.trees.append({root: None})
        self.known.append({})
        for node in inside:
            self._leave(tree, node)
        for node in sorted(inside, key=lambda n: n["place"]):
            self._enter(new, node)

    def close(self):
        for names in self.trees:
            first = next(iter(names), None)
            for name in names:
                n = self.nodes[name]
                yield (*self.key, first, name, n["parent"], n["dummy"], n["t"], n["url"],
                       n["last_class"], n["pred_class"], n["fake"])


def activity_forest(sessions: DataFrame, keys: list[str], cut_gap: float = 3.0) -> DataFrame:
    """Edges of activity trees, one forest per key and session.

    ``sessions`` has the keys (session start among them), t (microseconds), seq, start, end, duration (seconds), domain,
    url, ref and ctype. A request unclassified against the one before starts a tree. With a referrer it joins the newest
    tree that holds it, and a text page inside a tree that has grown (five children, or two when the request is serial
    to the last one or unclassified against the page) is cut out with what hangs on it. Without referrer it hangs on the
    last request unless that is serial and ``cut_gap`` seconds away.
    """
    names = ["t", "seq", "start", "end", "duration", "domain", "url", "ref", "ctype"]
    rows = sessions.where(F.col("start").isNotNull()).select(*keys, *names)
    columns, at = rows.columns, list(range(len(keys)))
    schema = _key_ddl(sessions, keys) + EDGE + ", last_class INT, pred_class INT, fake BOOLEAN"
    return _streamed(rows, keys, ["t", "seq"], lambda: _Activity(columns, at, cut_gap), schema)


def split_forest(edges: DataFrame, text_nodes: DataFrame, min_children: int = 3) -> DataFrame:
    """Cut every text node with more than ``min_children`` children, roots aside, into a tree of its own.

    ``edges`` has tree, node and parent, ``text_nodes`` the nodes whose content is text. A node's new tree is its nearest
    ancestor (or itself) that is a root or cut; it is found by doubling the steps up, so a deep tree takes few rounds.
    """
    edges = settle(edges, "edges")
    wide = edges.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("_c")).where(
        F.col("_c") > min_children).join(text_nodes.select("node").distinct(), "node", "left_semi")
    tops = edges.join(wide, "node", "left").select("node", "parent", (F.col("parent").isNull() | F.col("_c").isNotNull()).alias("_top"))
    tops = settle(tops, "tops")
    # nodes whose way up has ended; only the others are carried into the next round
    done = tops.where("_top").select("node", F.col("node").alias("up"))
    moving = tops.where("NOT _top").select("node", F.col("parent").alias("up"))
    while True:
        known = done.select(F.col("node").alias("up"), F.col("up").alias("_next"), F.lit(True).alias("_end")).unionByName(
            moving.select(F.col("node").alias("up"), F.col("up").alias("_next"), F.lit(False).alias("_end")))
        moved = moving.join(known, "up", "left")
        moved = settle(moved.select("node", F.coalesce("_next", "up").alias("up"), F.coalesce("_end", F.lit(True)).alias("_end")), "steps")
        done = done.unionByName(moved.where("_end").select("node", "up"))
        moving = moved.where("NOT _end").select("node", "up")
        if moving.isEmpty():
            break
    return edges.join(done, "node").join(tops.select("node", "_top"), "node").select(
        *[c for c in edges.columns if c not in ("tree", "parent")], F.col("up").alias("tree"),
        F.when(~F.col("_top"), F.col("parent")).alias("parent"))


def tree_measures(edges: DataFrame, keys: list[str] = [], end: str | None = None) -> DataFrame:
    """Start, end and size of every tree."""
    out = [F.min("t").alias("start"), F.count("*").alias("nodes"), F.count_if(~F.col("dummy")).alias("requests")]
    if end:
        out.append(F.max(end).alias("end"))
    return edges.groupBy(*keys, "tree").agg(*out)


def tree_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of every tree in time order, the dummy first."""
    return edges.repartitionByRange("tree", "t").sortWithinPartitions("tree", "t", F.desc("dummy"), "node")
