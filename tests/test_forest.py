"""Forests against a plain model of the rules."""

import random

from pyspark.sql import functions as F

from airtrail.checks.tables import SUFFIXES
from airtrail.functions.spans import classify_pair
from airtrail.operators import forest, stats


def walk_referrers(rows, idle):
    trees, edges = [], {}
    for t, seq, url, ref in rows:
        tree = None
        for cand in reversed(trees):
            if t - max(x[0] for x in cand["nodes"]) <= idle:
                if ref is None:
                    break
                if any(u == ref for _, u, _ in cand["nodes"]):
                    tree = cand
                    break
        if tree is None:
            tree = {"nodes": [], "name": f"d{seq}" if ref is not None else f"n{seq}"}
            trees.append(tree)
            parent = None
            if ref is not None:
                tree["nodes"].append((t, ref, f"d{seq}"))
                edges[f"d{seq}"] = (tree["name"], None)
                parent = f"d{seq}"
        else:
            parent = [n for _, u, n in tree["nodes"] if u == ref][-1]
        tree["nodes"].append((t, url, f"n{seq}"))
        edges[f"n{seq}"] = (tree["name"], parent)
    return edges


def test_referrer_forest_matches_walk(spark):
    r, rows = random.Random(6), []
    t = 0
    for i in range(300):
        t += r.choice([1, 1, 2, 8, 30])
        rows.append(("k", t, i, r.choice("abcdefgh"), r.choice([None, *"abcdefghxy"])))
    df = spark.createDataFrame(rows, "agent STRING, t LONG, seq LONG, url STRING, ref STRING")
    got = {e.node: (e.tree, e.parent) for e in forest.referrer_forest(df, ["agent"], 20).collect()}
    assert got == walk_referrers([x[1:] for x in rows], 20)


def test_pair_class_same_in_both_forms(spark):
    r = random.Random(7)
    rows = []
    for i in range(400):
        s1 = r.choice([0.0, 0.3, 1.0, 4.0])
        s2 = s1 + r.choice([0.0, 0.2, 0.6, 1.5, 9.0, 20.0])
        rows.append((i, s1, r.choice([None, s1 + 0.05, s1 + 1.0]), r.choice([None, 0.0, 1.0, 0.2]), r.choice("ab"), s2, r.choice([None, s2 + 0.05, s2 + 1.0]), r.choice([None, 0.0, 1.0]), r.choice("ab")))
    df = spark.createDataFrame(rows, "i INT, s1 DOUBLE, e1 DOUBLE, d1 DOUBLE, m1 STRING, s2 DOUBLE, e2 DOUBLE, d2 DOUBLE, m2 STRING")
    side = [F.struct(F.col(f"s{k}").alias("start"), F.col(f"e{k}").alias("end"), F.col(f"d{k}").alias("duration"), F.col(f"m{k}").alias("domain")) for k in (1, 2)]
    got = {x.i: x.c for x in df.select("i", classify_pair(*side).alias("c")).collect()}
    names = ["start", "end", "duration", "domain"]
    assert got == {x[0]: forest._pair_class(dict(zip(names, x[1:5])), dict(zip(names, x[5:9]))) for x in rows}
    assert set(got.values()) == {1, 2, 3, 4, 9}


SCHEMA = "s LONG, t LONG, seq LONG, start DOUBLE, end DOUBLE, duration DOUBLE, domain STRING, url STRING, ref STRING, ctype STRING"


def entry(seq, start, url, ref=None, ctype="text/html"):
    return (0, int(start * 1e6), seq, float(start), start + 0.2, 0.2, "d", url, ref, ctype)


def run(spark, rows, gap=3.0):
    out = forest.activity_forest(spark.createDataFrame(rows, SCHEMA), ["s"], gap).collect()
    return {x.node: (x.tree, x.parent) for x in out}


def test_activity_links_and_breaks(spark):
    got = run(spark, [entry(1, 0, "a"), entry(2, 0.5, "b", "a"), entry(3, 1.5, "c"), entry(4, 30, "d"), entry(5, 31, "e", "zz"), entry(6, 36, "f")])
    assert got["n1"] == ("n1", None) and got["n2"] == ("n1", "n1")
    assert got["n3"] == ("n1", "n2")          # no referrer, soon after: hangs on the last request
    assert got["n4"] == ("n4", None)          # long silence
    assert got["d5"] == ("d5", None) and got["n5"] == ("d5", "d5")
    assert got["n6"] == ("n6", None)          # serial and further away than the cut gap


def test_activity_cuts_fat_page(spark):
    rows = [entry(1, 0, "root"), entry(2, 0.3, "page", "root")] + [entry(3 + i, 0.6 + i * 0.1, f"x{i}", "page", "image/png") for i in range(5)]
    got = run(spark, rows)
    assert got["n2"] == ("n2", None) and {got[f"n{3 + i}"] for i in range(5)} == {("n2", "n2")}
    assert got["n1"] == ("n1", None)


def test_split_forest_takes_nearest_cut(spark):
    edges = [("r", "r", None)] + [("r", "a", "r")] + [("r", f"a{i}", "a") for i in range(4)] + [("r", f"b{i}", "a0") for i in range(4)] + [("r", "c", "b0")]
    df = spark.createDataFrame(edges, "tree STRING, node STRING, parent STRING")
    text = spark.createDataFrame([("r",), ("a",), ("a0",), ("b0",)], "node STRING")
    got = {x.node: (x.tree, x.parent) for x in forest.split_forest(df, text).collect()}
    assert got["a"] == ("a", None) and got["a0"] == ("a0", None) and got["a1"] == ("a", "a")
    assert got["c"] == ("a0", "b0") and got["r"] == ("r", None)


def test_evaluation_means(spark):
    p = spark.createDataFrame([("u", 1, "x"), ("u", 1, "y"), ("u", 2, "z"), ("w", 1, "q")], "agent STRING, tree INT, entity STRING")
    t = spark.createDataFrame([("u", 9, "x"), ("u", 9, "y"), ("u", 8, "q"), ("v", 1, "x")], "agent STRING, tree INT, entity STRING")
    assert [(r.agent, r.score, r.trees) for r in stats.evaluate_forest(p, t).collect()] == [("u", 0.5, 2)]


def test_activity_scores(spark):
    """Two pages of one agent with their pictures, a click before each: both bursts are found whole; a burst without click does not count."""
    from airtrail import schemas
    from airtrail.plans import jobs

    names = schemas.names(schemas.HTTP)
    rows = []

    def ask(seq, at, path, referrer, agent="browser"):
        row = dict.fromkeys(names)
        row.update(source_ip="10.0.0.1", source_port=1, dest_ip="192.0.2.1", dest_port=80, connection="unique", request_ts=at, request_time=0.01, response_ts=at + 0.05,
                   response_time_end=0.1, request_host="site.example", request_url=path, request_referer=referrer, request_user_agent=agent, response_content_type="text/html")
        rows.append((*[row[n] for n in names], seq))

    for base, page in ((100.0, "/a"), (200.0, "/b"), (300.0, "/c")):
        ask(len(rows), base, page, None)
        for i in range(2):
            ask(len(rows), base + 0.3 + i / 10, f"{page}/{i}.png", f"http://site.example{page}")
    http = spark.createDataFrame(rows, schemas.HTTP + ", seq LONG")
    clicks = spark.createDataFrame([("10.0.0.1", 99_500_000), ("10.0.0.1", 199_000_000)], "source_ip STRING, click LONG")
    got = jobs.evaluate_activity(http, clicks, ["source_ip"], SUFFIXES).first()
    assert (got.agents, got.score, got.agents_above_0, got.score_above_0) == (1, 1.0, 1, 1.0)
