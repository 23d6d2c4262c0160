"""Registered queries on what only larger tables have."""

from __future__ import annotations

import random

import duckdb

from docloom.operators import graph, joins
from docloom.plans import ORACLES, QUERIES
from docloom.sources import shared


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_sql(name, sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    return sorted(con.sql(ORACLES[name]).fetchall())


def test_years_of_any_length(spark, tmp_path):
    ids = [0, 99_999, 2_913_000, 2_914_000, 5_999_999, 106_000_000, -500_000, -740_000, -750_000, -1_000_000]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(QUERIES["dt6_epoch"](spark, str(tmp_path)))
    assert got == by_sql("dt6_epoch", tmp_path, "events")
    assert dict(got)[5_999_999] == "18451-05-02T11:13:19" and dict(got)[-500_000].startswith("0") and dict(got)[-1_000_000].startswith("-")


def test_pages_of_one_url_go_by_page_id(spark, tmp_path):
    pages = [(4 * n + 1, "http://a.example/x") for n in range(40)]
    spark.createDataFrame(pages[::-1], "page_id long, url string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert rows(QUERIES["s8_fetch_plan"](spark, str(tmp_path))) == [(p, "fetch", n // 2) for n, (p, _) in enumerate(pages)]


def made(df):
    """The most rows that an operator of df's plan has made."""
    df.collect()

    def most(node):
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ResultQueryStageExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec"):
            return most(node.executedPlan() if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else node.plan())
        rows_, below = node.metrics().get("numOutputRows"), node.children()
        return max([rows_.get().value() if rows_.isDefined() else 0] + [most(below.apply(i)) for i in range(below.size())])

    return most(df._jdf.queryExecution().executedPlan())


def test_smallest_scopes_without_pairs(spark):
    r = random.Random(3)
    scopes = [(n % 2, 5 * n, s, s + r.choice([0, 1, 2, 7, 64, 90, 300])) for n in range(2000) for s in [r.randint(-150, 150)]]
    points = [(n, n % 3, r.randint(-200, 400)) for n in range(2000)]
    best = {(g, at): min(((e - s, i) for h, i, s, e in scopes if h == g and s <= at < e), default=None) for _, g, at in points}
    p, q = spark.createDataFrame(points, "k long, g long, at long"), spark.createDataFrame(scopes, "g long, id long, s long, e long")
    for width in (1, 2, 90, 128):
        got = joins.smallest_enclosing(p, q, ["g"], width, "at", ["k"], ("s", "e"), "id")
        assert rows(got) == sorted((k, best[g, at][1]) for k, g, at in points if best[g, at])
    # 4,000,000 / 3 pairs are of one g; a scope has 13 blocks of up to 64 or so
    assert made(joins.smallest_enclosing(p, q, ["g"], 90, "at", ["k"], ("s", "e"), "id")) < 40_000


def test_strong_components_keep_no_old_rounds(spark):
    since = shared.mark()
    edges = spark.createDataFrame([(n, n - 1) for n in range(1, 40)] + [(0, 3), (50, 50)], "src long, dst long")
    assert rows(graph.strong_components(edges)) == [(n, 0 if n < 4 else n) for n in [*range(40), 50]]
    assert shared.mark() - since <= 3  # nodes, the last edges, the last pairs


def components_of(edges):
    out = {n: [b for a, b in edges if a == n] for e in edges for n in e}
    reach = {}
    for n in out:
        reach[n], todo = {n}, [n]
        while todo:
            new = set(out[todo.pop()]) - reach[n]
            reach[n] |= new
            todo += new
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in out)


def test_strong_components_without_pairs(spark, monkeypatch):
    written = []

    def counted(df, name):
        table = shared.stored(df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(graph, "stored", counted)
    # a cycle of 300, a chain of 300 into it, one of 300 out of it that branches back to its own middle
    cycle = [(n, (n + 1) % 300) for n in range(300)]
    edges = [*cycle, *((n, n + 1) for n in range(1000, 1300)), (1300, 7), (20, 2000), *((n, n + 1) for n in range(2000, 2300)), (2300, 2150), (2300, 2301), (2301, 2300)]
    assert rows(graph.strong_components(spark.createDataFrame(edges, "src long, dst long"))) == components_of(edges)
    assert max(written) < 2 * len(edges)  # the closure of the cycle alone has 90,000 pairs


def test_strong_components_by_colour(spark, monkeypatch):
    by_colour, parted = graph._by_colour, []
    monkeypatch.setattr(graph, "_by_colour", lambda core, rounds: parted.append(core.count()) or by_colour(core, rounds))
    # groups of five, each node with an edge to all others of its group, in a line, and a group that no other reaches
    edges = [(5 * g + a, 5 * g + b) for g in (3, 1, 2, 0) for a in range(5) for b in range(5) if a != b] + [(0, 16), (17, 8), (9, 11), (4, 100), (100, 100)]
    assert rows(graph.strong_components(spark.createDataFrame(edges, "src long, dst long"))) == components_of(edges)
    assert parted


def test_orders_without_a_customer(spark, tmp_path):
    orders = [(1, 2), (2, 1), (3, None), (None, 4), (4, 4), (5, 1), (1, 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert rows(QUERIES["g6_strong_components"](spark, str(tmp_path))) == by_sql("g6_strong_components", tmp_path, "orders")
