"""Bounded graph operators over edge tables. Frontiers are joined with the edges level by level; only new nodes go on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import clear, discard, mark, stored


def edges_where(edges: DataFrame, src: object = None, dst: object = None, kind: str | None = None, min_weight: float | None = None) -> DataFrame:
    """Edges by any of source, target, type and least weight; rows without a weight don't meet a least one."""
    for column, value in (("src", src), ("dst", dst), ("type", kind)):
        if value is not None:
            edges = edges.filter(F.col(column) == value)
    return edges if min_weight is None else edges.filter(F.col("weight") >= min_weight)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None, allowed: Column | None = None, limit: int = 64) -> DataFrame:
    """node, dist: nodes at most depth steps from seeds(node) along edges(src, dst), with the least number of steps.

    Without a depth it goes on until no node is new (a cycle ends it), up to limit steps."""
    steps = (edges if allowed is None else edges.filter(allowed)).select("src", "dst").distinct()
    seen = stored(seeds.select("node").distinct().withColumn("dist", F.lit(0)), "reach")
    frontier = seen
    for d in range(1, (limit if depth is None else depth) + 1):
        near = frontier.select(F.col("node").alias("src")).join(steps, "src").select(F.col("dst").alias("node")).distinct()
        frontier = stored(near.join(seen.select("node"), "node", "left_anti").withColumn("dist", F.lit(d)), "reach")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    if depth is None:
        raise ValueError(f"more than {limit} steps; give a larger limit")
    return seen


def ball(edges: DataFrame, seeds: DataFrame, depth: int, since: str | None = None, min_weight: float | None = None) -> DataFrame:
    """Edges met going depth steps from the seeds in either direction, one for each pair of nodes (the earliest, then heaviest).

    since drops undated and older edges, min_weight those without a weight or with a smaller one."""
    kept = edges
    if since is not None:
        kept = kept.filter(F.col("date") >= F.lit(since).cast(edges.schema["date"].dataType))
    if min_weight is not None:
        kept = kept.filter(F.col("weight") >= min_weight)
    inner = reach(both_ways(kept.select("src", "dst")), seeds, depth - 1).select("node") if depth > 0 else seeds.select("node").limit(0)
    out = kept.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").unionByName(kept.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*kept.columns))
    pair = out.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return pair.groupBy("a", "b").agg(F.min("date").alias("date"), F.max("weight").alias("weight"))


def induced(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """All edges between nodes at most depth steps from the seeds, in either direction."""
    nodes = stored(reach(both_ways(edges.select("src", "dst")), seeds, depth).select("node"), "induced")
    return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi").select(*edges.columns)


def dated_hops(edges: DataFrame, seeds: DataFrame, depth: int, as_at: str) -> DataFrame:
    """Outgoing edges no later than a date, along up to depth hops from the seeds; parallel edges stay."""
    live = edges.filter(F.col("date") <= F.lit(as_at).cast(edges.schema["date"].dataType))
    from_ = reach(live, seeds, depth - 1).select(F.col("node").alias("src"), F.col("dist").alias("hop"))
    return live.join(from_, "src")


def closure(edges: DataFrame, limit: int = 32) -> DataFrame:
    """node, ancestor of every path along edges(child, parent), each node among its own. Paths double in length each round."""
    pairs = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    nodes = pairs.select("node").union(pairs.select("ancestor")).distinct()
    now = stored(pairs.unionByName(nodes.select("node", F.col("node").alias("ancestor"))).distinct(), "closure")
    n = now.count()
    for _ in range(limit):
        before = now
        on = now.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        now = stored(now.join(on, "ancestor").select("node", F.col("next").alias("ancestor")).distinct(), "closure")
        discard(before)  # one round's pairs at a time
        m = now.count()
        if m == n:
            return now
        n = m
    raise ValueError("paths are longer than 2 ^ limit")


def ancestor_distance(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, ancestor, dist: the least number of steps along edges(child, parent); 0 to itself."""
    steps = edges.select("child", "parent").distinct()
    nodes = steps.select(F.col("child").alias("node")).union(steps.select("parent")).distinct()
    seen = stored(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")), "distance")
    frontier = seen
    for d in range(1, limit + 1):
        near = frontier.join(steps, frontier.ancestor == steps.child).select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = stored(near.join(seen, ["node", "ancestor"], "left_anti").withColumn("dist", F.lit(d)), "distance")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise ValueError("paths are longer than the limit")


def nearest_common(distance: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, ancestor with the least summed distance (ties: the smaller id) for pairs(a, b)."""
    up = distance.select("node", "ancestor", "dist")
    x = pairs.join(up, pairs.a == up.node).select("a", "b", "ancestor", F.col("dist").alias("da"))
    y = up.select(F.col("node").alias("b"), "ancestor", F.col("dist").alias("db"))
    return x.join(y, ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", F.struct(F.col("da") + F.col("db"), F.col("ancestor"))).alias("ancestor"))


def strong_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component (smallest node that it reaches and that reaches it) of edges(src, dst).

    Nodes that nothing enters or leaves are alone in theirs and are trimmed, up to rounds times, while that
    takes half of the edges. Then nodes of one exit go to where their chains end, in steps that double; what
    has no such nodes is parted by colours. No pairs of nodes are made but edges."""
    since = mark()
    core = stored(edges.select("src", "dst").filter("src <> dst").distinct(), "strong")
    found = _in_cycles(core, rounds)
    found = stored(found.join(found.groupBy("low").agg(F.min("node").alias("component")), "low").select("node", "component"), "strong")
    clear(edges.sparkSession, since, [found])
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node is not null").distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _in_cycles(core: DataFrame, rounds: int) -> DataFrame:
    """node, low (one member for all of a component) of the nodes on cycles, and of some others, for distinct edges without loops.

    core is a stored() table that nothing else reads; its files may go."""
    n = core.count()
    for _ in range(rounds):
        before = core
        entered, left = core.select(F.col("dst").alias("src")).distinct(), core.select(F.col("src").alias("dst")).distinct()
        core = stored(core.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "strong")
        discard(before)  # one table of edges at a time
        m, n = n, core.count()
        if 2 * n > m or not n:
            break
    if not n:
        return core.select(F.col("src").alias("node"), F.col("dst").alias("low"))
    one = lambda side: core.groupBy(side).count().agg(F.count_if(F.col("count") == 1), F.count("*")).first()
    (out, all_), (in_, others) = one("src"), one("dst")
    # Components are the same with all edges turned round. Fewer than a 16th would take too many rounds.
    if 16 * max(out, in_) < max(all_, others):
        return _by_colour(core, rounds)
    return _by_single_exits(core if out >= in_ else core.select(F.col("dst").alias("src"), F.col("src").alias("dst")), rounds)


def _by_single_exits(core: DataFrame, rounds: int) -> DataFrame:
    """_in_cycles() where many nodes have one exit. A component holds such a node only with the next one, so a chain's way in may lead to its end."""
    single = stored(core.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("to")).filter("n = 1").select(F.col("src").alias("node"), "to"), "exits")
    # After k rounds: 2^k steps on, or where a chain has ended outside; low is the least node passed.
    inside = single.select(F.col("node").alias("to"), F.lit(True).alias("_in"))
    now = stored(single.join(inside, "to", "left").select("node", "to", F.col("_in").isNull().alias("ended"), F.col("node").alias("low")), "exits")
    steps, seen = [now], None
    while True:
        on = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("ended").alias("_ended"), F.col("low").alias("_low"))
        far = now.filter("not ended").join(on, "to").select("node", F.col("_to").alias("to"), F.col("_ended").alias("ended"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("moved"))
        now = stored(far.unionByName(now.filter("ended").withColumn("moved", F.lit(False))), "exits")
        going = F.when(~F.col("ended"), F.col("to"))
        state = now.agg(F.count(going), F.count_distinct(going), F.count_if("moved")).first()
        # Where the ends of endless chains get no fewer, they are the nodes of their cycles.
        if not state[0] or (state[:2] == seen and not state[2]):
            break
        seen = state[:2]
        steps.append(now)
    found = stored(now.filter("not ended").select(F.col("to").alias("node")).distinct().join(now, "node").select("node", "low"), "strong")
    many = core.join(single, core.src == single.node, "left_anti")
    moved = many.join(now.select(F.col("node").alias("dst"), F.col("to").alias("_to"), "ended"), "dst", "left").filter("ended is null or ended").select("src", F.coalesce("_to", "dst").alias("dst"))
    rest = stored(moved.filter("src <> dst").distinct(), "strong")
    inner = _in_cycles(rest, rounds)
    # A chain's node is in the component of its end if something of that component enters the chain there or before.
    low = lambda side: inner.select(F.col("node").alias(side), F.col("low").alias(f"_{side}"))
    entered = many.join(now.filter("ended").select(F.col("node").alias("dst"), "to"), "dst").join(low("src"), "src", "left").join(low("to"), "to", "left")
    entered = entered.withColumn("low", F.coalesce("_to", "to")).filter(F.coalesce("_src", "src") == F.col("low")).select(F.col("dst").alias("node"), "low")
    entered = stored(entered.distinct(), "entered")
    if entered.isEmpty():
        return found.unionByName(inner)
    for step in steps:
        on = entered.join(step.filter("not ended").select("node", "to"), "node").select(F.col("to").alias("node"), "low")
        entered = stored(entered.unionByName(on).distinct(), "entered")
    ends = entered.select(F.col("low").alias("node"), "low")
    return found.unionByName(stored(inner.unionByName(entered).unionByName(ends).distinct(), "strong"))


def _colours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, colour (the least by hash of the nodes that reach it, itself included), stored, for nodes(node)."""
    colour = stored(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("v")).alias("colour"), F.lit(True).alias("moved")), "colours")
    while True:
        before = colour
        come = edges.join(colour.filter("moved").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("_come"))
        near = stored(colour.join(come, "node", "left").select("node", F.least("colour", "_come").alias("colour"), F.coalesce(F.col("_come") < F.col("colour"), F.lit(False)).alias("moved")), "colours")
        # What reaches the node that gave a colour reaches those that have it.
        far = near.select(F.col("node").alias("_v"), F.col("colour").alias("_far"))
        colour = stored(near.join(far, F.col("colour.v") == F.col("_v")).select("node", F.least("colour", "_far").alias("colour"), (F.col("moved") | (F.col("_far") < F.col("colour"))).alias("moved")), "colours")
        discard(before)
        discard(near)
        if colour.filter("moved").isEmpty():
            return colour.select("node", "colour")


def _by_colour(core: DataFrame, rounds: int) -> DataFrame:
    """_in_cycles() by colours along the edges and, within each, against them. Nodes whose two are the same are the component of that node; the others go on."""
    nodes = core.select(F.col("src").alias("node")).union(core.select("dst")).distinct()
    fore = _colours(nodes, core)
    within = lambda edges, colour: edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("_c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_d")), "dst").filter("_c = _d").select("src", "dst")
    kept = stored(within(core, fore), "strong")
    discard(core)
    back = _colours(fore.select("node"), kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = stored(fore.join(back, ["node", "colour"]).select("node", F.col("colour.v").alias("low")), "strong")
    left = within(kept, back).join(found.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti")
    left = stored(left.select("src", "dst"), "strong")
    for table in (kept, fore, back):
        discard(table)
    return found.unionByName(_in_cycles(left, rounds))


#: Neighbours of a hub that travel under one key.
HUB_ROWS = 256


def _beside_least(pairs: DataFrame, n: int) -> DataFrame:
    """u, v, low of pairs(u, v): the smallest v of each u beside every pair. n is about the number of pairs.

    Pairs are keyed by u and a part of v's hash, so that a hub's are spread over tasks; what meets under u
    alone is one number for each part."""
    if n < 2 * HUB_ROWS:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("low")), "u")
    keyed = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(n // HUB_ROWS)))
    own = stored(keyed.groupBy("u", "part").agg(F.min("v").alias("m")), "least")
    where = own.join(own.groupBy("u").agg(F.min("m").alias("low")), "u").select("u", "part", "low")
    return keyed.join(where, ["u", "part"]).select("u", "v", "low")


def components(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, component (smallest node connected with it in either direction) of every node with an edge to another, by stars that shrink each round."""
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct(), "components")
    n, mark_ = now.count(), None
    for _ in range(limit):
        since = mark()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of a node go to the smallest node around it, itself included.
        large = stored(_beside_least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct(), "large-star")
        # Small star: a node and its smaller neighbours go to the smallest of them.
        small = _beside_least(large, n).select(F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v"))
        after = stored(small.filter("u <> v").distinct(), "components")
        seen = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        clear(spark, since, [after])
        discard(now)
        now, n = after, seen[0]
        if seen == mark_:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark_ = seen
    raise ValueError("more rounds than the limit")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Edges of a graph without cycles that no longer path implies; a cycle is an error."""
    e = edges.select("src", "dst").distinct()
    up = closure(e.select(F.col("src").alias("child"), F.col("dst").alias("parent"))).filter("node <> ancestor")
    if not e.filter("src = dst").isEmpty() or not up.join(up.select(F.col("ancestor").alias("node"), F.col("node").alias("ancestor")), ["node", "ancestor"]).isEmpty():
        raise ValueError("the graph has a cycle")
    implied = e.select("src", F.col("dst").alias("_m")).join(up.select(F.col("node").alias("_m"), F.col("ancestor").alias("dst")), "_m").select("src", "dst").distinct()
    return e.join(implied, ["src", "dst"], "left_anti")


def disjointness(subclass: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Classes under both sides of a pair: node, a, b, culprit (no parent of it violates the same pair), over subclass(child, parent), disjoint(a, b)."""
    up = closure(subclass)
    left = up.join(disjoint, up.ancestor == disjoint.a).select("node", "a", "b")
    right = up.select("node", F.col("ancestor").alias("b"))
    bad = stored(left.join(right, ["node", "b"]).select("node", "a", "b").distinct(), "disjoint")
    through = subclass.join(bad.select(F.col("node").alias("parent"), "a", "b"), "parent").filter("child <> parent").select(F.col("child").alias("node"), "a", "b").distinct()
    return bad.join(through.withColumn("_t", F.lit(True)), ["node", "a", "b"], "left").select("node", "a", "b", F.col("_t").isNull().alias("culprit"))


def mixed_order(instance_of: DataFrame, subclass_of: DataFrame) -> DataFrame:
    """Nodes that are instances of something and take part in the subclass order."""
    ordered = subclass_of.select(F.col("child").alias("node")).union(subclass_of.select(F.col("parent").alias("node")))
    return instance_of.select(F.col("child").alias("node")).distinct().join(ordered.distinct(), "node", "left_semi")


def longest_paths(edges: DataFrame, limit: int = 64) -> DataFrame:
    """node, depth: edges on the longest path from a source, in a graph without cycles."""
    e = edges.select("src", "dst").distinct()
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    now = stored(nodes.withColumn("depth", F.lit(0)), "depths")
    for _ in range(limit):
        through = e.join(now.select(F.col("node").alias("src"), F.col("depth").alias("_d")), "src").groupBy(F.col("dst").alias("node")).agg((F.max("_d") + 1).alias("_d"))
        after = stored(now.join(through, "node", "left").select("node", F.greatest("depth", F.coalesce("_d", F.lit(0))).alias("depth")), "depths")
        if after.agg(F.sum("depth")).first()[0] == now.agg(F.sum("depth")).first()[0]:
            return after
        now = after
    raise ValueError("a cycle, or paths longer than the limit")


#: Fixed values of treatment ranking.
COURT_RANK = {"HCA": 5, "FCA": 4, "SC": 3, "DC": 2.5, "MAG": 2}
RELATION = {"FOLLOWS": 3, "APPLIES": 2, "CONSIDERS": 1, "DISTINGUISHES": -1, "OVERRULES": -3}


def treatment_score(court_rank: Column, relation: Column, years: Column, jurisdiction: Column, posture: Column) -> Column:
    """Product of court rank, relation weight, exp(-years / 6) (undated: 1), jurisdiction and posture factors."""
    return court_rank * relation * F.coalesce(F.exp(-years / 6), F.lit(1.0)) * jurisdiction * posture


def cone(edges: DataFrame, seeds: DataFrame, kinds: Sequence[str], limit: int = 32) -> DataFrame:
    """One row: visited, selectivity (walked edges by all that leave visited nodes) and leakage (those of other kinds)."""
    ok = F.col("type").isin(*kinds)
    nodes = stored(reach(edges, seeds, allowed=ok, limit=limit).select("node"), "cone")
    out = edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", "type")
    return out.agg(F.count("*").alias("_n"), F.count_if(ok).alias("_ok")).crossJoin(nodes.agg(F.count("*").alias("visited"))).select("visited", F.round(F.col("_ok") / F.greatest(F.lit(1), "_n"), 6).alias("selectivity"), F.round((F.col("_n") - F.col("_ok")) / F.greatest(F.lit(1), "_n"), 6).alias("leakage"))


def infer(facts: DataFrame, rules: Sequence[tuple[str, str, str]], limit: int = 32) -> DataFrame:
    """facts(s, p, o) with all that rules (p, q, r) derive from them: s p x and x q o give s r o. Each round joins only what the last one has found."""
    known = stored(facts.select("s", "p", "o").distinct(), "facts")
    new = known
    table = known.sparkSession.createDataFrame([*rules], "p1 string, p2 string, p3 string")
    for _ in range(limit):
        left = lambda d: d.select("s", F.col("p").alias("p1"), F.col("o").alias("x"))
        right = lambda d: d.select(F.col("s").alias("x"), F.col("p").alias("p2"), "o")
        ruled = lambda a, b: left(a).join(F.broadcast(table), "p1").join(right(b), ["x", "p2"]).select("s", F.col("p3").alias("p"), "o")
        found = ruled(new, known).unionByName(ruled(known, new)).distinct()
        new = stored(found.join(known, ["s", "p", "o"], "left_anti"), "facts")
        if new.isEmpty():
            return known
        known = stored(known.unionByName(new), "facts")
    raise ValueError("more rounds than the limit")
