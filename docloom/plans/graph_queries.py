"""Graph operators over edges drawn from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from .registry import query

#: Part to supplier, dated and weighted; a supplier's node number is its key plus a million.
E = "(SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, l_shipdate AS date, l_extendedprice AS weight, l_returnflag AS type FROM lineitem)"
#: A hierarchy: every part below the parts of a third and a fifth of its number.
H = "(SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey > 0)"
#: A graph with cycles.
C = "(SELECT DISTINCT o_orderkey AS src, o_custkey AS dst FROM orders)"
UP = f"up(node, ancestor) AS (SELECT child, child FROM {H} UNION SELECT parent, parent FROM {H} UNION SELECT up.node, h.parent FROM up JOIN {H} h ON h.child = up.ancestor)"


def edges(read):
    return read("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst"), F.col("l_shipdate").alias("date"), F.col("l_extendedprice").alias("weight"), F.col("l_returnflag").alias("type"))


def hierarchy(read):
    p = read("part").filter("p_partkey > 0")  # 0 is the root
    return p.select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")).union(p.select("p_partkey", F.expr("p_partkey div 5"))).distinct()


def cyclic(read):
    return read("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")).distinct()


def seeds(read, *nodes):
    return read("part").sparkSession.createDataFrame([(n,) for n in nodes], "node long")


@query("g1_edge_lookup", f"SELECT src, dst, count(*) AS n FROM {E} WHERE type = 'R' AND weight >= 90000 GROUP BY 1, 2")
def g1(read):
    return G.edges_where(edges(read), kind="R", min_weight=90000).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g2_order_graph", "SELECT kind, count(*) AS n, round(sum(weight), 2) AS weight FROM (SELECT 'placed' AS kind, o_totalprice AS weight FROM orders UNION ALL SELECT 'holds', l_quantity FROM lineitem) GROUP BY kind")
def g2(read):
    e = read("orders").select(F.lit("placed").alias("kind"), F.col("o_totalprice").alias("weight")).unionByName(read("lineitem").select(F.lit("holds").alias("kind"), F.col("l_quantity").alias("weight")))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


W = f"(SELECT * FROM {E} WHERE weight >= 80000 AND date >= TIMESTAMP '1997-01-01')"


@query("g3_ball", f"""
WITH RECURSIVE k AS MATERIALIZED (SELECT * FROM {W}), u AS MATERIALIZED (SELECT DISTINCT src, dst FROM k UNION SELECT dst, src FROM k),
b(node, d) AS (SELECT 7::BIGINT, 0 UNION SELECT u.dst, d + 1 FROM b JOIN u ON u.src = b.node WHERE d < 1),
n AS (SELECT DISTINCT node FROM b)
SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS edges FROM k WHERE src IN (SELECT node FROM n) OR dst IN (SELECT node FROM n) GROUP BY 1, 2""".replace("count(*) AS edges", "max(weight) AS weight"))
def g3(read):
    return G.ball(edges(read), seeds(read, 7), 2, since="1997-01-01", min_weight=80000).select("a", "b", "weight")


@query("g3_induced", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {E} WHERE weight >= 95000), u AS MATERIALIZED (SELECT DISTINCT src, dst FROM e UNION SELECT dst, src FROM e),
b(node, d) AS (SELECT 7::BIGINT, 0 UNION SELECT 1000005, 0 UNION SELECT u.dst, d + 1 FROM b JOIN u ON u.src = b.node WHERE d < 2)
SELECT src, dst, count(*) AS n FROM e WHERE src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b) GROUP BY 1, 2""")
def g3b(read):
    return G.induced(edges(read).filter("weight >= 95000"), seeds(read, 7, 1000005), 2).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g4_dated_hops", f"""
WITH RECURSIVE live AS MATERIALIZED (SELECT o_custkey AS src, o_orderkey + 1000000 AS dst, o_orderdate AS date FROM orders UNION ALL SELECT l_orderkey + 1000000, l_partkey + 10000000, l_shipdate FROM lineitem),
ok AS MATERIALIZED (SELECT * FROM live WHERE date <= TIMESTAMP '1998-06-01'),
r(node, d) AS (SELECT 12::BIGINT, 0 UNION SELECT 13, 0 UNION SELECT dst, d + 1 FROM r JOIN ok ON src = node WHERE d < 1)
SELECT src, dst, min(d) AS hop, count(*) AS n FROM ok JOIN (SELECT node, min(d) AS d FROM r GROUP BY 1) ON src = node GROUP BY 1, 2""")
def g4(read):
    live = read("orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1000000).alias("dst"), F.col("o_orderdate").alias("date")).unionByName(read("lineitem").select((F.col("l_orderkey") + 1000000).alias("src"), (F.col("l_partkey") + 10000000).alias("dst"), F.col("l_shipdate").alias("date")))
    return G.dated_hops(live, seeds(read, 12, 13), 2, "1998-06-01").groupBy("src", "dst").agg(F.min("hop").alias("hop"), F.count("*").alias("n"))


@query("g5_hit_degrees", f"SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {E} WHERE type = 'R' UNION ALL SELECT dst FROM {E} WHERE type = 'R') GROUP BY node ORDER BY degree DESC, node LIMIT 300")
def g5(read):
    e = G.both_ways(edges(read).filter("type = 'R'").select("src", "dst"))
    return e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(300)


@query("g6_strong_components", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {C}), r(a, b) AS (SELECT src, src FROM e UNION SELECT dst, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def g6(read):
    return G.strong_components(cyclic(read))


@query("g7_components", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {C} WHERE src <> dst UNION SELECT dst, src FROM {C} WHERE src <> dst),
r(node, component) USING KEY (node) AS (SELECT DISTINCT src, src FROM e UNION (SELECT e.dst, min(r.component) FROM r JOIN e ON e.src = r.node JOIN recurring.r AS k ON k.node = e.dst WHERE r.component < k.component GROUP BY 1))
SELECT node, component FROM r""")
def g7(read):
    return G.components(cyclic(read))


@query("g8_closure", f"WITH RECURSIVE {UP} SELECT node, ancestor FROM up")
def g8(read):
    return G.closure(hierarchy(read))


@query("g9_ancestor_distance", f"WITH RECURSIVE d(node, ancestor, dist) AS (SELECT child, child, 0 FROM {H} UNION SELECT parent, parent, 0 FROM {H} UNION SELECT d.node, h.parent, dist + 1 FROM d JOIN {H} h ON h.child = d.ancestor WHERE dist < 12 AND h.child <> h.parent) SELECT node, ancestor, min(dist) AS dist FROM d GROUP BY 1, 2")
def g9(read):
    return G.ancestor_distance(hierarchy(read))


@query("g10_disjointness", f"""
WITH RECURSIVE {UP}, p(a, b) AS (VALUES (3, 5), (4, 7), (9, 11)),
v AS (SELECT DISTINCT x.node, a, b FROM p JOIN up x ON x.ancestor = a JOIN up y ON y.ancestor = b AND y.node = x.node)
SELECT v.node, v.a::BIGINT AS a, v.b::BIGINT AS b, NOT EXISTS (SELECT 1 FROM {H} h JOIN v w ON w.node = h.parent WHERE h.child = v.node AND h.child <> h.parent AND w.a = v.a AND w.b = v.b) AS culprit FROM v""")
def g10(read):
    pairs = read("part").sparkSession.createDataFrame([(3, 5), (4, 7), (9, 11)], "a long, b long")
    return G.disjointness(hierarchy(read), pairs)


@query("g11_mixed_order", f"SELECT DISTINCT l_partkey AS node FROM lineitem WHERE l_partkey IN (SELECT child FROM {H} UNION SELECT parent FROM {H})")
def g11(read):
    return G.mixed_order(read("lineitem").select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent")), hierarchy(read))


@query("g12_transitive_reduction", f"""
WITH RECURSIVE h AS (SELECT * FROM {H} WHERE child <> parent), r(a, b) AS (SELECT child, parent FROM h UNION SELECT r.a, h.parent FROM r JOIN h ON h.child = r.b)
SELECT child AS src, parent AS dst FROM h WHERE NOT EXISTS (SELECT 1 FROM h x JOIN r ON r.a = x.parent WHERE x.child = h.child AND r.b = h.parent)""")
def g12(read):
    return G.transitive_reduction(hierarchy(read).filter("child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst")))


@query("g13_nearest_common", f"""
WITH RECURSIVE d(node, ancestor, dist) AS (SELECT child, child, 0 FROM {H} UNION SELECT parent, parent, 0 FROM {H} UNION SELECT d.node, h.parent, dist + 1 FROM d JOIN {H} h ON h.child = d.ancestor WHERE dist < 12 AND h.child <> h.parent),
m AS (SELECT node, ancestor, min(dist) AS dist FROM d GROUP BY 1, 2)
SELECT x.node AS a, y.node AS b, min_by(x.ancestor, (x.dist + y.dist, x.ancestor)) AS ancestor FROM m x JOIN m y ON x.ancestor = y.ancestor AND y.node = x.node + 7 GROUP BY 1, 2""")
def g13(read):
    d = G.ancestor_distance(hierarchy(read))
    nodes = d.select("node").distinct()
    pairs = nodes.select(F.col("node").alias("a"), (F.col("node") + 7).alias("b"))
    return G.nearest_common(d, pairs)


@query("g15_treatment_rank", """
SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 2 END * (CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 ELSE -1 END) * exp(-(greatest(0, date_diff('day', o_orderdate::DATE, DATE '2002-01-01')) / 365.25) / 6) * CASE WHEN o_custkey % 3 = 0 THEN 1.0 WHEN o_custkey % 3 = 1 THEN 0.7 ELSE 0.4 END * 1.2, 6) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 100""")
def g15(read):
    court = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 3).otherwise(2)
    relation = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 1).otherwise(-1)
    years = F.greatest(F.lit(0), F.datediff(F.lit("2002-01-01"), "o_orderdate")) / 365.25
    place = F.when(F.col("o_custkey") % 3 == 0, 1.0).when(F.col("o_custkey") % 3 == 1, 0.7).otherwise(0.4)
    score = G.treatment_score(court, relation, years, place, F.lit(1.2))
    return read("orders").select("o_orderkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(100)


@query("g16_reference_edges", r"WITH r AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 2 = 0 THEN 'amends order ' ELSE 'cites order ' END || (o_custkey * 7)::VARCHAR AS t FROM orders) SELECT regexp_extract(t, '^(amends|cites)', 1) AS kind, count(*) AS n FROM r JOIN orders o ON o.o_orderkey = regexp_extract(t, '(\d+)$', 1)::BIGINT GROUP BY 1")
def g16(read):
    t = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "amends order ").otherwise("cites order "), (F.col("o_custkey") * 7).cast("string"))
    refs = read("orders").select(F.regexp_extract(t, "^(amends|cites)", 1).alias("kind"), F.regexp_extract(t, r"(\d+)$", 1).cast("long").alias("k"))
    return refs.join(read("orders").select(F.col("o_orderkey").alias("k")), "k").groupBy("kind").agg(F.count("*").alias("n"))


@query("g18_cone", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT child AS src, parent AS dst, CASE WHEN child % 4 = 0 THEN 'skip' ELSE 'next' END AS type FROM {H} WHERE child <> parent),
r(node) AS (SELECT 700::BIGINT UNION SELECT 701 UNION SELECT dst FROM r JOIN e ON src = node WHERE type = 'next')
SELECT (SELECT count(*) FROM r) AS visited, round(count(*) FILTER (WHERE type = 'next') / greatest(1, count(*))::DOUBLE, 6) AS selectivity, round(count(*) FILTER (WHERE type <> 'next') / greatest(1, count(*))::DOUBLE, 6) AS leakage FROM e WHERE src IN (SELECT node FROM r)""")
def g18(read):
    e = hierarchy(read).filter("child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.when(F.col("child") % 4 == 0, "skip").otherwise("next").alias("type"))
    return G.cone(e, seeds(read, 700, 701), ["next"])


@query("g19_containment", """
WITH s AS (SELECT o_custkey, o_orderkey AS id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 400 AS e FROM orders)
SELECT a.id, min_by(b.id, (b.e - b.s, b.id)) AS parent FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.id <> b.id AND b.s <= a.s AND a.e <= b.e AND (b.e - b.s) > (a.e - a.s) GROUP BY 1""")
def g19(read):
    """Each span's parent: the shortest longer span of the same customer that encloses it."""
    from ..operators.joins import interval_join

    s = read("orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("s"))
    s = s.withColumn("e", F.col("s") + 1 + F.col("o_orderkey") % 400)
    a = s.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = s.select("o_custkey", F.col("o_orderkey").alias("p"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    inside = interval_join(a, b, ["o_custkey"], 400, ("a_s", "a_e"), ("b_s", "b_e")).filter("id <> p and b_s <= a_s and a_e <= b_e and b_e - b_s > a_e - a_s")
    return inside.groupBy("id").agg(F.min_by("p", F.struct(F.col("b_e") - F.col("b_s"), F.col("p"))).alias("parent"))


@query("g20_clause_tree", r"""
WITH t AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
c AS (SELECT item_id, i, coalesce(sum(CASE WHEN regexp_matches(t, '[.;]$') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clause FROM t)
SELECT item_id, clause, count(*) AS tokens, min(i)::BIGINT AS first_pos FROM c GROUP BY 1, 2""")
def g20(read):
    from pyspark.sql.window import Window

    t = read("benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "t"))
    w = Window.partitionBy("item_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    c = t.withColumn("clause", F.coalesce(F.sum(F.when(F.rlike("t", F.lit("[.;]$")), 1).otherwise(0)).over(w), F.lit(0)).cast("long"))
    return c.groupBy("item_id", "clause").agg(F.count("*").alias("tokens"), F.min("i").cast("long").alias("first_pos"))


@query("g22_node_rollup", f"SELECT dst AS node, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT type) AS kinds, strftime(max(date), '%Y-%m-%d') AS last_day FROM {E} GROUP BY 1")
def g22(read):
    return edges(read).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("type").alias("kinds"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last_day"))


@query("a22_longest_path", f"""
WITH RECURSIVE h AS (SELECT child AS src, parent AS dst FROM {H} WHERE child <> parent), r(node, d) AS (SELECT src, 0 FROM h UNION SELECT h.dst, d + 1 FROM r JOIN h ON h.src = r.node)
SELECT node, max(d) AS depth FROM r GROUP BY 1""")
def a22(read):
    return G.longest_paths(hierarchy(read).filter("child <> parent").select(F.col("child").alias("src"), F.col("parent").alias("dst")))


@query("s7_bounded_fetch", """
WITH RECURSIVE l AS MATERIALIZED (SELECT page_id AS src, page_id * 7 + 3 AS dst FROM pages UNION SELECT page_id, page_id * 3 + 1 FROM pages), r(node, d) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, d + 1 FROM r JOIN l ON src = node WHERE d < 3)
SELECT p.page_id, min(d) AS dist FROM r JOIN pages p ON p.page_id = node GROUP BY 1 ORDER BY 2, 1 LIMIT 40""")
def s7(read):
    """Pages within three links of the first, at most 40, over a link table that is already there."""
    p = read("pages").select("page_id")
    links = p.select(F.col("page_id").alias("src"), (F.col("page_id") * 7 + 3).alias("dst")).union(p.select("page_id", F.col("page_id") * 3 + 1))
    r = G.reach(links, seeds(read, 0), 3)
    return r.join(p, r.node == p.page_id).select("page_id", "dist").orderBy("dist", "page_id").limit(40)
