"""Filters, joins, windows, ranking and set operators over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as J
from ..operators import keyed as K
from .registry import query

DAY = "strftime({}, '%Y-%m-%d')"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("p1_conjunctive_filter", "SELECT c_custkey FROM customer WHERE lower(trim(c_mktsegment)) = 'machinery' AND c_nationkey = 7")
def p1(read):
    return read("customer").filter((F.lower(F.trim("c_mktsegment")) == "machinery") & (F.col("c_nationkey") == 7)).select("c_custkey")


@query("p2_capture_query", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND contains(lower(props), '\"k\": 6') ORDER BY ts DESC, event_id LIMIT 25")
def p2(read):
    return read("events").filter((F.col("event_type") == "error") & F.contains(F.lower("props"), F.lit('"k": 6'))).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id", "user_id", "event_type")


@query("p3_node_search", "SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND list_contains(string_split(p_name, ' '), 'ring')")
def p3(read):
    return read("part").filter((F.col("p_type") == "ECONOMY") & F.array_contains(F.split("p_name", " "), "ring")).select("p_partkey", "p_name")


@query("p4_focus_lane", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['red', 'small'])")
def p4(read):
    return read("part").filter(F.arrays_overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("small")))).select("p_partkey")


VALID = "(SELECT o_orderkey, o_custkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders)"


@query("p5_as_at", f"SELECT o_orderkey, o_custkey FROM {VALID} WHERE f <= TIMESTAMP '1997-06-01' AND (t IS NULL OR t > TIMESTAMP '1997-06-01')")
def p5(read):
    from ..operators.versioned import as_at, validity

    return as_at(validity(read("orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"]), "1997-06-01").select("o_orderkey", "o_custkey")


@query("p6_null_safe", "SELECT count(*) AS n FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, event_type AS e FROM events) WHERE p IS NOT DISTINCT FROM e")
def p6(read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read("events").select(F.lag("event_type").over(w).alias("p"), F.col("event_type").alias("e")).filter(F.col("p").eqNullSafe(F.col("e"))).agg(F.count("*").alias("n"))


@query("p7_rank_gate", "SELECT l_orderkey, l_linenumber, least(l_quantity::INT % 12, 9)::BIGINT AS evidence, (CASE WHEN least(l_quantity::INT % 12, 9) < 2 THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN -1 ELSE 0 END)::BIGINT AS tau FROM lineitem")
def p7(read):
    evidence = F.least((F.col("l_quantity").cast("int") % 12).cast("long"), F.lit(9).cast("long"))
    tau = F.when(evidence < 2, 0).when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", -1).otherwise(0)
    return read("lineitem").select("l_orderkey", "l_linenumber", evidence.alias("evidence"), tau.cast("long").alias("tau"))


@query("p8_rule_checklist", "WITH r(rule, need) AS (VALUES ('a', 'red'), ('a', 'ring'), ('b', 'small'), ('b', 'widget'), ('c', 'blue')), t AS (SELECT p_partkey, p_name FROM part) SELECT p_partkey, rule, bool_and(list_contains(string_split(p_name, ' '), need)) AS passed FROM t, r GROUP BY 1, 2 HAVING bool_or(list_contains(string_split(p_name, ' '), need))")
def p8(read):
    """Rules that a part touches and whether it has all they need; the factors are joined on the tags, not with all rows."""
    spark = read("part").sparkSession
    rules = spark.createDataFrame([("a", "red"), ("a", "ring"), ("b", "small"), ("b", "widget"), ("c", "blue")], "rule string, tag string")
    size = rules.groupBy("rule").agg(F.count("*").alias("need"))
    tags = read("part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("tag"))
    return tags.join(F.broadcast(rules), "tag").groupBy("p_partkey", "rule").agg(F.count("*").alias("met")).join(F.broadcast(size), "rule").select("p_partkey", "rule", (F.col("met") == F.col("need")).alias("passed"))


@query("p9_harm_score", """
WITH s AS (SELECT l_orderkey, least(12.0, l_quantity) / 12.0 * 0.6 + CASE WHEN l_returnflag = 'R' THEN 0.2 ELSE 0 END - CASE WHEN l_linestatus = 'F' THEN 0.1 ELSE 0 END + 0.2 * (l_linenumber % 3) AS raw FROM lineitem)
SELECT l_orderkey, round(greatest(0.0, least(1.0, raw)), 4) AS score, CASE WHEN greatest(0.0, least(1.0, raw)) < 0.33 THEN 'Low' WHEN greatest(0.0, least(1.0, raw)) < 0.66 THEN 'Medium' ELSE 'High' END AS level FROM s""")
def p9(read):
    from ..operators.reports import harm_score

    score, level = harm_score(F.col("l_linenumber") % 3, F.col("l_quantity"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    return read("lineitem").select("l_orderkey", F.round(score, 4).alias("score"), level.alias("level"))


@query("p10_promotion_gate", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'rejected' WHEN contains(text, '@') THEN 'blocked' WHEN n_chars >= 2000 THEN 'promoted' ELSE 'held' END AS status FROM documents")
def p10(read):
    return read("documents").select("doc_id", F.when(F.col("text").isNull() | (F.col("text") == ""), "rejected").when(F.contains("text", F.lit("@")), "blocked").when(F.col("n_chars") >= 2000, "promoted").otherwise("held").alias("status"))


@query("p11_admissibility", "SELECT event_id, array_to_string(list_filter([CASE WHEN value < 1 THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'error_event' END, CASE WHEN user_id % 10 = 0 THEN 'reserved_user' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events WHERE value < 1 OR event_type = 'error' OR user_id % 10 = 0")
def p11(read):
    tests = (("low_value", F.col("value") < 1), ("error_event", F.col("event_type") == "error"), ("reserved_user", F.col("user_id") % 10 == 0))
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests]))
    return read("events").select("event_id", reasons.alias("r")).filter(F.size("r") > 0).select("event_id", F.array_join("r", ",").alias("reasons"))


@query("p12_red_flags", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(idiot|moron|scum|loser)\b')")
def p12(read):
    return read("documents").filter(F.rlike(F.lower("text"), F.lit(r"\b(idiot|moron|scum|loser)\b"))).select("doc_id")


@query("j1_dimension_view", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j1(read):
    """Dimensions are joined as they come: Spark broadcasts those it has measured as small."""
    n = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return read("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("j2_latest_revision", f"SELECT o_custkey, o_orderkey, {DAY.format('o_orderdate')} AS day FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def j2(read):
    return K.latest_by(read("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", day("o_orderdate").alias("day"))


@query("j3_asof_lookup", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01' GROUP BY 1")
def j3(read):
    return K.latest_by(read("orders").filter(F.col("o_orderdate") <= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("j3_asof_join", """
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
m AS (SELECT p.event_id, max_by(c.event_id, (c.ts, c.event_id)) AS click_id FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY 1)
SELECT event_id, click_id FROM m""")
def j3b(read):
    """Each purchase with the user's last click before it."""
    e = read("events")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return J.asof_join(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, ["user_id"], "ts", "click_ts", ["click_id"], ["click_id"]).select("event_id", "click_id")


SPANS = "(SELECT o_custkey % 50 AS g, o_orderkey AS {0}k, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS {0}s, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 90 AS {0}e FROM orders WHERE o_orderkey % 2 = {1})"


@query("j4_interval_join", f"SELECT a.g, ak, bk FROM {SPANS.format('a', 0)} a JOIN {SPANS.format('b', 1)} b ON a.g = b.g AND a.as_ < b.be AND a.ae > b.bs".replace("a.as_", 'a."as"').replace("AS as,", 'AS "as",'))
def j4(read):
    o = read("orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("k"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("s"))
    o = o.withColumn("e", F.col("s") + 1 + F.col("k") % 90)
    a = o.filter("k % 2 = 0").select("g", F.col("k").alias("ak"), F.col("s").alias("a_s"), F.col("e").alias("a_e"))
    b = o.filter("k % 2 = 1").select("g", F.col("k").alias("bk"), F.col("s").alias("b_s"), F.col("e").alias("b_e"))
    return J.interval_join(a, b, ["g"], 90, ("a_s", "a_e"), ("b_s", "b_e")).select("g", "ak", "bk")


@query("j5_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def j5(read):
    o = read("orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return read("customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("j6_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def j6(read):
    r = read("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return read("part").select("p_partkey").join(r, "p_partkey", "left_anti")


@query("j6_division", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN event_type END) = 3")
def j6b(read):
    need = read("events").filter(F.col("event_type").isin("click", "purchase", "signup")).select("event_type")
    return J.divide(read("events"), need, "user_id", "event_type")


@query("j7_lateral_top", "SELECT c_custkey, o_orderkey, r AS place FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM customer JOIN orders ON o_custkey = c_custkey) WHERE r <= 3")
def j7(read):
    o = read("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return J.lateral_top(read("customer").select("c_custkey"), o, ["c_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3, ["c_custkey"]).select("c_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("j8_propositions", """
WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS s FROM lineitem WHERE l_partkey % 3 < 2), b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS s FROM lineitem WHERE l_partkey % 3 > 0)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.s IS NULL THEN 'a_only' WHEN a.s IS NULL THEN 'b_only' WHEN a.s = b.s THEN 'shared' ELSE 'disputed' END AS kind FROM a FULL JOIN b USING (l_orderkey, l_linenumber)) GROUP BY kind""")
def j8(read):
    x = read("lineitem")
    return J.propositions(x.filter("l_partkey % 3 < 2"), x.filter("l_partkey % 3 > 0"), ["l_orderkey", "l_linenumber"], "l_returnflag").groupBy("kind").agg(F.count("*").alias("n"))


SNAP = "(SELECT l_partkey, l_suppkey, count(*) AS n, max(l_quantity) AS q FROM lineitem WHERE l_shipdate {} TIMESTAMP '1998-01-01' GROUP BY 1, 2)"


@query("j9_alignment", f"""
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey,
 CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n <> b.n OR a.q <> b.q THEN 'modified' ELSE 'unchanged' END AS status,
 CASE WHEN a.n IS NULL OR b.n IS NULL THEN '' WHEN a.n <> b.n AND a.q <> b.q THEN 'n,q' WHEN a.n <> b.n THEN 'n' WHEN a.q <> b.q THEN 'q' ELSE '' END AS changed
FROM {SNAP.format('<')} a FULL JOIN {SNAP.format('>=')} b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey""")
def j9(read):
    def snap(df):
        return df.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))

    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    x = read("lineitem")
    return J.align(snap(x.filter(F.col("l_shipdate") < cut)), snap(x.filter(F.col("l_shipdate") >= cut)), ["l_partkey", "l_suppkey"], ["n", "q"])


@query("j10_slot_deltas", f"""
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, sum(coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS delta FROM {SNAP.format('<')} a FULL JOIN {SNAP.format('>=')} b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey GROUP BY 1""")
def j10(read):
    """The two snapshots are one grouped pass: a signed sum does what an outer join with zeros would."""
    late = F.when(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), 1).otherwise(-1)
    return read("lineitem").groupBy("l_partkey").agg(F.sum(late).cast("long").alias("delta"))


@query("j11_alias_join", "WITH a(alias, entity) AS (VALUES ('red', 'colour'), ('blue', 'colour'), ('ring', 'thing'), ('widget', 'thing')) SELECT entity, count(*) AS mentions, count(DISTINCT p_partkey) AS parts FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) JOIN a ON w = alias GROUP BY entity")
def j11(read):
    names = read("part").sparkSession.createDataFrame([("red", "colour"), ("blue", "colour"), ("ring", "thing"), ("widget", "thing")], "w string, entity string")
    words = read("part").select("p_partkey", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    return words.join(F.broadcast(names), "w").groupBy("entity").agg(F.count("*").alias("mentions"), F.countDistinct("p_partkey").alias("parts"))


@query("j12_smallest_scope", """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey % 50 AS g, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT o_custkey % 50 AS g, o_orderkey AS bk, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS bs, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 1 + o_orderkey % 90 AS be FROM orders)
SELECT p.l_orderkey, p.l_linenumber, p.l_partkey, min_by(bk, (be - bs, bk)) AS bk FROM p JOIN b ON b.g = p.g AND bs <= pos AND pos < be GROUP BY 1, 2, 3""")
def j12(read):
    o = read("orders").select(F.col("o_orderkey"), (F.col("o_custkey") % 50).alias("g"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("b_s"))
    scopes = o.select("g", F.col("o_orderkey").alias("bk"), "b_s", (F.col("b_s") + 1 + F.col("o_orderkey") % 90).alias("b_e"))
    points = read("lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "g"), "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "g", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long").alias("at"))
    return J.smallest_enclosing(points, scopes, ["g"], 90, "at", ["l_orderkey", "l_linenumber", "l_partkey"], ("b_s", "b_e"), "bk")


@query("j13_pairs_within", "SELECT a.p_type AS ta, b.p_type AS tb, count(*) AS n FROM (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) a JOIN (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.l_orderkey = b.l_orderkey AND a.p_type < b.p_type GROUP BY 1, 2")
def j13(read):
    """Pairs of types in one order. Orders are grouped into their sets of types first: equal sets are paired once and counted."""
    t = read("lineitem").select("l_orderkey", "l_partkey").join(read("part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    sets = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("s")).groupBy("s").agg(F.count("*").alias("c"))
    a = sets.select("s", "c", F.posexplode("s").alias("i", "ta"))
    return a.select("c", "ta", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("tb")).groupBy("ta", "tb").agg(F.sum("c").alias("n"))


@query("j14_set_audit", "WITH a AS (SELECT l_partkey, l_linestatus FROM lineitem WHERE l_quantity < 5), b AS (SELECT l_partkey, l_linestatus FROM lineitem WHERE l_quantity > 45) SELECT side, count(*) AS n FROM (SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'extra', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY side")
def j14(read):
    x = read("lineitem").select("l_partkey", "l_linestatus", "l_quantity")
    return J.audit(x.filter("l_quantity < 5").drop("l_quantity"), x.filter("l_quantity > 45").drop("l_quantity")).groupBy("side").agg(F.count("*").alias("n"))


@query("w1_ordinals", "SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ordinal FROM lineitem")
def w1(read):
    return K.ordinal(read("lineitem"), ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_linenumber", F.col("ordinal").cast("long").alias("ordinal"))


@query("w2_dedupe_top_k", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem),
k AS (SELECT l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_suppkey) AS rank FROM d WHERE r = 1) SELECT l_partkey, l_suppkey, rank FROM k WHERE rank <= 2""")
def w2(read):
    best = read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("p"))
    return K.top_k(best, ["l_partkey"], [F.desc("p"), "l_suppkey"], 2).select("l_partkey", "l_suppkey", F.col("rank").cast("long").alias("rank"))


@query("w3_strict_winner", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, lead(n) OVER w AS nx FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, event_type))
SELECT user_id, event_type, n, (n <> 0 AND (nx IS NULL OR n > nx)) AS is_strict FROM r WHERE r = 1""")
def w3(read):
    return K.strict_winner(read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id"], "n", ["event_type"])


@query("w4_monotone_flag", "SELECT event_id, value >= coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS not_falling FROM events")
def w4(read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read("events").select("event_id", (F.col("value") >= F.coalesce(F.lag("value").over(w), F.col("value"))).alias("not_falling"))


@query("w5_surface", r"""
WITH t AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS w FROM benchmark))
SELECT item_id, string_agg(CASE WHEN i > 0 AND regexp_matches(t, '^[\p{L}\p{N}_]') THEN ' ' || t ELSE t END, '' ORDER BY i) AS surface FROM t GROUP BY item_id""")
def w5(read):
    """Words two places on from the last token's end get a space, marks join on."""
    words = read("benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).alias("i", "t"))
    placed = words.withColumn("s", 2 * F.col("i") + F.when(F.rlike("t", F.lit(r"^[\p{L}\p{N}_]")), 1).otherwise(0)).withColumn("e", 2 * F.col("i") + 2)
    return K.surface(placed, ["item_id"], "i", "t", "s", "e")


@query("w6_distinct_on", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def w6(read):
    return K.first_by(read("events").select("user_id", (-F.col("value")).alias("v"), "event_id"), ["user_id"], ["v", "event_id"]).select("user_id", "event_id")


@query("w7_group_ranking", "SELECT label, vec_id, r AS rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings) WHERE r <= 5")
def w7(read):
    return K.top_k(read("embeddings").select("label", "vec_id", F.col("embedding")[0].alias("s")), ["label"], [F.desc("s"), "vec_id"], 5).select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("w8_trailing_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS smooth FROM events")
def w8(read):
    return K.trailing_mean(read("events"), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", F.round("smooth", 4).alias("smooth"))


@query("w9_segment_shares", "WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS d, sum(value) AS m FROM events GROUP BY 1, 2) SELECT user_id, d, round(m / sum(m) OVER (PARTITION BY user_id), 6) AS share FROM p")
def w9(read):
    e = read("events").select("user_id", day("ts").alias("d"), "value")
    return K.segment_shares(e, ["user_id"], "d", "value").select("user_id", "d", F.round("share", 6).alias("share"))


@query("w11_tie_detection", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS mx FROM c) SELECT user_id, count(*) AS ties FROM m WHERE n = mx GROUP BY user_id HAVING count(*) > 1")
def w11(read):
    c = read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("mx", F.max("n").over(Window.partitionBy("user_id"))).filter("n = mx").groupBy("user_id").agg(F.count("*").alias("ties")).filter("ties > 1")


@query("w12_ambiguity_guard", "SELECT p_name, count(DISTINCT p_brand) AS n, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS p_brand FROM part GROUP BY p_name")
def w12(read):
    return J.unique_or_ambiguous(read("part"), "p_name", "p_brand")


@query("l1_multi_key_sort", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def l1(read):
    return read("orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("l2_top_n", "SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1 ORDER BY q DESC, l_partkey LIMIT 10")
def l2(read):
    return read("lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).orderBy(F.desc("q"), "l_partkey").limit(10)


@query("l3_paging", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def l3(read):
    return read("customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey")


@query("l4_merge_rank", "SELECT doc_id, lang FROM documents ORDER BY n_chars // 1000 DESC, CASE lang WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 9 END, doc_id LIMIT 50")
def l4(read):
    from ..operators.search import merge_rank

    return merge_rank(read("documents").withColumn("priority", F.expr("n_chars div 1000")), "priority", "lang", ["de", "fr"], ["doc_id"], 50).select("doc_id", "lang")


@query("l5_review_queue", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def l5(read):
    return K.top_k(read("documents"), ["source"], [F.desc("n_chars"), "doc_id"], 3).select("source", "doc_id")


@query("l6_authority_order", "SELECT o_orderkey, r::BIGINT AS rank FROM (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 9 END, o_orderkey) AS n FROM orders) WHERE n = 1")
def l6(read):
    order = read("orders").sparkSession.createDataFrame([("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3)], "o_orderpriority string, rank long")
    o = read("orders").join(F.broadcast(order), "o_orderpriority", "left").select("o_custkey", F.coalesce("rank", F.lit(9).cast("long")).alias("rank"), "o_orderkey")
    return K.first_by(o, ["o_custkey"], ["rank", "o_orderkey"]).select("o_orderkey", "rank")


@query("u1_union_kinds", "SELECT kind, count(*) AS n, min(k) AS first_k FROM (SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'part', p_partkey FROM part) GROUP BY kind")
def u1(read):
    parts = [read(t).select(F.lit(t).alias("kind"), F.col(c).alias("k")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


@query("u2_union_first_wins", "WITH u AS (SELECT text, 0 AS o, item_id AS id FROM benchmark UNION ALL SELECT text, 1, doc_id FROM documents) SELECT md5(text) AS h, min_by(id, (o, id)) AS id FROM u GROUP BY text")
def u2(read):
    rows = read("benchmark").select("text", F.lit(0).alias("o"), F.col("item_id").alias("id")).unionByName(read("documents").select("text", F.lit(1).alias("o"), F.col("doc_id").alias("id")))
    rows = rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("k"), F.md5(F.col("text").cast("binary")).alias("h"), "o", "id")
    return K.first_by(rows, ["k"], ["o", "id"]).select("h", "id")


@query("u3_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def u3(read):
    x = read("lineitem")
    return x.filter("l_returnflag = 'R'").select("l_partkey").intersect(x.filter("l_returnflag = 'A'").select("l_partkey"))


@query("u4_except", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def u4(read):
    x = read("orders")
    return x.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).subtract(x.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")))


@query("u5_mean_jaccard", """
WITH s AS (SELECT p_brand, list(DISTINCT p_type) AS t, list(DISTINCT p_size) AS z FROM part GROUP BY 1), p AS (SELECT a.p_brand AS a, b.p_brand AS b, a.t AS ta, b.t AS tb, a.z AS za, b.z AS zb FROM s a JOIN s b ON a.p_brand < b.p_brand)
SELECT a, b, round((len(list_intersect(ta, tb))::DOUBLE / len(list_distinct(list_concat(ta, tb))) + len(list_intersect(za, zb))::DOUBLE / len(list_distinct(list_concat(za, zb)))) / 2, 6) AS similarity FROM p""")
def u5(read):
    """Brands are a dimension of fixed size; their sets are compared pairwise."""
    from ..functions.text import jaccard

    s = read("part").groupBy("p_brand").agg(F.collect_set("p_type").alias("t"), F.collect_set("p_size").alias("z"))
    a, b = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    both = a.join(b, F.col("a_p_brand") < F.col("b_p_brand"))
    return both.select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), F.round((jaccard(F.col("a_t"), F.col("b_t")) + jaccard(F.col("a_z"), F.col("b_z"))) / 2, 6).alias("similarity"))


@query("u6_ledger_join", "SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT event_id, user_id FROM events WHERE event_id % 3 < 2 UNION SELECT event_id, user_id FROM events WHERE event_id % 3 > 0)")
def u6(read):
    e = read("events").select("event_id", "user_id")
    return e.filter("event_id % 3 < 2").unionByName(e.filter("event_id % 3 > 0")).dropDuplicates(["event_id"]).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
