"""Operators by their exact rules: labels, gates, obligations, concepts, access paths, drifts, relevance."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lattice as L
from ..functions import text as T
from ..operators import reports as R
from ..operators import text_stats as S
from ..operators import versioned as V
from .registry import query


@query("a3_top_apps", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def a3c(read):
    return R.top_counts(read("events"), "event_type")


@query("a3_top_titles", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 10")
def a3d(read):
    return R.top_counts(read("part"), "p_name")


@query("g5_cloud_scores", """
SELECT o_orderkey, round(CASE WHEN o_orderpriority = '1-URGENT' THEN 0.4 ELSE 0.0 END + CASE WHEN o_custkey % 3 = 0 THEN 0.2 ELSE 0.0 END + CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE 0.2 / (1 + date_diff('day', o_orderdate::DATE, DATE '2002-01-01') / 365.0) END
 + CASE o_orderstatus WHEN 'F' THEN 0.2 / 6 WHEN 'O' THEN 0.2 / 4 ELSE 0.0 END, 6) AS score FROM orders ORDER BY score DESC, o_orderkey LIMIT 300""")
def g5b(read):
    """The 300 nodes of a cloud. Every seventh order is undated; status P has no rank."""
    o = read("orders")
    days = F.when(F.col("o_orderkey") % 7 != 0, F.datediff(F.lit("2002-01-01"), "o_orderdate"))
    rank = F.when(F.col("o_orderstatus") == "F", 5).when(F.col("o_orderstatus") == "O", 3)
    score = R.cloud_score((F.col("o_orderpriority") == "1-URGENT").cast("double"), (F.col("o_custkey") % 3 == 0).cast("double"), days, rank)
    return o.select("o_orderkey", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "o_orderkey").limit(300)


CONCEPTS = (("connective", "and"), ("connective", "und"), ("article", "the"), ("article", "th"), ("ending", "tion"), ("ending", "ion"), ("none", "zzzz"), ("mark", ". "))


@query("t18_concept_spans", f"""
WITH c(concept_id, phrase) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CONCEPTS)}),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), p AS (SELECT doc_id, concept_id, length(phrase) AS m, string_split(t, phrase) AS x FROM d, c WHERE contains(t, phrase)),
h AS (SELECT doc_id, concept_id, m, len(x) - 1 AS n, list_sum(list_transform(x, lambda s, i: length(s) * (len(x) - i)))::BIGINT AS gaps FROM p)
SELECT doc_id, concept_id, sum(n)::BIGINT AS n, sum(gaps + m * n * (n - 1) // 2)::BIGINT AS starts, sum(gaps + m * n * (n - 1) // 2 + m * n)::BIGINT AS ends FROM h GROUP BY 1, 2""")
def t18b(read):
    """Substrings, overlapping ones included, by one automaton; summed up for each document and concept. (No phrase overlaps itself, so the SQL may split.)"""
    concepts = read("documents").sparkSession.createDataFrame(CONCEPTS, "concept_id string, phrase string")
    found = S.concept_spans(read("documents"), concepts)
    return found.groupBy("doc_id", "concept_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


SPANS = """s AS (SELECT l_orderkey AS doc, l_orderkey * 10 + l_linenumber AS span_id, l_linenumber * 110 + (l_partkey % 3) * 60 AS start, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE l_returnflag END AS label,
 CASE l_linestatus WHEN 'F' THEN 'actor' ELSE 'other' END AS role, l_discount > 0.05 AS modal, l_tax > 0.07 AS signal, l_quantity > 48 AS defined FROM lineitem)"""
REPEATED = """o AS (SELECT doc, label, start, row_number() OVER (PARTITION BY doc, label ORDER BY start) AS k FROM s WHERE label <> ''),
g(doc, label, k, last, n) AS (SELECT doc, label, k, start, 1 FROM o WHERE k = 1 UNION ALL SELECT o.doc, o.label, o.k, CASE WHEN o.start - g.last >= 200 THEN o.start ELSE g.last END, g.n + (o.start - g.last >= 200)::INT FROM g JOIN o ON o.doc = g.doc AND o.label = g.label AND o.k = g.k + 1),
r AS (SELECT doc, label, max(n) AS kept FROM g GROUP BY 1, 2 HAVING max(n) >= 3)"""


def label_spans(read):
    x = read("lineitem")
    start = F.col("l_linenumber") * 110 + (F.col("l_partkey") % 3) * 60
    role = F.when(F.col("l_quantity") > 48, "defined_term").when(F.col("l_linestatus") == "F", "actor").otherwise("other")
    return x.select(
        F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"), start.alias("start"), (start + 40).alias("end"),
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(F.col("l_returnflag")).alias("label"), role.alias("role"), (F.col("l_discount") > 0.05).alias("modal"), (F.col("l_tax") > 0.07).alias("signal"),
    )


@query("t29_repeated_labels", f"WITH RECURSIVE {SPANS}, {REPEATED} SELECT doc, label, kept FROM r")
def t29b(read):
    return S.repeated_labels(label_spans(read), "doc", "label", "start")


@query("p10_promotion_gates", f"""
WITH RECURSIVE {SPANS}, {REPEATED},
b AS (SELECT DISTINCT s.span_id FROM s JOIN s x ON x.doc = s.doc AND x.signal AND s.start < x.start + 40 AND s.start + 40 > x.start),
c AS (SELECT span_id, CASE WHEN s.label = '' THEN 'no_label' WHEN span_id IN (SELECT span_id FROM b) THEN 'signal_block' WHEN defined THEN 'defined_term' WHEN (doc, s.label) IN (SELECT (doc, label) FROM r) THEN 'repetition' WHEN role = 'actor' AND modal THEN 'modal_participation' ELSE 'no_gate' END AS gate FROM s)
SELECT gate, CASE WHEN gate IN ('no_label', 'no_gate') THEN 'rejected' WHEN gate = 'signal_block' THEN 'blocked' ELSE 'promoted' END AS status, count(*) AS n, sum(span_id)::BIGINT AS ids FROM c GROUP BY 1, 2""")
def p10b(read):
    """Signals are spans too, and block themselves with all that they overlap."""
    spans = label_spans(read)
    return R.promotion_gates(spans.drop("signal"), spans.filter("signal"), "doc").groupBy("gate", "status").agg(F.count("*").alias("n"), F.sum("span_id").alias("ids"))


CLAUSES = (
    ("The carrier must not release goods within 7 days.", "prohibition", "must not", "the carrier", "release", "goods"),
    ("(a) The buyer shall pay the price on delivery;", "obligation", "shall", "the buyer", "pay", "the price"),
    ("The seller may cancel, during storage.", "permission", "may", "the seller", "cancel", None),
    ("Goods are stored.", None, None, None, None, None),
    ("This part does not apply to gifts and must be read so.", "exclusion", "does not apply", None, "gifts", "and must be read so"),
    ("Every agent is required to keep books", "obligation", "is required to", "every agent", "keep", "books"),
    ("Section 12 of the owner shall, insure it when asked.", "obligation", "shall", "the owner", "insure", "it"),
    ("must pay", "obligation", "must", None, "pay", None),
)


def _sql(x):
    return "NULL" if x is None else f"'{x}'"


@query("t32_obligations", f"""
WITH c(i, modality, surface, actor, action, object) AS (VALUES {', '.join(f"({i}, {', '.join(map(_sql, c[1:]))})" for i, c in enumerate(CLAUSES))})
SELECT o_orderkey, (o_orderkey + k) % {len(CLAUSES)} AS i, modality, surface, actor, action, object FROM orders, (VALUES (0), (3)) v(k) JOIN c ON c.i = (o_orderkey + k) % {len(CLAUSES)} WHERE modality IS NOT NULL""")
def t32b(read):
    """Two clauses in each text. What the SQL lists was read off the rule by hand."""
    sentence = lambda k: F.get(F.array(*[F.lit(c[0] if c[0][-1] in ".;" else c[0] + ".") for c in CLAUSES]), ((F.col("o_orderkey") + k) % len(CLAUSES)).cast("int"))
    docs = read("orders").select("o_orderkey", F.concat_ws(" ", sentence(0), sentence(3)).alias("text"))
    found = S.obligations(docs, "o_orderkey")
    return found.select("o_orderkey", ((F.col("o_orderkey") + F.col("clause") * 3) % len(CLAUSES)).alias("i"), "modality", "surface", "actor", "action", "object")


@query("t22_resolution", r"""
WITH c AS (SELECT o_orderkey AS doc_id, repeat('x', (o_orderkey % 9)::INT) || ' See [' || strftime(o_orderdate, '%Y') || '] ORD ' || (o_custkey % 100)::VARCHAR || ' and more' AS text FROM orders),
x AS (SELECT doc_id, regexp_extract(text, '\[\d{4}\]\s+[A-Z][A-Z0-9]+\s+\d+') AS citation, instr(text, '[') - 1 AS pos FROM c), f AS (SELECT citation, min(doc_id) AS first_doc FROM x GROUP BY 1)
SELECT doc_id, citation, pos::BIGINT AS pos, CASE WHEN doc_id <> first_doc THEN 'already_ingested' WHEN citation LIKE '%7' THEN 'unresolved' ELSE 'resolved' END AS reason FROM x JOIN f USING (citation)""")
def t22b(read):
    """Citations with their places; one met in an earlier document is there already, one that the register lacks is unresolved."""
    o = read("orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.expr("repeat('x', cast(o_orderkey % 9 as int))"), F.lit(" See ["), F.date_format("o_orderdate", "yyyy"), F.lit("] ORD "), (F.col("o_custkey") % 100).cast("string"), F.lit(" and more")).alias("text"))
    return S.citation_resolution(o, lambda c: ~c.endswith("7")).select("doc_id", "citation", "pos", "reason")


@query("v7_role_joins", """
WITH a AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nx, (event_id % 3)::VARCHAR AS actor, CASE WHEN event_id % 2 = 0 THEN (event_id % 4)::VARCHAR END AS obj, CASE WHEN event_id % 5 = 0 THEN 'variable' ELSE 'bound' END AS st, CASE WHEN event_id % 7 = 0 THEN 'place' ELSE 'person' END AS ty FROM events)
SELECT x.event_id, array_to_string(list_filter([CASE WHEN x.ty <> y.ty OR (x.st = y.st AND x.actor <> y.actor) THEN 'actor' END, CASE WHEN x.obj IS NOT NULL AND y.obj IS NOT NULL AND (x.ty <> y.ty OR (x.st = y.st AND x.obj <> y.obj)) THEN 'object' END], lambda r: r IS NOT NULL), ',') AS conflicts,
 CASE WHEN x.ty <> y.ty OR (x.st = y.st AND x.actor <> y.actor) THEN x.actor WHEN x.st = 'variable' AND y.st = 'bound' THEN y.actor ELSE x.actor END AS actor,
 CASE WHEN x.ty = y.ty AND (x.st = 'bound' OR y.st = 'bound') AND NOT (x.st = y.st AND x.actor <> y.actor) THEN 'bound' ELSE x.st END AS status, (1 + (coalesce(x.obj, y.obj) IS NOT NULL)::INT)::BIGINT AS roles
FROM a x JOIN a y ON y.event_id = x.nx""")
def v7b(read):
    """Role states of consecutive events joined: each role by the rule for two arguments; conflicts may be new."""
    status = F.when(F.col("event_id") % 5 == 0, "variable").otherwise("bound")
    kind = F.when(F.col("event_id") % 7 == 0, "place").otherwise("person")
    arg = lambda v: F.struct(v.alias("value"), kind.alias("entity_type"), status.alias("status"))
    roles = F.map_filter(F.create_map(F.lit("actor"), arg((F.col("event_id") % 3).cast("string")), F.lit("object"), arg(F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 4).cast("string")))), lambda k, v: v["value"].isNotNull())
    e = read("events").select("event_id", "user_id", roles.alias("x"))
    e = e.withColumn("y", F.lead("x").over(Window.partitionBy("user_id").orderBy("event_id"))).filter("y is not null")
    joined, conflicts = L.join_roles(F.col("x"), F.col("y"))
    e = e.select("event_id", joined.alias("j"), conflicts.alias("c"))
    actor = F.element_at("j", "actor")
    return e.select("event_id", F.array_join("c", ",").alias("conflicts"), actor["value"].alias("actor"), actor["status"].alias("status"), F.size("j").cast("long").alias("roles"))


_TURN = "turn AS start, CASE WHEN length(text) % 11 = 0 THEN NULL ELSE (length(text) % 5 = 0)::INT END AS quotation_depth, CASE WHEN length(text) % 7 = 0 THEN conv_id END AS reporting, turn // 2 AS clause, CASE WHEN length(text) % 3 = 0 THEN 1 END AS coordination, turn // 3 AS sentence, CASE WHEN length(text) % 13 <> 0 THEN turn // 6 END AS paragraph"


@query("v12_access_paths", f"""
WITH c AS (SELECT conv_id, {_TURN} FROM conversations), p AS (SELECT CASE WHEN b.start >= a.start THEN 'not_preceding_reference'
 WHEN a.quotation_depth <> b.quotation_depth AND (a.reporting IS NOT NULL OR b.reporting IS NOT NULL) THEN 'reporting_content_boundary' WHEN a.quotation_depth <> b.quotation_depth THEN 'quotation_boundary_crossed'
 WHEN a.clause = b.clause THEN 'same_clause' WHEN a.reporting = b.reporting THEN 'governing_clause' WHEN a.coordination = b.coordination THEN 'preceding_coordinated_clause' WHEN a.sentence = b.sentence THEN 'same_sentence'
 WHEN a.paragraph = b.paragraph THEN 'preceding_discourse_unit' WHEN b.paragraph < a.paragraph THEN 'preceding_paragraph' ELSE 'preceding_document_unit' END AS path, a.start - b.start AS d FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.start - b.start BETWEEN -1 AND 5 AND a.start <> b.start)
SELECT path, d::BIGINT AS distance, count(*) AS n FROM p GROUP BY 1, 2""")
def v12b(read):
    """Each turn with the one after it and the five before it, taken from the ordered turns."""
    n = F.length("text")
    anchor = F.struct(
        F.col("turn").alias("start"), F.when(n % 11 != 0, (n % 5 == 0).cast("int")).alias("quotation_depth"), F.when(n % 7 == 0, F.col("conv_id")).alias("reporting"), F.floor(F.col("turn") / 2).alias("clause"),
        F.when(n % 3 == 0, 1).alias("coordination"), F.floor(F.col("turn") / 3).alias("sentence"), F.when(n % 13 != 0, F.floor(F.col("turn") / 6)).alias("paragraph"),
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read("conversations").select("conv_id", "turn", anchor.alias("a"))
    rows = rows.withColumn("near", F.array(*[F.lag("a", k).over(w) for k in (-1, 1, 2, 3, 4, 5)])).select("a", F.explode("near").alias("b")).filter("b is not null")
    return rows.select(L.access_path(F.col("a"), F.col("b")).alias("path"), (F.col("a.start") - F.col("b.start")).cast("long").alias("distance")).groupBy("path", "distance").agg(F.count("*").alias("n"))


def _fibres(when: str) -> str:
    return f"SELECT l_partkey AS k, l_returnflag AS p, l_linestatus AS v FROM lineitem WHERE l_quantity > 35 AND l_shipdate {when} TIMESTAMP '1998-01-01'"


def _drift_sql(entropy: bool) -> str:
    state = "SELECT k, list_sort(list(DISTINCT p)) AS p, list_sort(list(DISTINCT p || '=' || v)) AS s FROM ({}) GROUP BY 1"
    amount = "SELECT k, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM (SELECT k, p || '=' || v AS s, count(*) AS n FROM ({}) GROUP BY 1, 2) GROUP BY 1"
    parts = ", ".join(f"s{i} AS ({state.format(_fibres(w))}), e{i} AS ({amount.format(_fibres(w))})" for i, w in enumerate(("<", ">=")))
    delta = "round(coalesce(e1.e, 0) - coalesce(e0.e, 0), 6)" if entropy else "0.0::DOUBLE"
    return f"""WITH {parts}, k AS (SELECT k FROM s0 UNION SELECT k FROM s1), j AS (SELECT k.k AS l_partkey, CASE WHEN coalesce(s0.p, []) <> coalesce(s1.p, []) THEN 'high' WHEN coalesce(s0.s, []) <> coalesce(s1.s, []) THEN 'medium' WHEN {delta} <> 0 THEN 'low' END AS severity, {delta} AS entropy_delta
FROM k LEFT JOIN s0 ON s0.k = k.k LEFT JOIN s1 ON s1.k = k.k LEFT JOIN e0 ON e0.k = k.k LEFT JOIN e1 ON e1.k = k.k) SELECT * FROM j WHERE severity IS NOT NULL"""


def _snapshots(read):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    x = read("lineitem").filter("l_quantity > 35")
    return [x.filter(t).select("l_partkey", "l_returnflag", "l_linestatus") for t in (F.col("l_shipdate") < cut, F.col("l_shipdate") >= cut)]


@query("v19_qualifier_drift", _drift_sql(True))
def v19b(read):
    return V.fibre_drift(*_snapshots(read), ["l_partkey"], "l_returnflag", "l_linestatus", True)


@query("v19_reference_drift", _drift_sql(False))
def v19c(read):
    return V.fibre_drift(*_snapshots(read), ["l_partkey"], "l_returnflag", "l_linestatus", False)


_H = "(SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0)"


@query("a22_relevance", f"""
WITH RECURSIVE d(node, k) AS (SELECT src, 0 FROM {_H} UNION SELECT h.dst, k + 1 FROM d JOIN {_H} h ON h.src = d.node), u(node, k) AS (SELECT dst, 0 FROM {_H} UNION SELECT h.src, k + 1 FROM u JOIN {_H} h ON h.dst = u.node),
dm AS (SELECT node, max(k) AS k FROM d GROUP BY 1), um AS (SELECT node, max(k) AS k FROM u GROUP BY 1),
g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM {_H} UNION ALL SELECT dst FROM {_H} UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 0 UNION ALL SELECT p_partkey // 4 FROM part WHERE p_partkey % 4 = 0 AND p_partkey > 0) GROUP BY 1),
m AS (SELECT p_partkey AS event, (coalesce(n, 0) + p_size % 2)::DOUBLE AS c, (p_size % 3)::DOUBLE AS r, (coalesce(dm.k, 0) + coalesce(um.k, 0))::DOUBLE AS depth, p_size % 5 = 0 AS conflict, p_size % 7 <> 0 AS ready, p_size % 11 = 0 AS blocked FROM part LEFT JOIN g ON g.node = p_partkey LEFT JOIN dm ON dm.node = p_partkey LEFT JOIN um ON um.node = p_partkey),
s AS (SELECT *, greatest(0.0, least(1.0, round(c * 0.3 + r * 0.2 + depth * 0.1 + (c + r) * 0.1 + CASE WHEN r >= 2 THEN 0.2 ELSE 0.0 END - CASE WHEN conflict THEN 0.3 ELSE 0.0 END, 2))) AS score FROM m)
SELECT event, c AS connectedness, r AS referentiality, depth, score, CASE WHEN blocked THEN 'excluded' WHEN ready AND score >= 0.5 THEN 'timeline_candidate' WHEN score >= 0.4 THEN 'triage' ELSE 'background' END AS status FROM s""")
def a22b(read):
    p = read("part")
    edges = p.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 3").alias("dst"), F.lit("historical_time_order").alias("basis"))
    links = p.filter("p_partkey % 4 = 0 and p_partkey > 0").select(F.col("p_partkey").alias("left"), F.expr("p_partkey div 4").alias("right"))
    size = F.col("p_size")
    ready = size % 7 != 0
    events = p.select(F.col("p_partkey").alias("event"), (size % 2 + 1).alias("cluster_size"), (size % 3).alias("families"), (size % 5 == 0).alias("conflict"), ready.alias("closed"), ready.alias("dated"), ready.alias("sourced"), (size % 11 == 0).alias("blocked"))
    return R.braid_relevance(events, links, edges)


@query("m2_measures", """
SELECT o_custkey, round(count(*) * 1.0 + sum(l_linenumber) * 0.75 + count(*) FILTER (WHERE l_returnflag = 'R') * 2 + count(*) FILTER (WHERE l_tax > 0.07) * 3 + count(*) FILTER (WHERE l_discount = 0) * 4 + sum(l_partkey) / 1024.0 + count(*) FILTER (WHERE l_quantity > 25) * 0.5 + max(l_linenumber)
 + sum(l_suppkey) * 1e-6 + count(*) FILTER (WHERE l_linestatus = 'F') * 0.25 + count(*) FILTER (WHERE l_returnflag = 'A') * 0.5 + count(*) FILTER (WHERE l_linenumber = 1) * 0.25, 4) AS mdl FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def m2b(read):
    """All twelve measures of each part of a description, joined and weighted."""
    flag = lambda t: t.cast("long")
    c = F.col
    parts = read("lineitem").join(read("orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).select(
        "o_custkey", F.lit(1).alias("nodes"), c("l_linenumber").alias("edges"), flag(c("l_returnflag") == "R").alias("alternatives"), flag(c("l_tax") > 0.07).alias("unresolved"), flag(c("l_discount") == 0).alias("boundaries"), c("l_partkey").alias("bytes"),
        flag(c("l_quantity") > 25).alias("rules"), c("l_linenumber").alias("rounds"), c("l_suppkey").alias("nanoseconds"), flag(c("l_linestatus") == "F").alias("promoted"), flag(c("l_returnflag") == "A").alias("interfaces"), flag(c("l_linenumber") == 1).alias("hierarchy"),
    )
    return R.description_length(parts, ["o_custkey"]).select("o_custkey", F.round("mdl", 4).alias("mdl"))


@query("x4_rules", """
WITH RECURSIVE b(s, o) AS (SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0 UNION SELECT b.s, h.p_partkey // 3 FROM b JOIN part h ON h.p_partkey = b.o AND h.p_partkey > 0)
SELECT 'below' AS p, s, o FROM b UNION ALL SELECT DISTINCT 'made_by', b.s, m.l_suppkey FROM (SELECT * FROM b UNION ALL SELECT p_partkey, p_partkey FROM part) b JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 7) m ON m.l_partkey = b.o""")
def x4(read):
    """below is transitive, and what is below a part is made by its makers."""
    from ..operators.graph import infer

    below = read("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("s"), F.lit("below").alias("p"), F.expr("p_partkey div 3").alias("o"))
    made = read("lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("s"), F.lit("made_by").alias("p"), F.col("l_suppkey").alias("o"))
    return infer(below.unionByName(made), [("below", "below", "below"), ("below", "made_by", "made_by")])


@query("dt7_ordering_edges", "WITH n AS (SELECT o_custkey, o_orderkey AS src, o_orderdate AS t, lead(o_orderkey) OVER w AS dst, lead(o_orderdate) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, src, dst, CASE WHEN nt > t THEN 'historical_time_order' ELSE 'same_time' END AS basis FROM n WHERE dst IS NOT NULL")
def dt7b(read):
    return V.ordering_edges(read("orders"), ["o_custkey"], "o_orderkey", "o_orderdate")


@query("dt8_leases", "WITH l AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS taken, (user_id % 50) * 86400 AS secs FROM events) SELECT CASE WHEN taken IS NULL THEN 'free' WHEN TIMESTAMP '2024-01-20 00:00:00' >= taken + to_seconds(secs) THEN 'expired' ELSE 'held' END AS state, count(*) AS n, strftime(max(taken + to_seconds(secs)), '%Y-%m-%d %H:%M') AS last_end FROM l GROUP BY 1")
def dt8(read):
    end, state = V.lease_state(F.when(F.col("event_type") != "error", F.col("ts")), (F.col("user_id") % 50) * 86400, F.lit("2024-01-20").cast("timestamp_ntz"))
    return read("events").select(state.alias("state"), end.alias("e")).groupBy("state").agg(F.count("*").alias("n"), F.date_format(F.max("e"), "yyyy-MM-dd HH:mm").alias("last_end"))


@query("s8_fetch_plan", r"""
WITH c AS (SELECT url, max(CASE page_id % 3 WHEN 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2023-12-01 00:00:00' END) AS f FROM pages WHERE page_id % 4 <> 1 GROUP BY 1),
r AS (SELECT page_id, url, CASE WHEN f > TIMESTAMP '2023-12-26 00:00:00' THEN 'hit' ELSE 'fetch' END AS action, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages LEFT JOIN c USING (url))
SELECT page_id, action, CASE WHEN action = 'fetch' THEN (row_number() OVER (PARTITION BY host, action ORDER BY url) - 1) // 2 END::BIGINT AS window FROM r""")
def s8(read):
    """Pages of a week's cache and the others, two of a host in each window. Pages of one url, whose order the SQL leaves open, go by page_id."""
    at = F.when(F.col("page_id") % 3 == 0, "2024-01-01").otherwise("2023-12-01").cast("timestamp_ntz")
    cache = read("pages").filter("page_id % 4 <> 1").select("url", at.alias("fetched_at"))
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return V.fetch_plan(read("pages").select("page_id", "url"), cache, "url", host, F.lit("2024-01-02").cast("timestamp_ntz"), 7 * 86400, 2, ["page_id"]).select("page_id", "action", F.col("window").cast("long").alias("window"))


_SIGNATURES = {"actors": "p_type", "actions": "p_size", "objects": "p_name", "edge_types": "p_partkey % 10", "edge_roles": "concat(p_type, ':', p_size % 5)"}


@query("u5_relational_similarity", f"""
WITH s AS (SELECT p_brand, {', '.join(f"list(DISTINCT ({v})::VARCHAR) AS {k}" for k, v in _SIGNATURES.items())} FROM part GROUP BY 1)
SELECT a.p_brand AS a, b.p_brand AS b, round(({' + '.join(f"len(list_intersect(a.{k}, b.{k}))::DOUBLE / len(list_distinct(list_concat(a.{k}, b.{k})))" for k in _SIGNATURES)}) / 5, 6) AS similarity FROM s a JOIN s b ON a.p_brand < b.p_brand""")
def u5b(read):
    """Five sets of each brand, compared pairwise: brands are a dimension of fixed size."""
    from functools import reduce

    s = read("part").groupBy("p_brand").agg(*[F.collect_set(F.expr(v).cast("string")).alias(k) for k, v in _SIGNATURES.items()])
    a, b = (s.select(*[F.col(c).alias(f"{side}_{c}") for c in s.columns]) for side in "ab")
    both = a.join(b, F.col("a_p_brand") < F.col("b_p_brand"))
    total = reduce(lambda x, y: x + y, [T.jaccard(F.col(f"a_{k}"), F.col(f"b_{k}")) for k in _SIGNATURES])
    return both.select(F.col("a_p_brand").alias("a"), F.col("b_p_brand").alias("b"), F.round(total / 5, 6).alias("similarity"))
