"""Order-dependent operators, files, exports and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.lattice import fibre_outcome
from ..operators import factors as X
from ..operators import text_stats as TS
from ..operators import versioned as V
from ..sources import files
from .registry import query


@query("s1_inventory", """
WITH f AS (SELECT source || '/' || lpad(doc_id::VARCHAR, 6, '0') || CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' WHEN 2 THEN '.bin' ELSE '.md' END AS path, n_chars AS bytes, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'unsupported' ELSE 'text' END AS adapter FROM documents),
t AS (SELECT *, sum(CASE WHEN adapter <> 'unsupported' AND bytes <= 9000 THEN bytes ELSE 0 END) OVER (ORDER BY regexp_replace(path, '/[^/]*$', ''), path) AS total FROM f)
SELECT path, bytes, adapter, CASE WHEN adapter = 'unsupported' THEN 'unsupported' WHEN bytes > 9000 THEN 'too_large' WHEN total > 800000 THEN 'over_total' ELSE 'admitted' END AS status FROM t""")
def s1(read):
    ext = F.get(F.array(*[F.lit(x) for x in (".txt", ".html", ".bin", ".md")]), (F.col("doc_id") % 4).cast("int"))
    f = read("documents").select(F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), ext).alias("path"), F.col("n_chars").alias("bytes"))
    return files.admitted(f, 9000, 800000)


@query("s2_dispatch", "SELECT CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' ELSE 'unsupported' END AS adapter, count(*) AS n FROM documents GROUP BY 1")
def s2(read):
    path = F.get(F.array(F.lit("a.TXT"), F.lit("b.pdf"), F.lit("c.xyz")), (F.col("doc_id") % 3).cast("int"))
    return read("documents").select(files.adapter(path).alias("adapter")).groupBy("adapter").agg(F.count("*").alias("n"))


@query("s3_text_segments", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
s AS (SELECT doc_id, i, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l)
SELECT doc_id, i AS segment, start, start + length(t) AS "end" FROM s WHERE t <> ''""")
def s3(read):
    return files.text_segments(read("documents")).select("doc_id", F.col("segment").cast("long").alias("segment"), "start", "end")


@query("s10_import_upsert", "SELECT user_id, event_type, max_by(event_id, (run, event_id)) AS event_id, CASE WHEN max(run) = 1 THEN 'run-2' ELSE 'run-1' END AS import_run_id FROM (SELECT *, (event_id >= 5000)::INT AS run FROM events) GROUP BY 1, 2")
def s10(read):
    e = read("events")
    have, new = (e.filter(t).groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id")) for t in ("event_id < 5000", "event_id >= 5000"))
    return files.import_run(have.withColumn("import_run_id", F.lit("run-1")), new, ["user_id", "event_type"], "run-2")


@query("s12_dot_export", """SELECT r_name, 'digraph {' || chr(10) || string_agg('  "' || r_name || '" -> "' || n_name || '";', chr(10) ORDER BY '  "' || r_name || '" -> "' || n_name || '";') || chr(10) || '}' AS graph FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def s12(read):
    return files.dot(read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")), "r_name", "r_name", "n_name")


@query("t8_legal_tokens")
def t8(read):
    return X.legal_tokens(read("benchmark").withColumnRenamed("item_id", "doc_id")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("t14_draft_duplicates")
def t14(read):
    """Documents of a source as drafts of one case."""
    d = TS.simhash(read("documents"), "doc_id", "source")
    rows = d.select(F.col("source").alias("case_id"), (F.col("doc_id") % 7).alias("draft"), F.col("doc_id").alias("row"), F.conv("simhash", 16, -10).cast("long").alias("simhash"))
    return X.draft_duplicates(rows)


@query("t14_close_pairs", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(token), 17, 16))::UBIGINT AS h FROM t),
b AS (SELECT doc_id, i, sum(((h >> i) & 1)::INT) AS ones, count(*) AS n FROM h, range(64) r(i) GROUP BY 1, 2), f AS (SELECT doc_id, sum(CASE WHEN 2 * ones >= n THEN (1::HUGEINT << i::HUGEINT) ELSE 0 END)::UBIGINT AS f FROM b GROUP BY 1)
SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.doc_id < y.doc_id AND bit_count(xor(x.f, y.f)) <= 3""")
def t14b(read):
    return X.close_pairs(TS.simhash(read("documents")).select(F.col("doc_id").alias("id"), F.conv("simhash", 16, -10).cast("long").alias("h")))


@query("t23_structural", r"WITH x AS (SELECT 'path_ref' AS kind, unnest(regexp_extract_all(url, '(?:/[\w.-]+){2,}')) AS s FROM pages UNION ALL SELECT 'mail_ref', unnest(regexp_extract_all(url, '[\w.]+@[\w.]+')) FROM pages UNION ALL SELECT 'number_ref', unnest(regexp_extract_all(url, '\b\d{2,}\b')) FROM pages) SELECT kind, count(*) AS n, count(DISTINCT s) AS surfaces FROM x GROUP BY 1")
def t23(read):
    return X.structural_occurrences(read("pages"), "page_id", "url").groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("surface").alias("surfaces"))


@query("t33_glossary", r"WITH g AS (SELECT min(p_partkey) AS term_id, lower(trim(p_name)) AS term FROM part GROUP BY 2), w AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT term_id, sum(n)::BIGINT AS uses FROM part JOIN g ON lower(trim(p_name)) = term JOIN w ON l_partkey = p_partkey GROUP BY 1")
def t33(read):
    p = read("part").select("p_partkey", F.lower(F.trim("p_name")).alias("term"))
    g = p.groupBy("term").agg(F.min("p_partkey").alias("term_id"))
    uses = read("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return uses.join(p, "p_partkey").join(g, "term").groupBy("term_id").agg(F.sum("n").alias("uses"))


@query("t34_closest_statement", """
WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9'']+'), lambda x: length(x) >= 2 AND x NOT IN (""" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + """))) AS s FROM conversations),
p AS (SELECT a.conv_id * 1000 + a.turn AS claim, b.conv_id * 1000 + b.turn AS stmt, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS u FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant')
SELECT claim, max_by(stmt, (i / u, -stmt)) AS stmt, round(max(i / u), 6) AS score FROM p WHERE i > 0 GROUP BY 1""")
def t34(read):
    c = read("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    claims = c.filter("role = 'user'").select("conv_id", F.col("id").alias("claim"), "text")
    statements = c.filter("role = 'assistant'").select("conv_id", F.col("id").alias("stmt"), "text")
    return X.closest_statement(claims, statements, "conv_id", "claim", "stmt")


@query("m3_segments")
def m3(read):
    e = read("events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), (F.col("value") / 50).alias("cost"))
    return X.best_segments(e, "user_id").withColumn("cost", F.round("cost", 6))


@query("v9_proposals")
def v9(read):
    roles = F.create_map(F.lit("actor"), (F.col("event_id") % 3).cast("string"), F.lit("object"), (F.bround("value", 0).cast("int") % 2).cast("string"))
    p = read("events").select(F.col("event_id").alias("proposal_ref"), "user_id", "event_type", roles.alias("roles"))
    return X.reduce_proposals(p, ["user_id", "event_type"])


@query("v9_valid_inputs", "SELECT count(*) AS valid FROM (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderkey % 1500 IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def v9b(read):
    p = read("orders").select(F.col("o_orderkey").alias("proposal_ref"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 1500).alias("inputs"))
    return X.valid_proposals(p, "inputs", read("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("ref"))).agg(F.count("*").alias("valid"))


@query("v10_constraints", "SELECT o_custkey AS constraint_ref, count(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS missing FROM orders GROUP BY 1")
def v10(read):
    c = read("orders").groupBy(F.col("o_custkey").alias("constraint_ref")).agg(F.collect_set("o_orderpriority").alias("needs"))
    facts = read("orders").filter("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("fact"))
    return X.satisfied(c, facts)


@query("v11_lifecycle", "SELECT o_orderkey, CASE WHEN NOT ok THEN 'rejected' WHEN n >= 3 THEN 'resolved' WHEN n > 0 THEN 'admitted' ELSE 'assessed' END AS stage FROM (SELECT o_orderkey, o_totalprice > 1000 AS ok, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)")
def v11(read):
    n = read("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    j = read("orders").join(n, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("o_orderkey", F.when(F.col("o_totalprice") <= 1000, "rejected").when(F.col("n") >= 3, "resolved").when(F.col("n") > 0, "admitted").otherwise("assessed").alias("stage"))


@query("v14_identity_witnesses", "SELECT a.user_id, a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND a.value = b.value")
def v14(read):
    e = read("events").select("user_id", "event_type", "value", "event_id")
    b = e.withColumnRenamed("event_id", "b")
    return e.withColumnRenamed("event_id", "a").join(b, ["user_id", "event_type", "value"]).filter("a < b").select("user_id", "a", "b")


@query("v17_parity", "SELECT (SELECT count(*) FROM (SELECT md5(text) FROM documents WHERE doc_id < 600 EXCEPT SELECT md5(text) FROM documents WHERE doc_id >= 400)) AS missing, (SELECT count(*) FROM (SELECT md5(text) FROM documents WHERE doc_id >= 400 EXCEPT SELECT md5(text) FROM documents WHERE doc_id < 600)) AS extra")
def v17(read):
    d = read("documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.bool_or(F.col("doc_id") < 600).alias("a"), F.bool_or(F.col("doc_id") >= 400).alias("b"))
    return d.agg(F.count_if(F.col("a") & ~F.col("b")).alias("missing"), F.count_if(F.col("b") & ~F.col("a")).alias("extra"))


@query("v21_revision_pack", "SELECT status, count(*) AS n, min(l_partkey) AS first_part FROM (SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' WHEN a.q <> b.q THEN 'modified' ELSE 'unchanged' END AS status FROM (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a FULL JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) b ON a.l_partkey = b.l_partkey) GROUP BY 1")
def v21(read):
    from ..operators.joins import align

    a, b = (read("lineitem").filter(F.col("l_linenumber") == n).groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")) for n in (1, 2))
    return align(a, b, ["l_partkey"], ["q"]).groupBy("status").agg(F.count("*").alias("n"), F.min("l_partkey").alias("first_part"))


@query("v24_enrichment", "SELECT c_custkey, n_name, CASE WHEN s.n IS NULL THEN 'no_evidence' WHEN s.n = 1 THEN 'single' ELSE 'several' END AS evidence FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = c_nationkey")
def v24(read):
    s = read("supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("n").isNull(), "no_evidence").when(F.col("n") == 1, "single").otherwise("several")
    return read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(s, "c_nationkey", "left").select("c_custkey", "n_name", kind.alias("evidence"))


@query("v6_fibre_outcome", "SELECT user_id, CASE WHEN count(*) < 100 THEN 'inapplicable' WHEN bool_or(value > 200) AND bool_or(value < 0.1) THEN 'both' WHEN bool_or(value > 200) THEN 'satisfied' WHEN bool_or(value < 0.1) THEN 'violated' ELSE 'undetermined' END AS outcome FROM events GROUP BY 1")
def v6b(read):
    g = read("events").groupBy("user_id").agg(F.count("*").alias("n"), F.bool_or(F.col("value") > 200).alias("s"), F.bool_or(F.col("value") < 0.1).alias("c"))
    return g.select("user_id", fibre_outcome(F.col("s"), F.col("c"), F.col("n") >= 100).alias("outcome"))


@query("g17_relation_signatures", "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag || ':' || l_linestatus)), ',') AS signature FROM lineitem GROUP BY 1")
def g17(read):
    return read("lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "l_returnflag", "l_linestatus"))), ",").alias("signature"))


@query("v1_bitemporal", """
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate AS vf, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS vt FROM orders)
SELECT o_orderkey FROM v WHERE vf <= TIMESTAMP '1998-06-01' AND (vt IS NULL OR vt > TIMESTAMP '1998-06-01') AND vf + INTERVAL '30 days' <= TIMESTAMP '1998-06-15'""")
def v1(read):
    """Valid at one time as recorded at another; rows are on record from 30 days after they begin."""
    o = V.validity(read("orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    o = o.withColumn("recorded_from", F.col("valid_from") + F.expr("interval 30 days")).withColumn("recorded_to", F.lit(None).cast("timestamp_ntz"))
    return V.as_at(o, "1998-06-01", "1998-06-15").select("o_orderkey")


@query("t17_page_sentences", r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT *, regexp_matches(page, '[.!?]\s*$') AS ends FROM s WHERE page <> '')
SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE NOT ends) AS open_pages, count(*) FILTER (WHERE NOT coalesce(prev, true)) AS continued FROM (SELECT *, lag(ends) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM n) GROUP BY 1""")
def t17(read):
    """Whether a sentence goes on over a page boundary, by punctuation; a line stands for a page."""
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "page")).filter("page <> ''").withColumn("ends", F.rlike("page", F.lit(r"[.!?]\s*$")))
    w = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("prev", F.lag("ends").over(w))
    return lines.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("ends")).alias("open_pages"), F.count_if(~F.coalesce("prev", F.lit(True))).alias("continued"))


@query("t20_symbol_cues", """
WITH e AS (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q(cue, x, y, z) AS (VALUES (1, 'view', 'click', 'purchase'), (2, 'signup', 'view', 'view'), (3, 'error', 'error', 'error'))
SELECT cue, count(*) AS hits, count(DISTINCT user_id) AS users FROM e JOIN q ON a = x AND b = y AND c = z GROUP BY 1""")
def t20(read):
    """Cues over sequences of symbols: consecutive symbols are joined with the cues as one key."""
    cues = read("events").sparkSession.createDataFrame([(1, "view", "click", "purchase"), (2, "signup", "view", "view"), (3, "error", "error", "error")], "cue int, a string, b string, c string")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read("events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c"))
    return e.join(F.broadcast(cues), ["a", "b", "c"]).groupBy("cue").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"))


@query("j15_scored_pairs", """
WITH x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS m FROM x GROUP BY 1),
s AS (SELECT vec_id, c.label, list_sum(list_transform(range(1, len(m) + 1), lambda i: embedding[i]::DOUBLE * m[i])) AS s FROM embeddings, c)
SELECT vec_id, label::BIGINT AS best FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) AS r FROM s) WHERE r = 1""")
def j15(read):
    """Each vector with the best of the labels' mean vectors: one row for each label, a dimension, is held as an array by every task."""
    e = read("embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    centres = means.agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("c"))

    def scored(c):
        return F.struct((-F.round(F.aggregate(F.zip_with("embedding", c["m"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y), 9)).alias("s"), c["label"].alias("label"))

    rows = e.crossJoin(F.broadcast(centres))  # one row
    return rows.select("vec_id", F.array_min(F.transform("c", scored)).alias("b")).select("vec_id", F.col("b.label").cast("long").alias("best"))


@query("g14_levels", "WITH RECURSIVE h AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), l(node, top, d) AS (SELECT child, parent, 1 FROM h UNION ALL SELECT l.node, h.parent, d + 1 FROM l JOIN h ON h.child = l.top) SELECT top AS node, d AS depth, count(*) AS below FROM l GROUP BY 1, 2")
def g14(read):
    """How many nodes lie below each node at each depth."""
    from ..operators.graph import ancestor_distance

    d = ancestor_distance(read("part").filter("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 3").alias("parent")))
    return d.filter("dist > 0").groupBy(F.col("ancestor").alias("node"), F.col("dist").alias("depth")).agg(F.count("*").alias("below"))


@query("m9_delta_codec", "SELECT user_id, count(*) AS n, sum(CASE WHEN d < 128 THEN 1 WHEN d < 16384 THEN 2 WHEN d < 2097152 THEN 3 ELSE 4 END)::BIGINT AS bytes FROM (SELECT user_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS d FROM events) GROUP BY 1")
def m9(read):
    """Bytes of each user's event ids as varint deltas of seven bits a byte."""
    d = F.col("event_id") - F.coalesce(F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(0))
    size = F.when(F.col("d") < 128, 1).when(F.col("d") < 16384, 2).when(F.col("d") < 2097152, 3).otherwise(4)
    return read("events").select("user_id", d.alias("d")).groupBy("user_id").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


@query("s9_message_import", r"""
WITH l AS (SELECT conv_id, turn, '[' || lpad((turn % 24)::VARCHAR, 2, '0') || ':05] ' || role || ': ' || text AS line FROM conversations)
SELECT conv_id, turn::BIGINT AS turn, regexp_extract(line, '^\[(\d\d:\d\d)\] (\w+): ', 1) AS clock, regexp_extract(line, '^\[(\d\d:\d\d)\] (\w+): ', 2) AS sender, length(regexp_replace(line, '^\[\d\d:\d\d\] \w+: ', ''))::BIGINT AS chars FROM l""")
def s9(read):
    """An exported chat's lines into clock, sender and text."""
    line = F.concat(F.lit("["), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":05] "), F.col("role"), F.lit(": "), F.col("text"))
    head = r"^\[(\d\d:\d\d)\] (\w+): "
    rows = read("conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), line.alias("line"))
    return rows.select("conv_id", "turn", F.regexp_extract("line", head, 1).alias("clock"), F.regexp_extract("line", head, 2).alias("sender"), F.length(F.regexp_replace("line", head, "")).cast("long").alias("chars"))


@query("x1_sql_surface", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def x1(read):
    """The same tables by SQL text."""
    return read("lineitem").sparkSession.sql(
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {t} WHERE l_shipdate <= timestamp_ntz'2000-09-02' GROUP BY 1, 2", t=read("lineitem")
    )


@query("x3_adapter_registry", "SELECT 'document' AS lane, count(*) AS n FROM documents UNION ALL SELECT 'page', count(*) FROM pages UNION ALL SELECT 'item', count(*) FROM benchmark")
def x3(read):
    """Lanes by name, each a function of the table reader."""
    lanes = {"document": lambda: read("documents").select("doc_id"), "page": lambda: read("pages").select("page_id"), "item": lambda: read("benchmark").select("item_id")}
    out = None
    for name, lane in lanes.items():
        rows = lane().agg(F.count("*").alias("n")).select(F.lit(name).alias("lane"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out
