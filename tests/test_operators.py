"""Small cases with the traps that whole tables don't hold."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import lattice as L
from docloom.functions import lens
from docloom.functions import text as T
from docloom.operators import factors, graph, joins, keyed, reports, stats, text_stats, versioned
from docloom.sources import files, html

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_jaccard_of_empty_sets_is_one(spark):
    a = F.array().cast("array<string>")
    assert one(spark, T.jaccard(a, a)) == 1.0 and one(spark, T.jaccard(a, F.array(F.lit("b")))) == 0.0


def test_cues_are_literal():
    with pytest.raises(ValueError, match="literal"):
        T.has_cue(F.col("t"), F.col("w"), "a.*b|c")


@pytest.mark.parametrize(("surface", "key"), [("$1,200.50", "1200.5|usd"), ("A$3 million", "3e6|aud"), ("50 per cent", "50|percent"), ("7 thousand", "7|thousand"), ("42", "42|"), ("none", "")])
def test_numeric_keys(spark, surface, key):
    assert one(spark, T.numeric_key(F.lit(surface))) == key


@pytest.mark.parametrize(("clause", "kind"), [("You must not go", "prohibition"), ("It may be", "permission"), ("He shall pay", "obligation"), ("This does not apply", "exclusion"), ("Nothing here", None)])
def test_modality(spark, clause, kind):
    assert one(spark, T.modality(F.lit(clause))) == kind


def test_visible_html(spark):
    page = '<p>a &amp; b</p><script>var t="</p>"; x</script><!-- c --><div>d<br>e</div><style>p{}</style>'
    assert one(spark, html.visible(F.lit(page))) == "a & b\nd\ne"


def test_repeats_and_diversity_equal_python(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(n)) for n in (0, 1, 2, 3, 30, 49, 50, 51, 120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in text_stats.ngram_repeats(docs, 3).collect():
        w = texts[x.doc_id].split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        assert (x.grams, x.distinct_grams, x.repeated) == (len(g), len(set(g)), sum(g.count(y) > 1 for y in g))
    for x in text_stats.window_diversity(docs).collect():
        w = texts[x.doc_id].split()
        parts = [w] if len(w) <= 50 else [w[i : i + 50] for i in range(len(w) - 49)]
        assert x.diversity == pytest.approx(sum(len(set(p)) / len(p) for p in parts) / len(parts))


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 25)), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(1, 25)), min_size=1, max_size=12), st.integers(1, 30))
def test_interval_join(spark, left, right, width):
    a = spark.createDataFrame([(g, i, s, s + n) for i, (g, s, n) in enumerate(left)], "g int, i int, a_s long, a_e long")
    b = spark.createDataFrame([(g, i, s, s + n) for i, (g, s, n) in enumerate(right)], "g int, j int, b_s long, b_e long")
    got = rows(joins.interval_join(a, b, ["g"], width, ("a_s", "a_e"), ("b_s", "b_e")).select("i", "j"))
    want = sorted((i, j) for i, (g, s, n) in enumerate(left) for j, (h, t, m) in enumerate(right) if g == h and s < t + m and t < s + n)
    assert got == want


def test_asof_join_takes_equal_times_and_leaves_none(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 2, 2), ("j", 5, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("k", 3, "a"), ("k", 5, "b"), ("k", 5, "c"), ("k", 9, "d")], "k string, u int, v string")
    assert {r.id: r.v for r in joins.asof_join(left, right, ["k"], "t", "u", ["v"], ["v"]).collect()} == {1: "c", 2: None, 3: None}


def test_alignment_statuses(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (3, "c", 3)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (4, "d", 4)], "k int, x string, y int")
    assert {r.k: (r.status, r.changed) for r in joins.align(old, new, ["k"], ["x", "y"]).collect()} == {1: ("unchanged", ""), 2: ("modified", "x,y"), 3: ("removed", ""), 4: ("added", "")}


def test_strict_winner_and_classes(spark):
    c = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("b", "x", 5), ("b", "y", 4), ("c", "x", 0), ("d", "x", 1), ("d", "y", 1), ("d", "z", 1)], "k string, t string, s int")
    assert {r.k: r.is_strict for r in keyed.strict_winner(c, ["k"], "s", ["t"]).collect()} == {"a": False, "b": True, "c": False, "d": False}
    assert {r.k: r["class"] for r in keyed.resolution_class(c, ["k"], "s", 2).collect()} == {"a": "unresolved", "b": "inductive_preference", "c": "deductive_unique", "d": "resource_limited"}


def test_as_at_bounds(spark):
    v = spark.createDataFrame([(1, "2020-01-01", "2021-01-01"), (2, "2021-01-01", None)], "id int, f string, t string").select("id", F.to_date("f").alias("valid_from"), F.to_date("t").alias("valid_to"))
    assert [r.id for r in versioned.as_at(v, "2021-01-01").collect()] == [2] and [r.id for r in versioned.as_at(v, "2020-12-31").collect()] == [1] and versioned.as_at(v, "2019-01-01").count() == 0


def test_revisions_and_upserts(spark):
    have = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc long, rev_id int, t string")
    new = spark.createDataFrame([(1, "c"), (2, "d"), (1, "e")], "doc long, t string")
    assert rows(versioned.append_revisions(have, new, "doc", ["t"])) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "e"), (2, 1, "d")]
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert rows(versioned.upsert(a, b, ["k"])) == [(1, "a"), (2, "B"), (3, "C")] and rows(versioned.upsert(a, b, ["k"], update=False)) == [(1, "a"), (2, "b"), (3, "C")]
    assert one(spark, versioned.hash_id("x", "id")) is not None


EDGES = [(1, 2, "2020-01-01", 5.0), (2, 3, None, 5.0), (2, 3, "2020-01-02", None), (3, 1, "2019-01-01", 1.0), (3, 3, "2020-01-01", 9.0), (4, 5, "2020-01-01", 1.0), (1, 2, "2021-01-01", 7.0), (2, 1, "2022-01-01", 2.0)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, date string, weight double").withColumn("date", F.to_date("date"))


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_graph_walks(spark, edges):
    assert rows(graph.ball(edges, nodes(spark, 1), 1).select("a", "b", "weight")) == [(1, 2, 7.0), (1, 3, 1.0)]
    assert rows(graph.ball(edges, nodes(spark, 1), 2, since="2020-01-01", min_weight=2.0).select("a", "b")) == [(1, 2)]
    assert rows(graph.induced(edges, nodes(spark, 4), 3).select("src", "dst")) == [(4, 5)]
    assert rows(graph.dated_hops(edges, nodes(spark, 1), 2, "2020-06-01").select("src", "dst")) == [(1, 2), (2, 3)]
    assert rows(graph.reach(edges, nodes(spark, 1), None)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.strong_components(edges.select("src", "dst"))) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert rows(graph.components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    with pytest.raises(ValueError, match="cycle"):
        graph.transitive_reduction(edges)


def test_culprits_are_topmost(spark):
    sub = spark.createDataFrame([(3, 1), (3, 2), (4, 3), (5, 4), (6, 1)], "child long, parent long")
    found = graph.disjointness(sub, spark.createDataFrame([(1, 2)], "a long, b long"))
    assert {r.node: r.culprit for r in found.collect()} == {3: True, 4: False, 5: False}


def atom(sig="s", dom="d", roles=None, pol="pos", quals=None):
    return {"signature": sig, "domain": dom, "roles": {k: {"value": v, "entity_type": "t", "status": "bound" if v else "variable"} for k, v in (roles or {"actor": "a"}).items()}, "polarity": pol, "qualifiers": quals or {}}


@pytest.mark.parametrize(("a", "b", "level"), [
    (atom(), atom(), L.EXACT), (atom(), atom(sig="x"), L.NO_TYPED_MEET), (atom(), atom(dom="x"), L.NO_TYPED_MEET), (atom(), atom(roles={"object": "a"}), L.NO_TYPED_MEET),
    (atom(), atom(roles={"actor": "b"}), L.CONTRADICTION), (atom(), atom(roles={"actor": None}), L.EXACT), (atom(quals={"q": "1"}), atom(quals={"q": "2"}), L.NO_TYPED_MEET),
    (atom(quals={"q": "1"}), atom(pol="neg"), L.PARTIAL), (atom(), atom(pol="neg"), L.CONTRADICTION), (atom(roles={"actor": "a", "object": "o"}), atom(), L.PARTIAL),
])
def test_meet(spark, a, b, level):
    kind = "struct<signature: string, domain: string, roles: map<string, struct<value: string, entity_type: string, status: string>>, polarity: string, qualifiers: map<string, string>>"
    df = spark.createDataFrame([(a, b)], f"a {kind}, b {kind}")
    assert df.select(L.meet("a", "b").alias("x")).first().x == level == df.select(L.meet("b", "a").alias("x")).first().x


@pytest.mark.parametrize(("spec", "value"), [(["div", ["const", 3], ["const", 0]], 0.0), (["sqrt", ["const", -4]], 0.0), (["blend", [[["const", 2], 1], [["const", 4], 3]]], 3.5), (["blend", []], 0.0), (["mask", ["const", 2], ["const", 0]], 0.0), (["clamp", ["const", 9], 0, 1], 1.0)])
def test_lens(spark, spec, value):
    assert one(spark, lens.compile_lens(spec)) == value
    with pytest.raises(ValueError, match="unknown"):
        lens.compile_lens(["nope"])


def test_statistics_guards_and_zero_priors(spark):
    df = spark.createDataFrame([("a", "x", 0), ("a", "y", 0)], "b string, g string, s int")
    with pytest.raises(ValueError, match="declared"):
        stats.outcome_counts(df, ["g"], "s", ["b"])
    with pytest.raises(ValueError, match="individual"):
        stats.guard(["user_id"], ["user_id"])
    assert stats.beta_binomial(df, ["b", "g"], ["b"], F.col("s") == 1).first()["mean"] == pytest.approx(1 / (1 + 40 + 1))
    tail = stats.log_normal_tail(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", -1.0)], "g string, v double"), ["g"], "v", 1.0).collect()
    assert {r.g: (r.mu is None, r.tail) for r in tail} == {"a": (True, None), "b": (False, 1.0)}


def test_ridge_logistic_separates(spark):
    r = random.Random(2)
    data = [("a", x := r.uniform(-1, 1), int(x + r.uniform(-0.3, 0.3) > 0)) for _ in range(300)]
    w = stats.ridge_logistic(spark.createDataFrame(data, "g string, x double, y int"), ["g"], ["x"], "y").first()
    assert w.n == 300 and w.x > 2 and abs(w.intercept) < 1.5


def test_micro_scores_of_nothing(spark):
    none = spark.createDataFrame([], "k int")
    assert tuple(reports.micro_scores(none, none, ["k"]).first()) == (0, 0, 0, 1.0, 1.0)


def test_greedy_groups_depend_on_order(spark):
    d = spark.createDataFrame([("c", 1, 1, 0b0), ("c", 2, 2, 0b111), ("c", 3, 3, 0b111111), ("c", 1, 4, 0b1)], "case_id string, draft int, row long, simhash long")
    assert rows(factors.draft_duplicates(d)) == [(1, 1), (1, 2)]
    pairs = factors.close_pairs(d.select(F.col("row").alias("id"), F.col("simhash").alias("h")))
    assert rows(pairs) == [(1, 2), (1, 4), (2, 3), (2, 4)]


def test_proposals_join_the_first_group_they_agree_with(spark):
    p = spark.createDataFrame([("b", 1, {"x": "1"}), ("b", 2, {"x": "2"}), ("b", 3, {"y": "9"}), ("b", 3, {"y": "9"}), ("b", 4, {"x": "1", "y": "8"})], "k string, proposal_ref long, roles map<string, string>")
    assert rows(factors.reduce_proposals(p, ["k"])) == [("b", 1, 2, 2), ("b", 2, 1, 2), ("b", 4, 1, 2)]


def test_inventory(spark, tmp_path):
    for name, n in (("a.txt", 5), ("b.bin", 3), ("c.md", 900), ("d.html", 6)):
        (tmp_path / name).write_text("x" * n)
    got = {r.path.rsplit("/", 1)[1]: r.status for r in files.inventory(spark, str(tmp_path), max_file_bytes=100, max_total_bytes=8).collect()}
    assert got == {"a.txt": "admitted", "b.bin": "unsupported", "c.md": "too_large", "d.html": "over_total"}


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_exports_read_back(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    files.export(df, f"{tmp_path}/x", kind)
    back = spark.read.format(kind).schema(df.schema).option("header", True).load(f"{tmp_path}/x")
    assert rows(back.select("k", "v")) == [(1, "a"), (2, "b")]


def test_codebook_numbers_without_gaps(spark):
    df = spark.createDataFrame([(s,) for s in "bbbaacdd"], "s string").repartition(3)
    assert [(r.s, r.code) for r in keyed.codebook(df, "s").orderBy("code").collect()] == [("b", 0), ("a", 1), ("d", 2), ("c", 3)]
