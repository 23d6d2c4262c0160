"""Exact rules on small cases."""

from __future__ import annotations

import html as python_html
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import factors, graph, search, stats, text_stats
from docloom.sources import files, html
from docloom.streaming import keyed


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numeric_keys(spark):
    cases = {
        "$5 million": "5e6|usd", "US$ 1.50 billion": "1.5e9|usd", "5%": "", "5 %": "5|percent", "3 per cent": "3|percent", "1,200": "1200|", "-0": "0|", "+007.50": "7.5|", "12 days": "12|day", "5million": "5|million",
        "a$3 thousand": "3e3|aud", "£0 million": "0|gbp", "2 million million usd": "2e6|usd", "5 day month": "", "5 apples": "", "": "", "usd 7": "7|usd", "seven": "", "1.2.3": "", "5 million day": "", "$ 4 dollars": "4|usd",
    }
    assert one(spark, T.numeric_key, *cases) == list(cases.values())


def test_modal_phrases_and_obligations(spark):
    cases = {"It may not, and must": "prohibition", "they do not apply": "exclusion", "this is required to": "obligation", "Mayor must.": "obligation", "no modal here": None, "": None, "may": "permission"}
    assert one(spark, T.modality, *cases) == list(cases.values())
    docs = spark.createDataFrame([(1, "(b) The lessee must, to repair walls until May; nothing here. is to"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in text_stats.obligations(docs, "doc_id").orderBy("clause").collect()] == [(1, 0, "obligation", "must", "the lessee", "repair", "walls"), (1, 2, "obligation", "is to", None, None, None)]


def test_canonical_tokens_and_folding(spark):
    got = one(spark, T.canonical_tokens, "The Organisations EMPHASISED Straße's ſun to x 7 99", None)
    assert got == [["99", "emphasized", "organizations", "strasse's", "sun"], []]
    words = ["Straße", "ΑΣ", "ﬁne", "İ", "Ǆ", "K"]
    assert one(spark, T.casefold, *words) == [w.casefold() for w in words]
    assert one(spark, T.without_enumeration, "1.2) Head", " 3-4. x ", "4th", "none", None) == ["Head", "x", "th", "none", ""]


def test_lexeme_forms(spark):
    docs = spark.createDataFrame([("Ａｂ ﬁ  ½ x​ €$ .! AB ab Ab aB",)], "text string")
    rows = {r.surface: r for r in text_stats.lexemes(docs).collect()}
    assert (rows["Ａｂ"].norm, rows["Ａｂ"].kind, rows["Ａｂ"].flags) == ("ab", "word", T.TITLE | T.HAS_LETTER)
    assert rows["ﬁ"].norm == unicodedata.normalize("NFKC", "ﬁ") and rows["  "].norm == " " and rows["  "].flags == 0 and rows["  "].kind == "ws"
    assert (rows["€"].kind, rows["€"].flags) == ("symbol", T.NON_ASCII | T.HAS_SYMBOL) and rows["."].flags == T.HAS_PUNCT
    assert [rows[w].flags & 15 for w in ("AB", "ab", "Ab", "aB")] == [T.ALL_UPPER, T.ALL_LOWER, T.TITLE, T.MIXED_CASE]


def test_simhash_equals_counting_bits(spark):
    from hashlib import md5

    r = random.Random(4)
    texts = ["", None, *[" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in (1, 2, 126, 127, 128, 129, 700)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in text_stats.simhash(docs).collect():
        words = (texts[row.doc_id] or "").split()
        hashes = [int.from_bytes(md5(w.encode()).digest()[8:], "big") for w in words]
        assert row.simhash == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes)):016x}"


def test_concepts_are_substrings_and_overlap(spark):
    docs = spark.createDataFrame([(1, "Ananas É"), (2, None), (3, "x")], "doc_id long, text string")
    concepts = spark.createDataFrame([("a", "ana"), ("b", "NAN"), ("b", "ana"), ("c", "é"), ("d", ""), (None, None)], "concept_id string, phrase string")
    assert sorted(tuple(r) for r in text_stats.concept_spans(docs, concepts).collect()) == [(1, "a", 0, 3), (1, "a", 2, 5), (1, "b", 0, 3), (1, "b", 1, 4), (1, "b", 2, 5), (1, "c", 7, 8)]
    assert text_stats.concept_spans(docs, concepts.limit(0)).count() == 0


def test_repeated_labels_keep_their_distance(spark):
    rows = [(1, "a", s) for s in (0, 150, 210, 390, 420)] + [(1, "b", s) for s in (0, 199, 398)] + [(2, "", s) for s in (0, 300, 600)]
    got = text_stats.repeated_labels(spark.createDataFrame(rows, "d int, l string, s int"), "d", "l", "s").collect()
    assert [tuple(r) for r in got] == [(1, "a", 3)]


def test_html_text(spark):
    pages = ["a &amp; b &lt;x&gt; &eacute; &#233; &#xE9; &copy;&unknown; & &; &#x1F600; &amp;lt; &hellip;", "none", "&#0;&#xD800;", ""]
    assert one(spark, html.unescaped, *pages) == [python_html.unescape(p) for p in pages]
    nested = "<template>a<template>b</template>c</template>d<SCRIPT>var x='</p>';</script ><p>e<br>f <!-- <p>g --> h</p>\n<style>i</style>"
    assert one(spark, html.visible, nested, None, "<p>" * 20_000 + "end") == ["d\ne\nf h", None, "end"]


def test_beta_quantiles(spark):
    assert abs(float(stats.beta_cdf(0.4, 2, 3)) - 0.5248) < 1e-12 and abs(float(stats.beta_cdf(0.7, 1, 1)) - 0.7) < 1e-12
    rows = spark.createDataFrame([(0.5, 0, 0), (1e-5, 10**8, 1000), (1e-4, 10**6, 100), (0.2, 10, 9)], "mu double, n long, y long")
    for r in stats.credible_interval(rows).collect():
        a, b = r.mu * 40 + r.y, (1 - r.mu) * 40 + r.n - r.y
        assert abs(float(stats.beta_cdf(r.low, a, b)) - 0.1) < 1e-9 and abs(float(stats.beta_cdf(r.high, a, b)) - 0.9) < 1e-9


def test_components_with_hubs(spark):
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 1500)] + [(10**6, i) for i in range(9000, 9600)] + [(i, i + 1) for i in range(5000, 5020)] + [(r.randrange(20_000, 21_500), r.randrange(20_000, 21_500)) for _ in range(600)] + [(7, 7)]
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    got = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert sorted(tuple(x) for x in got) == sorted((x, root(x)) for x in up)


def test_draft_duplicates_equal_the_greedy_rule(spark):
    r = random.Random(6)
    rows = []
    for case in range(3):
        base = [r.getrandbits(64) for _ in range(6)]
        for i in range(60):
            h = r.choice(base)
            for _ in range(r.randint(0, 3)):
                h ^= 1 << r.randrange(64)
            rows.append((case, r.randint(0, 3), case * 1000 + i, h))
    want = []
    for case in range(3):
        free = sorted((x for x in rows if x[0] == case), key=lambda x: x[2])
        while free:
            hit = [x for x in free[1:] if x[1] != free[0][1] and (x[3] ^ free[0][3]).bit_count() <= 3]
            want += [(free[0][2], x[2]) for x in ([free[0], *hit] if hit else [])]
            free = [x for x in free[1:] if x not in hit]
    df = spark.createDataFrame([(c, d, i, h - (1 << 64) if h >> 63 else h) for c, d, i, h in rows], "case_id int, draft int, row long, simhash long")
    assert sorted(tuple(x) for x in factors.draft_duplicates(df).collect()) == sorted(want)


def test_running_totals_cross_ranges(spark):
    rows = [(f"{i:04d}", i % 7) for i in range(500)]
    got = {r.k: r.before for r in files.running_totals(spark.createDataFrame(rows, "k string, v long").repartition(5), "k", "v").collect()}
    assert got == {k: sum(v for _, v in rows[:i]) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("order", [[1, 2, 3], [3, 1, 2], [2, 2, 1, 3, 3, 9, 8]])
def test_turns_are_counted_once(order):
    ranges: list = []
    added = [keyed._with_turn(ranges, t) for t in order]
    assert sum(added) == len(set(order)) and ranges == ([[1, 3]] if max(order) == 3 else [[1, 3], [8, 9]])


def test_inbox_drops_nothing(spark):
    rows = spark.range(100).selectExpr("id % 2 as o", "id")
    got = keyed.inbox(rows, ["o"], ["id"], limit=5, release=8).collect()
    assert len(got) == 100 and sum(r.state == "admitted" for r in got) == 10 and max(r["round"] for r in got) == 6


def test_inferred_facts(spark):
    facts = spark.createDataFrame([("a", "in", "b"), ("b", "in", "c"), ("c", "in", "a"), ("c", "near", "d")], "s string, p string, o string")
    got = {tuple(r) for r in graph.infer(facts, [("in", "in", "in"), ("in", "near", "near")]).collect()}
    assert got == {(x, "in", y) for x in "abc" for y in "abc"} | {(x, "near", "d") for x in "abc"}


def test_best_products_are_those_of_numpy(spark):
    v = np.random.default_rng(1).normal(size=(40, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, e array<float>")
    got = {(r.query_id, r.id) for r in search.best_products(df, df, "id", "e", 3).collect()}
    dots = v.astype(float) @ v.astype(float).T
    assert got == {(q, int(n)) for q in range(40) for n in np.lexsort((np.arange(40), -dots[q]))[:3]}
