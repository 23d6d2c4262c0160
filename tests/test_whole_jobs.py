"""Registered queries over small tables that reach past the ids, values and lengths they once stopped at."""

from __future__ import annotations

import pytest

from docloom.plans import QUERIES


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """1,100 parts, and a lineitem row of small quantity for each third of them and for suppliers 1 to 9."""
    sf = str(tmp_path_factory.mktemp("parts"))
    spark.range(1101).withColumnRenamed("id", "p_partkey").write.parquet(f"{sf}/part.parquet")
    spark.range(0, 2000, 3).selectExpr("id as l_partkey", "id % 9 + 1 as l_suppkey", "cast(id % 50 as double) as l_quantity").write.parquet(f"{sf}/lineitem.parquet")
    return sf


@pytest.fixture(scope="module")
def distances():
    """Least steps from every node to each of its ancestors."""
    d = {0: {0: 0}}
    for n in range(1, 1101):
        d[n] = {n: 0}
        for p in (n // 3, n // 5):
            for a, k in d[p].items():
                d[n][a] = min(d[n].get(a, 99), k + 1)
    return d


def test_hierarchy_queries_take_every_part(spark, parts, distances):
    pairs = [(n, a) for n in distances for a in distances[n]]
    assert rows(QUERIES["g8_closure"](spark, parts)) == sorted(pairs)
    assert rows(QUERIES["g9_ancestor_distance"](spark, parts)) == sorted((n, a, distances[n][a]) for n, a in pairs)
    bad = {(n, a, b) for n in distances for a, b in ((3, 5), (4, 7), (9, 11)) if a in distances[n] and b in distances[n]}
    culprits = sorted((n, a, b, not {(n // 3, a, b), (n // 5, a, b)} & bad) for n, a, b in bad)
    assert rows(QUERIES["g10_disjointness"](spark, parts)) == culprits and max(culprits)[0] > 800
    assert rows(QUERIES["g11_mixed_order"](spark, parts)) == [(n,) for n in range(0, 1101, 3)]
    kept = sorted((n, p) for n in range(1, 1101) for p in {n // 3, n // 5} if not any(q != p and p in distances[q] for q in (n // 3, n // 5)))
    assert rows(QUERIES["g12_transitive_reduction"](spark, parts)) == kept
    nearest = sorted((n, n + 7, min((k + distances[n + 7][a], a) for a, k in distances[n].items() if a in distances[n + 7])[1]) for n in range(1094))
    assert rows(QUERIES["g13_nearest_common"](spark, parts)) == nearest


def test_longest_paths_take_every_part(spark, parts):
    depth = dict.fromkeys(range(1101), 0)
    for n in range(1100, 0, -1):
        for p in (n // 3, n // 5):
            depth[p] = max(depth[p], depth[n] + 1)
    assert rows(QUERIES["a22_longest_path"](spark, parts)) == sorted(depth.items())


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """600 cheap orders, each of a customer of a smaller or larger number, and one lineitem row of small quantity for each."""
    sf = str(tmp_path_factory.mktemp("orders"))
    o = spark.range(600).selectExpr("id as o_orderkey", "(id * id + 7) % 300 as o_custkey", "1000D as o_totalprice")
    o.write.parquet(f"{sf}/orders.parquet")
    spark.range(1).withColumnRenamed("id", "p_partkey").write.parquet(f"{sf}/part.parquet")
    spark.range(600).selectExpr(
        "id % 40 as l_partkey", "id % 7 as l_suppkey", "timestamp_ntz'1998-01-01' as l_shipdate", "90000D + id as l_extendedprice", "if(id % 2 = 0, 'R', 'N') as l_returnflag", "1D as l_quantity"
    ).write.parquet(f"{sf}/lineitem.parquet")
    return sf


def test_components_take_every_order(spark, orders):
    to = {n: (n * n + 7) % 300 for n in range(600)}
    reach = {}
    for n in to:
        reach[n], at = {n}, to[n]
        while at not in reach[n]:
            reach[n].add(at)
            at = to[at]
    assert rows(QUERIES["g6_strong_components"](spark, orders)) == sorted((n, min(m for m in reach[n] if n in reach[m])) for n in to)
    low = {n: n for n in to}
    while True:
        new = dict(low)
        for a, b in to.items():
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            break
        low = new
    assert rows(QUERIES["g7_components"](spark, orders)) == sorted(low.items())


def test_edges_take_every_line(spark, orders):
    lines = [(n % 40, n % 7 + 1000000, 90000 + n, "RN"[n % 2]) for n in range(600)]
    pairs = {(s, d): [x for x in lines if x[:2] == (s, d)] for s, d, *_ in lines}
    returned = {k: sum(x[3] == "R" for x in v) for k, v in pairs.items()}
    assert rows(QUERIES["g1_edge_lookup"](spark, orders)) == sorted((*k, n) for k, n in returned.items() if n)
    near = {d for s, d in pairs if s == 7} | {7}
    assert rows(QUERIES["g3_ball"](spark, orders)) == sorted((*k, max(x[2] for x in v)) for k, v in pairs.items() if near & set(k))
    degree = {}
    for (s, d), n in returned.items():
        degree[s], degree[d] = degree.get(s, 0) + n, degree.get(d, 0) + n
    assert rows(QUERIES["g5_hit_degrees"](spark, orders)) == sorted((k, n) for k, n in degree.items() if n)
    assert sum(r.edges for r in QUERIES["g22_node_rollup"](spark, orders).collect()) == 600
    assert QUERIES["g3_induced"](spark, orders).count() == 0


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """700 events of 70 users, 60 orders with two lines of one part, and 120 vectors."""
    sf = str(tmp_path_factory.mktemp("events"))
    kinds = "element_at(array('view', 'click', 'error'), cast(id % 3 + 1 as int))"
    spark.range(700).selectExpr("id as event_id", "timestamp_ntz'1998-01-01' as ts", "id % 70 as user_id", f"{kinds} as event_type", "cast(id % 11 as double) as value").write.parquet(f"{sf}/events.parquet")
    spark.range(60).selectExpr("id * 100 as o_orderkey", "1L as o_custkey", "timestamp_ntz'1998-01-01' as o_orderdate").write.parquet(f"{sf}/orders.parquet")
    spark.range(120).selectExpr("id div 2 * 100 as l_orderkey", "1L as l_partkey", "cast(id % 2 + 1 as int) as l_linenumber", "timestamp_ntz'1998-01-01' as l_shipdate").write.parquet(f"{sf}/lineitem.parquet")
    spark.sql("select 1L as p_partkey, 'Brand#1' as p_brand").write.parquet(f"{sf}/part.parquet")
    spark.range(120).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast((id * i) % 17 as float)) as embedding", "cast(id % 3 as int) as label").write.parquet(f"{sf}/embeddings.parquet")
    return sf


def test_no_id_is_left_out(spark, events):
    assert QUERIES["m3_segments"](spark, events).count() == 70
    assert {r.user_id for r in QUERIES["v9_proposals"](spark, events).collect()} == set(range(70))
    assert [(r["count"], r.unit_count) for r in QUERIES["a12_structure_report"](spark, events).collect()] == [(120, 60)]
    assert QUERIES["dt6_epoch"](spark, events).count() == 700
    # all scopes begin on one day; the shortest (order keys of 0 and multiples of 900 last a day) of the smallest key is even
    assert rows(QUERIES["j12_smallest_scope"](spark, events).select("l_orderkey", "l_linenumber", "bk")) == sorted((o * 100, n, 0) for o in range(60) for n in (1, 2))


def test_searches_ask_with_every_fiftieth_row(spark, events):
    sig = {i: (i % 3, i % 3) for i in range(700)}
    obj = {i: (round(i % 11) % 4 if i % 2 == 0 else None) for i in range(700)}
    expected = sorted((a, sum(sig[a] == sig[b] and obj[a] in (None, obj[b]) for b in range(700))) for a in range(0, 700, 50))
    assert rows(QUERIES["v8_prefilter"](spark, events)) == expected
    v = [[(n * i) % 17 for i in range(1, 65)] for n in range(120)]
    dots = [(q, sorted((-sum(x * y for x, y in zip(v[q], v[n], strict=True)), n) for n in range(120))[:20]) for q in (0, 50, 100)]
    assert rows(QUERIES["m11_embedding_scores"](spark, events).select("query_id", "vec_id", "dot")) == sorted((q, n, -d) for q, best in dots for d, n in best)


def test_products_are_the_same_in_any_blocks(spark, events):
    from docloom.operators.search import best_products

    e = spark.read.parquet(f"{events}/embeddings.parquet")
    assert rows(best_products(e, e, "vec_id", "embedding", 5, block=7)) == rows(best_products(e, e, "vec_id", "embedding", 5))


def test_whole_values_are_read(spark, tmp_path):
    # the first eight dimensions are the same for all vectors, the rest tell the labels apart
    vectors = [(i, [1.0] * 8 + [float(i % 2 == k % 2) for k in range(56)], i % 2) for i in range(10)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(QUERIES["j15_scored_pairs"](spark, str(tmp_path))) == [(i, i % 2) for i in range(10)]

    spark.createDataFrame([(1, 0, "user", "word " * 9 + "\nend")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(QUERIES["s9_message_import"](spark, str(tmp_path))) == [(1, 0, "00:05", "user", 49)]

    items = [(1, "one two three four five six"), (2, "tail of three"), (3, "four five six seven")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, "x three four five six seven", "en", "src3"), (2, "a tail of three", "en", "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(QUERIES["t18_phrase_spans"](spark, str(tmp_path))) == [(1, 1, 1, 5), (1, 3, 2, 6), (2, 2, 1, 4)]
    assert rows(QUERIES["s13_policy_gate"](spark, str(tmp_path))) == [(1, docs[0][1]), (2, docs[1][1])]
