"""Near-duplicates, decontamination, toxicity, the pipeline."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest

from docloom.llm import decontam, quality_rules, secret_scan, simhash_dedup, toxicity


def key(x):
    return tuple((v is not None, v) for v in x)


def test_covering_codes():
    golay, _, last = simhash_dedup.codes()
    assert golay.radius == 3 and last.radius == 1
    words = np.random.default_rng(1).integers(0, 1 << 23, 500)
    homes = golay.home(words)
    assert (np.bitwise_count(homes ^ words) <= 3).all() and (golay.syndrome(homes) == 0).all()
    near = words ^ (1 << np.random.default_rng(2).integers(0, 23, 500))
    index, anchor = golay.anchors(near, golay.radius + 1)
    assert all((homes[i] == anchor[index == i]).any() for i in range(500))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("cell_rows", [16_384, 40, 3])
def test_links_connect_what_brute_force_connects(spark, cell_rows):
    """Small bounds send cells to the second level of anchors and to the points of dense clusters."""
    r = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 10)):
            prints.add(x)
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(3)
    found = simhash_dedup.components(simhash_dedup.links(nodes, 4, cell_rows)).collect()
    root = {x.node: x.root for x in found}
    got: dict = {}
    for p in prints:
        got.setdefault(root.get(signed(p), signed(p)), set()).add(p)
    want: dict = {}
    for p, c in zip(prints, brute.classes(prints), strict=True):
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_classes_equal_brute_force(odd, empty):
    rows = odd.collect()
    prints = [brute.simhash(r.text) for r in rows]
    group: dict = {}
    for i, c in enumerate(brute.classes(prints)):
        group.setdefault(c, []).append(i)
    want = []
    for members in group.values():
        ids = [rows[i].doc_id for i in members if rows[i].doc_id is not None]
        want += [(rows[i].doc_id, f"{prints[i]:016x}", min(ids) if ids else None) for i in members]
    got = [tuple(r) for r in simhash_dedup.digests(simhash_dedup.classes(odd)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    first = simhash_dedup.first_of_class(odd)
    assert first.columns == odd.columns and first.count() == len(group)
    assert sorted([r.doc_id for r in first.collect() if r.doc_id is not None]) == sorted({w[2] for w in want if w[2] is not None})
    assert simhash_dedup.classes(empty).count() == 0 and simhash_dedup.first_of_class(empty).count() == 0


def test_first_of_class_with_repeated_rows_and_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "x y z w q"), (4, "x y z w q"), (9, "x y z w q"), (9, "other words here at all")], "doc_id long, text string")
    rows = sorted([tuple(r) for r in simhash_dedup.first_of_class(docs).collect()], key=key)
    assert rows == [(None, "a b c d e f"), (4, "x y z w q"), (9, "other words here at all")]


def check_contamination(docs, items, **kw):
    found, lists = decontam.judged(docs, items, **kw)
    listed = {r.signature: list(r.item_ids) for r in lists.collect()}
    out = found.collect()
    got = [(r.doc_id, r.n_words, r.n_hit, listed.get(r.signature, []), r.contaminated) for r in out]
    assert all(r.n_items == len(x[3]) and r.items_sha256 == brute.sha(",".join(x[3])) for r, x in zip(out, got, strict=True))
    got.sort(key=key)
    rows = docs.collect()
    want = brute.contamination([r.text for r in rows], [(r.item_id, r.text) for r in items.collect()])
    assert got == sorted([(r.doc_id, *w) for r, w in zip(rows, want, strict=True)], key=key)
    return want


def test_contamination_equals_brute_force(spark, odd, empty):
    r = random.Random(2)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "É", "x1", "zeta"])
    texts = [" ".join(word() for _ in range(r.choice([1, 3, 4, 12, 13, 14, 30]))) for _ in range(30)]
    items = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (3, texts[4]), (3, texts[4]), (None, texts[0]), (40, ""), (41, None), (42, texts[20]), (43, ",.!")], "item_id long, text string")
    docs = [(i, " ".join([word() for _ in range(r.randint(0, 40))] + [r.choice(texts).upper(), *[word() for _ in range(r.randint(0, 300))]])) for i in range(80)]
    docs = spark.createDataFrame([*docs, docs[0], (None, texts[8] + ", " + texts[9]), (90, None), (91, "")], "doc_id long, text string").repartition(5)
    want = check_contamination(docs, items)
    assert any(w[1] for w in want) and any(not w[1] for w in want)
    long_only = items.filter("item_id in (5, 6, 7, 8, 9, 20, 42)")
    check_contamination(docs, long_only)
    assert not any(w[1] for w in check_contamination(odd, items.limit(0)))
    assert decontam.contamination(empty, items).count() == 0
    clean = decontam.clean(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.count() - sum(w[3] for w in brute.contamination([x.text for x in odd.collect()], [(x.item_id, x.text) for x in items.collect()]))


def test_winnowing_shares_a_fingerprint_in_every_shared_window():
    r = np.random.default_rng(3)
    shared = r.integers(0, 1 << 63, 13).astype(np.uint64)
    for _ in range(50):
        sides = [np.concatenate([r.integers(0, 1 << 63, r.integers(0, 9)).astype(np.uint64), shared, r.integers(0, 1 << 63, r.integers(0, 9)).astype(np.uint64)]) for _ in range(2)]
        a, b = (set((g := decontam.grams(x, 5))[decontam.winnow(g, 9)].tolist()) for x in sides)
        assert a & b


def test_toxicity_learns_from_positives_and_unlabelled(spark, empty):
    import zlib

    r = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 6 == 0
        text = [r.choice(plain) for _ in range(r.randint(5, 80))]
        if toxic:
            text.insert(r.randrange(len(text)), r.choice(["Vile", "foul,", "nasty!"]))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None), (5000, ""), (5001, "vile " * 3), (1, rows[1][1])], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 3004 and all(0 <= x.score <= 1 for x in out)
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    own = [x for x in out if x.doc_id is not None and x.doc_id < 3000 and x.held_out]
    assert sum(x.predicted == (x.doc_id % 6 == 0) for x in own) / len(own) > 0.98
    assert {x.doc_id: x.predicted for x in out if x.doc_id is not None and x.doc_id >= 5000} == {5000: 0, 5001: 1}
    nothing = toxicity.fit(docs, marks.filter("toxic = 0"))
    assert {x.score for x in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(empty, model).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.buckets == b.buckets).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_scores_equal_plain_sums(spark, odd):
    import xxhash

    def words(text):
        return {w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOW)) if w}

    def bucket(word):
        return xxhash.xxh64_intdigest(word.encode(), toxicity.SEED) % toxicity.BUCKETS

    rows = odd.collect() + spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r.doc_id, n % 2) for n, r in enumerate(rows) if r.doc_id is not None], "doc_id long, toxic int").distinct()
    used = sorted({bucket(w) for r in rows for w in words(r.text)})[::7]
    model = toxicity.Model(np.array(used), np.random.default_rng(1).normal(size=len(used)), -0.3)
    weight = dict(zip(used, model.weights, strict=True))
    want = sorted((r.doc_id is not None, r.doc_id or 0, round(1 / (1 + np.exp(0.3 - sum(weight.get(b, 0.0) for b in {bucket(w) for w in words(r.text)}))), 9)) for r in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 9)) for r in toxicity.score(docs, model).collect())
    assert got == want
    # The words chosen are those of all training rows, whatever the bound of the gradient sample.
    sets = toxicity.word_sets(docs)
    a, b = toxicity.fit_sets(sets, labels, max_unlabelled=40), toxicity.fit_sets(sets, labels)
    assert (a.buckets == b.buckets).all()


def test_nnpu_follows_the_plain_risk():
    """Adam on gradients of the risk that are taken by differences, term by term."""
    r = np.random.default_rng(5)
    xp, xu = r.integers(0, 2, (6, 3)).astype(float), r.integers(0, 2, (9, 3)).astype(float)
    np_, nu, prior = r.integers(1, 4, 6).astype(float), r.integers(1, 5, 9).astype(float), 0.3
    loss = lambda z: float(np.log1p(np.exp(-z)))

    def parts(theta):
        of = lambda x, n, sign: sum(c * loss(sign * (row @ theta[:-1] + theta[-1])) for row, c in zip(x, n, strict=True)) / n.sum()
        return prior * of(xp, np_, 1), of(xu, nu, -1) - prior * of(xp, np_, -1)

    theta, m, v = np.array([0.0, 0.0, 0.0, np.log(prior / (1 - prior))]), np.zeros(4), np.zeros(4)
    for t in range(1, 41):
        def aim(x):
            plus, minus = parts(x)
            return plus + minus if parts(theta)[1] >= 0 else -minus

        g = np.array([(aim(theta + e) - aim(theta - e)) / 2e-6 for e in np.eye(4) * 1e-6])
        g[:3] += toxicity.DECAY * theta[:3]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weights, bias = toxicity.nnpu(xp, xu, np_, nu, prior, steps=40)
    assert np.allclose([*weights, bias], theta, atol=1e-4)


def test_the_gradient_sample_follows_the_whole_hash(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    for of, n, least, most in ((1000, 20_000, 800, 1200), (20_000, 20_000, 20_000, 20_000), (40_000, 10**14, 0, 1)):
        assert least <= df.filter(toxicity._share(of, n)).count() <= most
    limit = int(re.search(r"-\d+", str(toxicity._share(40_000, 10**11)))[0]) + (1 << 63)
    assert limit == (40_000 << 64) // 10**11 > 0  # a share above zero still at 1e11 documents


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from docloom.llm import bpe_codec

    sf = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    rules = quality_rules.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    rows = []
    for r in docs:
        s = brute.statistics(r.text)
        x = {k: np.array([v]) for k, v in brute.features(r.text).items()}
        if not (s[0] < 20 or 100 * s[4] > 30 * s[0]) and not any(quality_rules._covered(rule, x)[0] for rule in rules):
            rows.append(r)
    rows.sort(key=lambda r: r.doc_id)
    cls = brute.classes([brute.simhash(r.text) for r in rows])
    rows = [r for i, r in enumerate(rows) if cls[i] == i]
    rows = [r for r, c in zip(rows, brute.contamination([r.text for r in rows], [(r.item_id, r.text) for r in items]), strict=True) if not c[3]]
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for r in rows:
        text = brute.redacted(r.text, secret_scan.RULES, "[SECRET]")
        ids = encoding.encode_ordinary(text)
        want.append((r.doc_id, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text.encode())))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == sorted(want)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "benchmark_passages", "secrets", "encoding"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    one = spark.createDataFrame(docs[:1], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, one, sf).columns == columns


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows, a null id, and columns whose names operators use inside."""
    import corpus_pipeline

    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = odd.collect()
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, odd, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.count() == 0
        if name == "encoding":
            assert sorted((r.doc_id is not None, r.doc_id) for r in out.collect()) == sorted((r.doc_id is not None, r.doc_id) for r in rows)
            continue
        assert out.columns == none.columns == odd.columns
        got = out.drop("text", "n_chars").collect()
        assert all(got.count(r) <= sum(x.block == r.block for x in rows) for r in got)
        if name == "secrets":
            assert len(got) == len(rows) and {r.doc_id for r in out.filter("text is null").collect()} == {2}
        if name == "benchmark_passages":
            assert len(got) == len(rows)
        if name == "quality":
            kept = {r.doc_id for r in got}
            assert not kept & {2, 3, 4, 9} and sum(r.doc_id == 5 for r in got) in (0, 2)
