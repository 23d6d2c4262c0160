"""Secret scans, URL filters, personal data, quality rules."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import pii_mask, quality_rules, secret_scan, url_filter


def key(x):
    return tuple((v is not None, v) for v in x)


def test_trigram_queries_are_derived():
    q = secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    assert q[0] == "or" and ("and", ("tok", "oke", "ken")) in q[1] and ("and", ("api", "pik", "ike", "key")) in q[1]
    assert secret_scan.trigram_query(secret_scan.BASE[2].pattern) is True
    assert secret_scan.trigram_query("ab|cdef") is True
    assert secret_scan.trigram_query("(abc|bcd)e+fgh") == ("and", (("or", ("abc", "bcd")), "fgh"))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="tokens=:ApikeYAKIA012abcdef \"'_-", max_size=60))
def test_queries_hold_for_every_match(text):
    def holds(q):
        return True if q is True else q in text.lower() if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1]))

    for rule in secret_scan.RULES:
        if re.search(rule.pattern, text):
            assert holds(secret_scan.trigram_query(rule.pattern))


def test_secret_spans_equal_brute_force(odd, empty):
    got = sorted([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.digests(secret_scan.find(odd)).collect()], key=key)
    want = []
    for r in odd.select("doc_id", "text").collect():
        spans = brute.secrets(r.text, secret_scan.RULES)
        write = lambda s: ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in s)
        base = [s for s in spans if s[1] < 3]
        want.append((r.doc_id, *[sum(s[1] == k for s in base) for k in range(3)], brute.sha(write(base)), write(spans)))
    assert got == sorted(want, key=key)
    assert any(w[5] for w in want)
    assert secret_scan.digests(secret_scan.find(empty)).count() == 0


def test_many_secrets_in_a_text_and_small_blocks(spark, monkeypatch):
    text = " ".join(f"token = value{i:06d} ghp_{'a' * 36}" for i in range(150))
    docs = spark.createDataFrame([(i, text if i % 3 == 0 else f"plain {i}") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(secret_scan.build_index, "__defaults__", (4,))
    rows = secret_scan.digests(secret_scan.find(docs)).collect()
    assert len(rows) == 40
    assert all(r.n_assign == (150 if r.doc_id % 3 == 0 else 0) for r in rows)
    assert all(r.spans.count("github") == (150 if r.doc_id % 3 == 0 else 0) for r in rows)


def test_redaction_merges_spans_and_keeps_columns(odd, empty):
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns and secret_scan.redact(empty).count() == 0
    want = sorted([(r.doc_id, brute.redacted(r.text, secret_scan.RULES, "[SECRET]"), r._text, r.block) for r in odd.collect()], key=key)
    assert sorted([(r.doc_id, r.text, r._text, r.block) for r in out.collect()], key=key) == want


URLS = [
    "http://a.example.com/en/x", "https://www.example.com/en/", "http://example.com", "HTTP://EXAMPLE.COM/EN/", "x://b.net/fr/1?q#z", "http://net/es/", "http://c.org/p?b=2&a=1&utm_source=x#f",
    "https://www.c.org/p/?a=1&b=2", None, "", "://", "no scheme", "http://com:80/", "http://examplecom/", "http://u@c.org:443/p?a=1&b=2", "http://d.org/?q=://e.com/", "http://É.org/",
    "http://a.b.f.org/x?y", "https://www.F.org:443", "http://ff.org", "http://g.org/a?x=1", "http://g.org/a/b", "http://h.g.org/a", "http://c.org/p?a=1", "http://1.2.3.4.5.6.f.org/", "http://f/",
]
LISTED = {
    "http://c.org/p?b=2&a=1&utm_source=x#f", "https://www.c.org/p/?a=1&b=2", "http://u@c.org:443/p?a=1&b=2", "http://a.b.f.org/x?y", "https://www.F.org:443", "http://g.org/a?x=1", "http://1.2.3.4.5.6.f.org/",
}


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(n % 12, u, "h") for n, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://c.org/p?a=1&b=2",), (None,), ("nothing",), ("https://c.org/p?a=1&b=2",), ("http://f.org/",), ("x://g.org/a",)], "url string")
    got = sorted([tuple(r) for r in url_filter.judge(pages, listed).select("page_id", "host", "path", "rule", "verdict").collect()], key=key)
    want = []
    for n, u in enumerate(URLS * 2):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split("[/?#]", rest, maxsplit=1)[0]
            path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
            host = host.translate(brute.LOW)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit)[1] if fit else None
        on_list = u in LISTED
        want.append((n % 12, host, path, rule, max(fit)[2] if fit else "block" if on_list else "allow"))
    assert got == sorted(want, key=key)
    assert url_filter.judge(pages, listed.limit(0)).filter("listed").count() == 0
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_bloom_has_no_false_negatives_and_a_bounded_size(spark):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.int64)
    df = spark.createDataFrame([(int(h),) for h in hashes], "h long")
    bloom = url_filter.BlockedBloom.of(df, 5000)
    assert bloom.has(hashes.view(np.uint64)).all() and len(bloom.bits) <= 5000 * 2 + 64
    others = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.int64)
    assert bloom.has(others.view(np.uint64)).mean() < 0.02
    small = url_filter.BlockedBloom.of(df, 5000, max_bytes=1024)
    assert len(small.bits) == 1024 and small.has(hashes.view(np.uint64)).all()


PII = "card 4539578763621486, 4539-5787-6362-1486 or 1234567812345678; on 2024-02-29, 31/12/1999 and 2023-02-30; ssn 123-45-6789 and 666-12-3456; +1 (555) 010-9999; ip 192.168.0.1 and 999.1.1.1; mail Jo.Doe@mail.example.com!"


def masked(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii string")
    return [r.text for r in pii_mask.mask(df, kw.pop("key", "k1"), **kw).orderBy("doc_id").collect()]


def test_pseudonyms_keep_format_and_link_equal_values(spark):
    a, b, none, blank = masked(spark, [PII, "again 4539578763621486 and 2024-02-29", None, ""])
    assert none is None and blank == ""
    shape = lambda s: re.sub(r"[0-9]", "9", s)
    cut = lambda s: s[: s.index("; mail")]
    until_ip = lambda s: s[: s.index("; ip")]
    assert shape(until_ip(a)) == shape(until_ip(PII)) and re.search(r"; ip \d+\.\d+\.\d+\.\d+ and", a) and "Jo.Doe" not in a and a.endswith("@mail.invalid!")
    card = re.search(r"card (\d{16})", a)[1]
    assert card != "4539578763621486" and card in b and re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", a)[0].replace("-", "") == card
    digits = [int(c) for c in reversed(card)]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert "1234567812345678" in a and "2023-02-30" in a and "666-12-3456" in a and "999.1.1.1" in a
    assert re.search(r"on (\d{4}-\d\d-\d\d)", a)[1] == re.search(r"and (\d{4}-\d\d-\d\d)", b)[1] != "2024-02-29"
    assert masked(spark, [PII], key="k2")[0] != a


def test_pseudonyms_are_a_permutation_and_can_be_undone(spark):
    from pyspark.sql import functions as F

    a, b = F.lit(189).cast("long"), F.lit(773).cast("long")
    df = spark.range(146_097).select("id", pii_mask.feistel(F.col("id"), a, b, "k", F.lit("date")).alias("p"))
    assert df.select("p").distinct().count() == 146_097 and df.agg(F.min("p"), F.max("p")).first() == (0, 146_096)
    back = masked(spark, masked(spark, [PII]), unmask=True)[0]
    cut = lambda s: s[: s.index("; mail")]
    assert cut(back) == cut(PII)


def test_pii_on_odd_rows(odd, empty):
    rows = pii_mask.digests(pii_mask.mask(odd, "k")).collect()
    assert len(rows) == odd.count() and pii_mask.digests(pii_mask.mask(empty, "k")).count() == 0


def test_statistics_equal_brute_force(odd, empty):
    got = sorted([(r.doc_id, *[r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], r.base_failed) for r in quality_rules.judge(odd, [], "doc_id").collect()], key=key)
    want = []
    for r in odd.collect():
        s = brute.statistics(r.text)
        want.append((r.doc_id, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert got == sorted(want, key=key)
    assert quality_rules.judge(empty, [], "doc_id").count() == 0


def test_learned_rules(spark, odd):
    r = np.random.default_rng(3)
    x = {"a": r.random(1500), "b": r.random(1500)}
    bad = (x["a"] > 0.8) & (x["b"] > 0.5)
    rules = quality_rules.learn(x, bad)
    got = np.zeros(1500, bool)
    for rule in rules:
        got |= quality_rules._covered(rule, x)
    assert (got == bad).mean() > 0.97 and (got & ~bad).sum() <= 0.1 * got.sum()
    assert quality_rules.learn(x, np.zeros(1500, bool)) == [] and quality_rules.learn(x, np.ones(1500, bool)) == []
    labels = spark.createDataFrame([(1, None), (99, 0), (None, 1)], "doc_id long, quality int")
    assert quality_rules.fit(odd, labels) == []
    kept = quality_rules.keep(odd, [])
    assert kept.columns == odd.columns
    want = sorted(str(x.doc_id) for x in odd.collect() if not (lambda s: s[0] < 20 or 100 * s[4] > 30 * s[0])(brute.statistics(x.text)))
    assert sorted(str(x.doc_id) for x in kept.collect()) == want


def test_rules_equal_python_on_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    rule = ((quality_rules.Test("symbols", True, 0.5),), (quality_rules.Test("upper", True, 0.6), quality_rules.Test("words", False, 5000.0)))
    kept = {r.doc_id for r in quality_rules.judge(docs, list(rule), "doc_id").filter("kept").collect()}
    want = set()
    for r in docs.collect():
        s, f = brute.statistics(r.text), brute.features(r.text)
        if not (s[0] < 20 or 100 * s[4] > 30 * s[0] or f["symbols"] >= 0.5 or (f["upper"] >= 0.6 and f["words"] < 5000)):
            want.add(r.doc_id)
    assert kept == want and labels.count() > 0


@pytest.mark.parametrize("seed", range(2))
def test_repeat_words_on_random_texts(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.statistics(df, "doc_id").collect()}
    assert got == {i: brute.statistics(t)[4] for i, t in enumerate(texts)}
