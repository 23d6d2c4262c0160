"""Personal data beside other digits."""

from __future__ import annotations

import random

import brute

from docloom.llm import pii_mask

CARD = "4111 1111 1111 1111"


def masked(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, [(s.kind, r.old[s.start : s.end]) for s in r.pii]) for r in pii_mask.mask(df.withColumn("old", df.text), "k", **kw).orderBy("doc_id").collect()]


def test_values_are_found_beside_other_digits(spark):
    plain = CARD.replace(" ", "")
    cases = [
        (f"{CARD} 123", [("card", CARD)]), (f"{plain} 12/25", [("card", plain)]), (f"order 7 {plain}", [("card", plain)]), (f"7-{CARD}-88 {plain}", [("card", CARD), ("card", plain)]),
        ("12 2020-01-01 2020-01-05", [("date", "2020-01-01"), ("date", "2020-01-05")]), (f"{plain} 192.168.0.1", [("card", plain), ("ip", "192.168.0.1")]), (f"{plain} 123-45-6789", [("card", plain), ("ssn", "123-45-6789")]),
        ("at 2020-01-01T10:00:00Z", [("date", "2020-01-01")]), ("call 555-123-4567, (555) 123-4567 or +44 20 7946 0958", [("phone", "555-123-4567"), ("phone", "(555) 123-4567"), ("phone", "+44 20 7946 0958")]),
        ("+1 (826) 555-4081 190.137.223.204", [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")]),
        ("+4915112345678", [("phone", "+4915112345678")]), ("1234567812345678 " + "1 " * 3000 + "x", None),
    ]
    texts = [t for t, _ in cases]
    got = masked(spark, texts)
    for (text, want), (new, spans) in zip(cases, got, strict=True):
        if want is not None:
            assert spans == want, text
            assert all(old not in new for _, old in spans)
    assert [t for t, _ in masked(spark, [t for t, _ in got[:-1]], unmask=True)] == texts[:-1]


def test_rows_equal_brute_force(spark, odd):
    """Random mixtures of valid, nearly valid and cut-off values, and the whole test documents."""
    r = random.Random(11)
    parts = [
        CARD, CARD.replace(" ", "-"), "4111111111111111", "378282246310005", "3782 822463 10005", "4111 1111 1111 1112", "2020-02-29", "2021-02-29", "31/12/1999", "01.02.2003", "2020-01-01T10:00", "123-45-6789", "666-12-3456",
        "000-11-2222", "+1 (826) 555-4081", "(555) 123-4567", "555.123.4567", "+44 20 7946 0958", "+4915112345678", "192.168.0.1", "256.1.1.1", "1.2.3.4.5", "Jo.Doe@mail.example.com", "x@y.co.", "a@b", "ä_%+-1@é.com", "a@b.c1.de",
        "7", "12", "1234", "12 34 56 78 90 12 34 56 78 90", " ", " ", "-", ".", ",", "x", "É", "\n", "😀", "/", "+", "@",
    ]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " ", "-", ", "]) for _ in range(r.randint(1, 30))) for _ in range(400)]
    texts += [x.text for x in odd.collect()] + [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.text, [tuple(s) for s in x.pii]) for x in pii_mask.mask(df, "k").collect()}
    found = 0
    for i, text in enumerate(texts):
        want = brute.pii(text, "k")
        assert got[i] == want, repr(text)
        found += len(want[1])
    assert found > 1000


def test_long_texts_that_strain_patterns_end(spark):
    """Repeated beginnings of every kind: a bounded stack, and steps in proportion to the length."""
    n = 1_000_000
    texts = ["x@" + "a." * (n // 2), "a@" * (n // 2), "1" * n, "1." * (n // 2), "+1 2" * (n // 4), "a" * n, "(555) " * (n // 6), "x@" + "a." * 126 + "b.com"]
    rows = pii_mask.mask(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "k").orderBy("doc_id").collect()
    assert [len(r.pii) for r in rows] == [0] * 7 + [1] and all(r.text == t for r, t in zip(rows[:7], texts, strict=False))
    short = ["1 " * 10_000, "1-" * 10_000, f"{CARD} " * 1000, "jo@a.com 2020-01-01 " * 2000]
    rows = pii_mask.mask(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [len(r.pii) for r in rows] == [0, 0, 1000, 4000] and rows[3].pii[-1].end == 20 * 2000 - 1


def test_a_clashing_name_is_kept(spark):
    df = spark.createDataFrame([(1, "a@b.com", "own")], "doc_id long, text string, pii string")
    out = pii_mask.mask(df, "k")
    assert out.columns == ["doc_id", "text", "pii", "pii_2"]
    row = out.first()
    assert row.pii == "own" and len(row.pii_2) == 1 and pii_mask.digests(out).first().n_email == 1
