"""Streams give what their batch forms give, in any order of arrival and with repeats."""

from __future__ import annotations

import random

import pytest

from docloom.streaming import keyed


@pytest.mark.parametrize("seed", [1, 2])
def test_arrival_order_and_repeats_do_not_matter(spark, tmp_path, seed):
    rows = [(i, i % 3, float(i)) for i in range(60)]
    arrived = rows + rows[::4]
    random.Random(seed).shuffle(arrived)
    for n in range(4):
        spark.createDataFrame(arrived[n::4], "ref long, owner long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{seed}/deltas.parquet")
    stream = keyed.source(spark, f"{tmp_path}/{seed}", "deltas", files=1)
    got = keyed.finished(keyed.owner_totals(stream, ["owner"], "ref", "value"), "t", ["owner"], "update")
    want = [(o, sum(r[1] == o for r in rows), sum(r[2] for r in rows if r[1] == o)) for o in range(3)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_barriers_hold_back_incomplete_scopes(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "scope string, v int")
    barriers = spark.createDataFrame([("a", True), ("b", False)], "scope string, complete boolean")
    assert [tuple(r) for r in keyed.covered(facts, barriers, ["scope"]).collect()] == [("a", 1)]


def test_late_receipts_are_kept_as_stale(spark):
    done = spark.createDataFrame([(1,), (2,)], "ref long")
    old = spark.createDataFrame([(1, 3), (1, 3)], "old_ref long, new_ref long")
    assert {r.ref: r.status for r in keyed.receipts(done, old, "ref").collect()} == {1: "stale", 2: "admitted"}


def test_pause_and_certificate(spark):
    c = spark.createDataFrame([(127, 0), (128, 0), (0, 20_000)], "pending long, mass long")
    assert [r.paused for r in keyed.paused(c).collect()] == [False, True, True]
    ledger = spark.createDataFrame([("d", "done"), ("e", "dirty"), ("e", "done")], "doc string, state string")
    assert {r.doc: r.certified for r in keyed.certificate(ledger, "doc").collect()} == {"d": True, "e": False}
