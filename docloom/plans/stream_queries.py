"""Incremental operators: batch forms, and runs of the same over streams of files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..streaming import keyed as S
from .registry import QUERIES, ORACLES, query

TOTALS = "SELECT user_id, event_type, count(*) AS deltas, round(sum(value::DECIMAL(20,4)), 2)::DOUBLE AS total FROM events GROUP BY 1, 2"


@query("r1_owner_totals", TOTALS)
def r1(read):
    e = read("events")
    return S.owner_totals(e.unionByName(e.filter("event_id % 4 = 0")), ["user_id", "event_type"], "event_id", "value")


def _stream(name, sql=None):
    """Register a query that reads its tables as streams."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, sf_dir)
        if sql:
            ORACLES[name] = sql.strip()
        return build

    return add


@_stream("r1_stream_owner_totals", TOTALS)
def r1s(spark, sf_dir):
    return S.finished(S.owner_totals(S.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "event_type"], "event_id", "value", ("ts", "30 days")), "owner-totals", ["user_id", "event_type"], "update")


@_stream("r9_stream_conversations", "SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, max(turn)::BIGINT AS last_turn FROM conversations GROUP BY 1")
def r9s(spark, sf_dir):
    return S.finished(S.conversation_state(S.source(spark, sf_dir, "conversations")), "conversations", ["conv_id"], "update")


@query("r2_coverage", "SELECT event_type, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'purchase')) GROUP BY 1")
def r2(read):
    e = read("events")
    barriers = e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("complete"))
    return S.covered(e, barriers, ["user_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


HALF = "(SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 10 {} GROUP BY 1, 2)"


@query("r3_reduction_diff", f"WITH a AS (SELECT * FROM {HALF.format('< 5')}), b AS (SELECT * FROM {HALF.format('>= 5')}) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.n IS NULL THEN 'introduced' WHEN b.n IS NULL THEN 'discharged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.n IS DISTINCT FROM b.n")
def r3(read):
    def half(test):
        return read("events").filter(test).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

    return S.reduction_diff(half("event_id % 10 < 5"), half("event_id % 10 >= 5"), ["user_id", "event_type"], "n")


@query("r4_receipts", "WITH s AS (SELECT event_id AS old_ref FROM events e WHERE EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND (f.ts, f.event_id) > (e.ts, e.event_id))) SELECT event_type, CASE WHEN event_id IN (SELECT old_ref FROM s) THEN 'stale' ELSE 'admitted' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def r4(read):
    e = read("events")
    newest = F.lead("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    old = e.select(F.col("event_id").alias("old_ref"), newest.alias("new_ref")).filter("new_ref is not null")
    return S.receipts(e.select("event_id", "event_type"), old, "event_id").groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("r5_branching_mass", "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, sum(n * greatest(1, n - 1))::BIGINT AS mass FROM g WHERE event_type <> 'error' GROUP BY 1) SELECT user_id, mass, mass >= 20000 AS paused FROM m")
def r5(read):
    g = read("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("live", F.col("event_type") != "error")
    return S.paused(S.branching_mass(g, ["user_id"]))


@query("r6_certificate", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'O') = 0 AS certified FROM orders GROUP BY 1")
def r6(read):
    o = read("orders").select("o_custkey", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("state"))
    return S.certificate(o, "o_custkey")


@query("r8_retention", "SELECT user_id, count(*) AS kept FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY 1")
def r8(read):
    from ..operators.keyed import top_k

    return top_k(read("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).groupBy("user_id").agg(F.count("*").alias("kept"))


@query("r9_contested", "WITH c AS (SELECT conv_id, turn, role, lag(role) OVER w AS pr, length(text) % 2 AS p, lag(length(text) % 2) OVER w AS pp FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, count(*) AS contested, min(turn)::BIGINT AS first_turn FROM c WHERE role <> pr AND p = pp GROUP BY 1")
def r9(read):
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text") % 2
    c = read("conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("pr"), n.alias("p"), F.lag(n).over(w).alias("pp"))
    return c.filter("role <> pr and p = pp").groupBy("conv_id").agg(F.count("*").alias("contested"), F.min("turn").cast("long").alias("first_turn"))


@query("r11_affected", "SELECT DISTINCT l_orderkey AS dependent FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 11)")
def r11(read):
    return S.affected(read("part").filter("p_size = 11"), read("lineitem").select(F.col("l_partkey").alias("input"), F.col("l_orderkey").alias("dependent")), "p_partkey")


@query("r12_windows", "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(20,4)), 2)::DOUBLE AS total FROM events GROUP BY 1, 2")
def r12(read):
    return S.windowed(read("events"), "ts", "6 hours", ["event_type"], "value")


@_stream("r12_stream_windows")
def r12s(spark, sf_dir):
    return S.finished(S.windowed(S.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], "value"), "windows")


@query("r12_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY 1")
def r12b(read):
    s = read("events").groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.count("*").alias("c"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("c").alias("n"))


@query("r5_inbox", "WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, CASE WHEN p <= 64 THEN 'admitted' ELSE 'deferred' END AS state, greatest(0, ceil((p - 64) / 8))::BIGINT AS round, count(*) AS n FROM p GROUP BY 1, 2, 3")
def r5b(read):
    return S.inbox(read("events"), ["user_id"], ["ts", "event_id"]).groupBy("user_id", "state", "round").agg(F.count("*").alias("n"))


@_stream("r7_driver_loop", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def r7(spark, sf_dir):
    """Each round's batches are aggregated and kept by their number; the loop ends when nothing is new."""
    from ..sources.shared import scratch

    top = scratch(spark, "driver-loop")
    S.drive(S.source(spark, sf_dir, "events"), lambda batch, number: batch.groupBy("user_id").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{top}/batch={number}"), "driver")
    return spark.read.schema("user_id long, n long").parquet(f"{top}/*").groupBy("user_id").agg(F.sum("n").alias("n"))


@_stream("r10_outbox", "SELECT event_id AS ref, 'committed' AS kind FROM events")
def r10(spark, sf_dir):
    return S.outbox(S.source(spark, sf_dir, "events"), "event_id", "outbox").select("ref", "kind")


class _Spread:
    schema = "user_id long, n long, spread double"

    def close(self, scope, rows):
        import pandas as pd

        return pd.DataFrame({"user_id": [scope[0]], "n": [len(rows)], "spread": [round(float(rows["value"].max() - rows["value"].min()), 6)]})


@query("x2_executor", "SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def x2(read):
    return S.execute(read("events").select("user_id", "value"), ["user_id"], _Spread())
