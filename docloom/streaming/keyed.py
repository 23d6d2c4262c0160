"""Keyed incremental state on Structured Streaming: idempotent admission, coverage barriers, retraction, running state.

State is bounded by a watermark or by barriers that close; results go to Parquet in the shared folder
with a checkpoint of their own, so a restarted query goes on where it stopped."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from ..sources.tables import read


def source(spark: SparkSession, sf_dir: str, name: str, files: int = 64) -> DataFrame:
    """A table's files as a stream, so many files a batch: that is its back-pressure. (A pattern stands for a folder or a single file alike.)"""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def finished(stream: DataFrame, name: str, keys: Sequence[str] = (), mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has emitted; in update mode, each key's last row."""
    spark, top = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{top}/log").trigger(availableNow=True)
    if mode == "append":
        running = writer.outputMode("append").format("parquet").option("path", f"{top}/out").start()
    else:

        def put(batch: DataFrame, number: int) -> None:
            # A batch that is tried again overwrites what it had written.
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{top}/out/batch={number}")

        running = writer.outputMode(mode).foreachBatch(put).start()
    running.awaitTermination()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{top}/out")
    rows = spark.read.schema(f"{fields}, _batch int").parquet(f"{top}/out/*")
    rest = [c for c in stream.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*stream.columns)


def admitted(deltas: DataFrame, ref: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each delta once, whatever the order of arrival and however often it comes. With a watermark (column, delay) old refs are forgotten."""
    if deltas.isStreaming and watermark:
        return deltas.withWatermark(*watermark).dropDuplicatesWithinWatermark([ref])
    return deltas.dropDuplicates([ref])


def owner_totals(deltas: DataFrame, owner: Sequence[str], ref: str, value: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """owner, deltas, total of admitted deltas; the same over a stream (update mode) and a table.

    A stream needs a watermark (column, delay) for its state of refs to be bounded: a delta that comes
    again after the delay counts anew."""
    return admitted(deltas, ref, watermark).groupBy(*owner).agg(F.count("*").alias("deltas"), F.round(F.sum(F.col(value).cast("decimal(20,4)")), 2).cast("double").alias("total"))


def covered(facts: DataFrame, barriers: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Facts of scopes that a barrier has declared complete; the others wait."""
    return facts.join(barriers.filter("complete").select(*scope).distinct(), list(scope), "left_semi")


def reduction_diff(before: DataFrame, after: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """key, change (introduced, discharged, changed) between two reductions."""
    a, b = before.select(*key, F.col(value).alias("_a")), after.select(*key, F.col(value).alias("_b"))
    change = F.when(F.col("_a").isNull(), "introduced").when(F.col("_b").isNull(), "discharged").otherwise("changed")
    return a.join(b, list(key), "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*key, change.alias("change"))


def receipts(done: DataFrame, superseded: DataFrame, ref: str) -> DataFrame:
    """done with status: stale where its input has been replaced in the meantime, else admitted. Stale ones are recorded, not dropped."""
    gone = superseded.select(F.col("old_ref").alias(ref)).distinct().withColumn("_gone", F.lit(True))
    return done.join(gone, ref, "left").withColumn("status", F.when(F.col("_gone"), "stale").otherwise("admitted")).drop("_gone")


def branching_mass(groups: DataFrame, owner: Sequence[str], live: str = "live") -> DataFrame:
    """owner, mass: sum of n * max(1, n - 1) over live groups."""
    return groups.filter(live).groupBy(*owner).agg(F.sum(F.col("n") * F.greatest(F.lit(1), F.col("n") - 1)).cast("long").alias("mass"))


#: Fixed limits: beyond any of them a source pauses.
LIMITS = {"pending": 128, "in_flight": 64, "dirty": 128, "mass": 20_000}


def paused(counters: DataFrame) -> DataFrame:
    """counters with paused: whether one has reached its limit."""
    over = None
    for name, limit in LIMITS.items():
        if name in counters.columns:
            test = F.col(name) >= limit
            over = test if over is None else over | test
    return counters.withColumn("paused", F.lit(False) if over is None else over)


def certificate(ledger: DataFrame, document: str) -> DataFrame:
    """document, open, certified: certified only where nothing is pending, in flight or dirty."""
    open_ = F.sum(F.when(F.col("state").isin("pending", "in_flight", "dirty"), 1).otherwise(0))
    return ledger.groupBy(document).agg(open_.cast("long").alias("open")).withColumn("certified", F.col("open") == 0)


def affected(changed: DataFrame, depends: DataFrame, key: str) -> DataFrame:
    """What must be done anew: dependents of changed inputs, depends(input, dependent)."""
    return depends.join(changed.select(F.col(key).alias("input")).distinct(), "input", "left_semi").select("dependent").distinct()


def _with_turn(ranges: list[list[int]], turn: int) -> bool:
    """Add a turn to sorted, disjoint ranges of turns; False if it was there."""
    from bisect import bisect_right

    at = bisect_right(ranges, [turn, 1 << 62])
    if at and ranges[at - 1][1] >= turn:
        return False
    left, right = at > 0 and ranges[at - 1][1] == turn - 1, at < len(ranges) and ranges[at][0] == turn + 1
    if left and right:
        ranges[at - 1][1] = ranges.pop(at)[1]
    elif left:
        ranges[at - 1][1] = turn
    elif right:
        ranges[at][0] = turn
    else:
        ranges.insert(at, [turn, turn])
    return True


def conversation_state(turns: DataFrame) -> DataFrame:
    """conv_id, turns, chars, last_turn, kept as state by conversation; a turn that is delivered again doesn't count.

    The state holds the ranges of turns seen, so a conversation's grows with gaps only; there is one for each conversation."""
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        seen, chars, last, ranges = state.get if state.exists else (0, 0, -1, "[]")
        known = json.loads(ranges)
        for pdf in batches:
            for turn, n in zip(pdf["turn"], pdf["n"], strict=True):
                if _with_turn(known, int(turn)):
                    seen, chars, last = seen + 1, chars + int(n), max(last, int(turn))
        state.update((seen, chars, last, json.dumps(known)))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [seen], "chars": [chars], "last_turn": [last]})

    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.length("text").cast("long").alias("n"))
    return rows.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turns long, chars long, last_turn long", "turns long, chars long, last_turn long, ranges string", "update", GroupStateTimeout.NoTimeout)


#: Fixed sizes: deltas that an owner takes at once, and that its inbox gives back in one go.
INBOX, RELEASE = 64, 8


def inbox(deltas: DataFrame, owner: Sequence[str], order: Sequence[str], limit: int = INBOX, release: int = RELEASE) -> DataFrame:
    """deltas with state and round: the first limit of each owner are admitted (round 0), the others deferred and released so many a round; none is dropped."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy(*owner).orderBy(*order))
    rows = deltas.withColumn("_place", place)
    return rows.withColumn("state", F.when(F.col("_place") <= limit, "admitted").otherwise("deferred")).withColumn("round", F.greatest(F.lit(0), F.ceil((F.col("_place") - limit) / release)).cast("long")).drop("_place")


def drive(stream: DataFrame, work: Callable[[DataFrame, int], None], name: str, rounds: int = 64) -> int:
    """Run work over a stream's batches, round after round, until a round finds nothing new; the number of rounds that did.

    A round takes all that is there when it begins. Batches keep their numbers over restarts, so work that
    overwrites what a number had written is done once, however often it is tried."""
    log = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for n in range(rounds):
        seen: list[int] = []

        def put(batch: DataFrame, number: int, seen: list[int] = seen) -> None:
            seen.append(number)
            work(batch, number)

        stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
        if not seen:
            return n
    return rounds


def outbox(stream: DataFrame, ref: str, name: str) -> DataFrame:
    """batch, ref, kind (committed) of every row that a stream has committed: what a reader downstream picks up, in order of batch.

    A batch's events are written with the batch, under its number; one that is tried again replaces them."""
    spark, top = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-out-{uuid.uuid4().hex}"
    kind = stream.schema[ref].dataType.simpleString()

    def commit(batch: DataFrame, number: int) -> None:
        batch.select(F.lit(number).cast("long").alias("batch"), F.col(ref).alias("ref"), F.lit("committed").alias("kind")).write.mode("overwrite").parquet(f"{top}/batch={number}")

    if not drive(stream, commit, name):
        return spark.createDataFrame([], f"batch long, ref {kind}, kind string")
    return spark.read.schema(f"batch long, ref {kind}, kind string").parquet(f"{top}/*")


class Executor(Protocol):
    """What execute() runs for each scope: a schema, and a function from a scope's rows to rows of it."""

    schema: str

    def close(self, scope: tuple, rows: object) -> object: ...


def execute(rows: DataFrame, scope: Sequence[str], executor: Executor) -> DataFrame:
    """An executor's rows for every scope; scopes are bounded groups, each closed by one task in an Arrow batch."""
    return rows.groupBy(*scope).applyInPandas(lambda key, pdf: executor.close(key, pdf), executor.schema)


def windowed(events: DataFrame, when: str, size: str, by: Sequence[str], value: str, delay: str = "1 hour") -> DataFrame:
    """Beyond keyed state: counts and sums by event-time window; a stream emits a window once the watermark has passed it."""
    rows = events.withWatermark(when, delay) if events.isStreaming else events
    return rows.groupBy(F.window(when, size), *by).agg(F.count("*").alias("n"), F.round(F.sum(F.col(value).cast("decimal(20,4)")), 2).cast("double").alias("total")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), *by, "n", "total")
