"""Revisions, validity in time and keyed updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keyed import first_by, latest_by


def validity(df: DataFrame, keys: Sequence[str], start: str, ties: Sequence[str] = ()) -> DataFrame:
    """df with valid_from and valid_to: each row of a key is valid until the next one begins (null: still)."""
    return df.withColumn("valid_from", F.col(start)).withColumn("valid_to", F.lead(start).over(Window.partitionBy(*keys).orderBy(start, *ties)))


def as_at(df: DataFrame, when: str, recorded: str | None = None) -> DataFrame:
    """Rows valid at a time: from valid_from on, before valid_to. With recorded, also those on record then."""
    t = F.lit(when).cast(df.schema["valid_from"].dataType)
    out = df.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    if recorded is not None:
        r = F.lit(recorded).cast(df.schema["recorded_from"].dataType)
        out = out.filter((F.col("recorded_from") <= r) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > r)))
    return out


def append_revisions(have: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """have(key, rev_id, ...) and new (without rev_id) together; new rows go on from the key's last number, in order."""
    last = have.groupBy(key).agg(F.max("rev_id").alias("_last"))
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(last, key, "left")
    return have.unionByName(numbered.withColumn("rev_id", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last"), allowMissingColumns=True)


def snapshot(revisions: DataFrame, key: str, when: str, date: str = "effective_date") -> DataFrame:
    """The last revision of each key at or before a date; equal dates: the larger rev_id."""
    return latest_by(revisions.filter(F.col(date) <= F.lit(when).cast(revisions.schema[date].dataType)), [key], [date, "rev_id"])


def upsert(have: DataFrame, new: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """On a known key: new wins (update), or what is there stays."""
    both = have.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return (latest_by if update else first_by)(both, keys, ["_side"]).drop("_side")


def replace_set(have: DataFrame, new: DataFrame, owner: Sequence[str]) -> DataFrame:
    """All rows of an owner that new has are replaced by new's."""
    return have.join(new.select(*owner).distinct(), list(owner), "left_anti").unionByName(new)


def slot_state(rows: DataFrame, slot: Sequence[str], evidence: Column, tau: Column) -> DataFrame:
    """slot, sum_e, tau (1 all support, -1 all oppose, 0 none or both), conflict (both)."""
    g = rows.select(*slot, evidence.alias("_e"), tau.alias("_t")).groupBy(*slot).agg(F.sum("_e").alias("sum_e"), F.max("_t").alias("_hi"), F.min("_t").alias("_lo"))
    both = (F.col("_hi") == 1) & (F.col("_lo") == -1)
    state = F.when(F.col("_lo") == 1, 1).when(F.col("_hi") == -1, -1).otherwise(0)
    return g.select(*slot, "sum_e", state.alias("tau"), both.cast("int").alias("conflict"))


def drift(before: DataFrame, after: DataFrame, slot: Sequence[str]) -> DataFrame:
    """Slots whose state differs between two slot_state() results, with deltas and severity; an absent slot counts as zeros."""
    a = before.select(*slot, F.col("sum_e").alias("_ea"), F.col("tau").alias("_ta"), F.col("conflict").alias("_ca"))
    b = after.select(*slot, F.col("sum_e").alias("_eb"), F.col("tau").alias("_tb"), F.col("conflict").alias("_cb"))

    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    both = F.col("_ta").isNotNull() & F.col("_tb").isNotNull()
    moved = z("_ta") != z("_tb")
    severity = F.when(moved & (z("_ta") != 0) & (z("_tb") != 0), "high").when(moved, "medium").otherwise("low")
    rows = a.join(b, list(slot), "full_outer").select(*slot, (z("_eb") - z("_ea")).alias("delta_e"), (z("_cb") - z("_ca")).alias("delta_c"), moved.alias("tau_changed"), both.alias("in_both"), severity.alias("severity"))
    return rows.filter("tau_changed or delta_e <> 0 or delta_c <> 0")


def violations(child: DataFrame, parent: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    keys = parent.select(F.col(primary).alias(foreign)).distinct()
    return child.filter(F.col(foreign).isNotNull()).join(keys, foreign, "left_anti")


def hash_id(prefix: str, *columns: str) -> Column:
    """A content id: prefix and SHA-256 over the columns, nulls and lengths told apart."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.concat_ws("|", *parts).cast("binary"), 256))


def fibre_drift(before: DataFrame, after: DataFrame, slot: list[str], prop: str, value: str, with_entropy: bool) -> DataFrame:
    """slot, severity, entropy_delta of slots whose fibres (qualifiers or references: prop and value) differ between two snapshots.

    high: the set of properties differs; medium: only the signatures (property and values) do; low: only
    the entropy of signatures (with_entropy). A slot that a snapshot lacks has no fibres there."""
    from .stats import entropy

    def state(rows, name):
        signed = rows.select(*slot, F.col(prop).cast("string").alias("_p"), F.concat_ws("=", prop, value).alias("_s"))
        sets = signed.groupBy(*slot).agg(F.array_sort(F.collect_set("_p")).alias(f"_p{name}"), F.array_sort(F.collect_set("_s")).alias(f"_s{name}"))
        return sets.join(entropy(signed, slot, "_s").withColumnRenamed("entropy", f"_e{name}"), slot) if with_entropy else sets.withColumn(f"_e{name}", F.lit(0.0))

    both = state(before, "1").join(state(after, "2"), slot, "full_outer")
    none, zero = F.array().cast("array<string>"), F.lit(0.0)
    props, signs = (F.coalesce(f"_{k}1", none) != F.coalesce(f"_{k}2", none) for k in "ps")
    delta = F.round(F.coalesce("_e2", zero) - F.coalesce("_e1", zero), 6)
    severity = F.when(props, "high").when(signs, "medium").when(delta != 0, "low")
    return both.select(*slot, severity.alias("severity"), delta.alias("entropy_delta")).filter("severity is not null")


def ordering_edges(events: DataFrame, by: list[str], ref: str, when: str) -> DataFrame:
    """by, src, dst, basis: each event and the next of its group in time (historical_time_order, or same_time for equal times); undated ones have none."""
    w = Window.partitionBy(*by).orderBy(when, ref)
    rows = events.filter(F.col(when).isNotNull()).select(*by, F.col(ref).alias("src"), F.col(when).alias("_t"), F.lead(ref).over(w).alias("dst"), F.lead(when).over(w).alias("_n")).filter("dst is not null")
    return rows.select(*by, "src", "dst", F.when(F.col("_n") > F.col("_t"), "historical_time_order").otherwise("same_time").alias("basis"))


def lease_state(taken: Column, seconds: Column, now: Column) -> tuple[Column, Column]:
    """(when a lease ends, its state): free where it was never taken, expired from its end on, else held."""
    end = taken + F.make_dt_interval(secs=seconds)
    return end, F.when(taken.isNull(), "free").when(now >= end, "expired").otherwise("held")


def fetch_plan(requests: DataFrame, cache: DataFrame, url: str, host: Column, now: Column, ttl_seconds: int, per_window: int, ties: Sequence[str] = ()) -> DataFrame:
    """requests with action and window. hit: cache(url, fetched_at) has an answer younger than the limit; fetch: others, so many of a host in each window, in order of url. ties order equal urls."""
    newest = cache.groupBy(url).agg(F.max("fetched_at").alias("_at"))
    fresh = F.col("_at") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = requests.join(newest, url, "left").withColumn("action", F.when(fresh, "hit").otherwise("fetch")).withColumn("_host", host)
    place = F.row_number().over(Window.partitionBy("_host", "action").orderBy(url, *ties))
    return rows.withColumn("window", F.when(F.col("action") == "fetch", F.floor((place - 1) / per_window))).drop("_host", "_at")
