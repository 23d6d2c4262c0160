"""Operators on rows of a key: latest, first, top k, winners, ordinals. One shuffle on the key each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Order = Sequence[Column | str]


def ordinal(df: DataFrame, keys: Sequence[str], order: Order, name: str = "ordinal") -> DataFrame:
    """df with the place of each row within its key, from 1. The order must be total for a stable result."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, keys: Sequence[str], order: Order, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark limits each task's rows before the shuffle (WindowGroupLimit), so a hot key stays small."""
    return ordinal(df, keys, order, name).filter(F.col(name) <= k)


def latest_by(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The last row of each key; order is ascending and total."""
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    # max_by is combined on the map side, unlike a window.
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), by).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key; order is ascending and total."""
    by = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), by).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def strict_winner(df: DataFrame, keys: Sequence[str], score: str, ties: Order = ()) -> DataFrame:
    """The best row of each key, with is_strict: its score isn't 0 and beats the next one's."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    ranked = df.withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w)).filter("_rank <= 1")
    return ranked.withColumn("is_strict", (F.col(score) != 0) & (F.col("_next").isNull() | (F.col(score) > F.col("_next")))).drop("_rank", "_next")


def resolution_class(candidates: DataFrame, keys: Sequence[str], score: str, limit: int) -> DataFrame:
    """keys, n, class: deductive_unique for one candidate, inductive_preference for a strict winner,
    resource_limited where more candidates than the limit remain, else unresolved."""
    n = candidates.groupBy(*keys).agg(F.count("*").alias("n"))
    strict = strict_winner(candidates, keys, score).filter("is_strict").select(*keys, F.lit(True).alias("_strict"))
    kind = F.when(F.col("n") == 1, "deductive_unique").when(F.col("_strict"), "inductive_preference").when(F.col("n") > limit, "resource_limited").otherwise("unresolved")
    return n.join(strict, list(keys), "left").select(*keys, "n", kind.alias("class"))


def trailing_mean(df: DataFrame, keys: Sequence[str], order: Order, value: str, width: int, name: str = "smooth") -> DataFrame:
    """Mean of the last width rows of each key, fewer at its start."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - width, 0)))


def segment_shares(df: DataFrame, keys: Sequence[str], segment: str, value: str) -> DataFrame:
    """keys, segment, share of the key's mass in each segment; 0 where a key has none."""
    part = df.groupBy(*keys, segment).agg(F.sum(value).alias("mass"))
    whole = part.groupBy(*keys).agg(F.sum("mass").alias("total"))
    return part.join(whole, list(keys)).select(*keys, segment, F.when(F.col("total") != 0, F.col("mass") / F.col("total")).otherwise(0.0).alias("share"))


def surface(parts: DataFrame, keys: Sequence[str], order: str, text: str, start: str, end: str, name: str = "surface") -> DataFrame:
    """Tokens joined in order, with a space where one begins after the last one's end."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(text).alias("t"))))
    grouped = parts.groupBy(*keys).agg(rows.alias("_p"))
    spaced = F.transform("_p", lambda p, i: F.concat(F.when((i > 0) & (p["s"] > F.get(F.col("_p"), i - 1)["e"]), " ").otherwise(""), p["t"]))
    return grouped.select(*keys, F.array_join(spaced, "").alias(name))


def codebook(df: DataFrame, symbol: str) -> DataFrame:
    """symbol, n, code: symbols by falling frequency, then name, numbered from 0.

    Numbers are given by ranges: symbols are range-partitioned and sorted, and each range starts after
    the rows of those before it, so no task sees all symbols."""
    counts = df.groupBy(symbol).agg(F.count("*").alias("n")).repartitionByRange(F.desc("n"), F.asc(symbol)).sortWithinPartitions(F.desc("n"), F.asc(symbol))
    numbered = counts.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))  # a row for each range
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._size"), F.lit(0)).alias("_before"))
    return numbered.join(F.broadcast(before), "_part").select(symbol, "n", (F.col("_before") + F.col("_at")).alias("code"))
