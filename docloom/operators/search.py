"""Full-text ranking and merged search results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """token, key, tf, len (tokens of the document)."""
    rows = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("len"), F.explode("_t").alias("token"))
    return rows.groupBy("token", key, "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = 1.2, b: float = 0.75, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of the k best documents for a query's words.

    Only the query's words are exploded; a document's length comes from the same pass."""
    words = sorted({w.lower() for w in query.split()})
    counts = docs.select(key, tokens(F.col(text)).alias("_t")).select(key, F.size("_t").alias("len"), F.filter("_t", lambda t: t.isin(*words)).alias("_h"))
    totals = counts.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    hits = counts.filter(F.size("_h") > 0).select(key, "len", F.explode("_h").alias("token")).groupBy("token", key, "len").agg(F.count("*").alias("tf"))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    rows = hits.join(F.broadcast(df), "token").crossJoin(F.broadcast(totals))  # a row for each query word, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return rows.groupBy(key).agg(F.round(F.sum(score), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def merge_rank(results: DataFrame, priority: str, language: str, preferred: Sequence[str], ties: Sequence[str], k: int) -> DataFrame:
    """The first k results by falling priority, then the place of their language among the preferred ones (others last), then ties."""
    place = F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col(language))
    return results.orderBy(F.desc(priority), F.when(place > 0, place).otherwise(len(preferred) + 1), *ties).limit(k)


def memory(notes: DataFrame, query_topics: Sequence[str], topics: str = "topics") -> DataFrame:
    """Notes that share a topic with the query, with the shared ones."""
    asked = F.array(*[F.lit(t) for t in query_topics])
    return notes.filter(F.arrays_overlap(topics, asked)).withColumn("matched", F.array_sort(F.array_intersect(topics, asked)))


def best_products(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, block: int = 1024) -> DataFrame:
    """query_id, key, dot: for each query the k rows of the largest inner product (ties: the smaller key).

    Keys are whole numbers. Blocks of both sides meet in one matrix product, and only k rows a query leave it."""

    def blocks(df: DataFrame, prefix: str, size: int) -> DataFrame:
        packed = df.groupBy(F.floor(F.col(key) / size).alias("_b")).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("i"), F.col(vector).alias("v"))).alias("_p"))
        return packed.select(F.col("_p.i").alias(f"{prefix}i"), F.col("_p.v").alias(f"{prefix}v"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qv, ri, rv in zip(pdf["qi"], pdf["qv"], pdf["ri"], pdf["rv"], strict=True):
                ids = np.asarray(ri)
                order = np.argsort(ids)
                ids, held = ids[order], np.stack(rv).astype("float64")[order]
                dots = np.stack(qv).astype("float64") @ held.T
                top = np.argsort(-dots, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(np.asarray(qi), top.shape[1]), key: ids[top].ravel(), "dot": np.take_along_axis(dots, top, 1).ravel()})

    pairs = blocks(queries, "q", block * 50).crossJoin(blocks(rows, "r", block))
    near = pairs.mapInPandas(work, f"query_id long, `{key}` long, dot double")
    w = Window.partitionBy("query_id").orderBy(F.desc("dot"), key)
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
