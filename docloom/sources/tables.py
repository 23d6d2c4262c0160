"""Readers of stored tables, and the shapes that text operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. Nothing is inferred: its footers carry the schema, and Spark prunes columns and pushes filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_units(*lanes: tuple[DataFrame, str, str, str, str]) -> DataFrame:
    """unit_id, source_id, source_type, text from lanes of (table, source type, id column, source column, text column).

    Ids are prefixed with the source type, so lanes never clash."""
    out = None
    for df, kind, unit, source, text in lanes:
        rows = df.select(F.concat_ws(":", F.lit(kind), F.col(unit).cast("string")).alias("unit_id"), F.col(source).cast("string").alias("source_id"), F.lit(kind).alias("source_type"), F.col(text).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out
