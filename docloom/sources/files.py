"""Files in and out: inventories, dispatch by type, text units with spans, imports, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Fixed table of adapters by file extension.
ADAPTERS = {"txt": "text", "md": "text", "html": "html", "htm": "html", "json": "json", "jsonl": "json", "pdf": "pdf", "parquet": "table"}


def adapter(path: Column) -> Column:
    """The adapter of a path by its extension; unsupported otherwise."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ext == e, a) for e, a in ADAPTERS.items()], F.lit("unsupported"))


def inventory(spark: SparkSession, root: str, glob: str = "*", max_file_bytes: int = 1 << 30, max_total_bytes: int = 1 << 50) -> DataFrame:
    """path, bytes, adapter, status of every file below root that a pattern names; contents aren't read.

    Files are admitted in order of their path until the total is reached. Running totals are taken
    within groups of paths, and the groups' sums before them, so no task sees all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select(F.col("path"), F.col("length").alias("bytes"))
    return admitted(files, max_file_bytes, max_total_bytes)


def admitted(files: DataFrame, max_file_bytes: int, max_total_bytes: int) -> DataFrame:
    """files(path, bytes) with adapter and status: admitted, unsupported, too_large or over_total."""
    kind = adapter(F.col("path"))
    fit = F.when(kind == "unsupported", "unsupported").when(F.col("bytes") > max_file_bytes, "too_large").otherwise("candidate")
    rows = files.withColumn("adapter", kind).withColumn("_fit", fit).withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    size = F.when(F.col("_fit") == "candidate", F.col("bytes")).otherwise(0)
    folders = rows.groupBy("_folder").agg(F.sum(size).alias("_sum"))
    before = running_totals(folders, "_folder", "_sum").select("_folder", F.col("before").alias("_before"))
    total = F.sum(size).over(Window.partitionBy("_folder").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    status = F.when(F.col("_fit") != "candidate", F.col("_fit")).when(total > max_total_bytes, "over_total").otherwise("admitted")
    return rows.join(before, "_folder").select("path", "bytes", "adapter", status.alias("status"))


def running_totals(rows: DataFrame, order: str, value: str) -> DataFrame:
    """rows with before: the sum of value over all rows of a smaller order (distinct), without one task that sees them all.

    Rows are dealt by ranges of order and summed within each; a number for each range meets in one more step."""
    dealt = stored(rows.repartitionByRange(F.asc_nulls_first(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy("_range").agg(F.sum(value).alias("_s"))  # as many rows as ranges
    ahead = parts.select("_range", F.coalesce(F.sum("_s").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_a"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_w", within).join(ahead, "_range").withColumn("before", F.col("_a") + F.col("_w")).drop("_range", "_a", "_w")


def text_segments(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, segment, start, end, segment_text: lines with their half-open spans in the text; empty lines are left out."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select(key, F.posexplode(lines).alias("segment", "segment_text"))
    w = Window.partitionBy(key).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("segment_text") + 1).over(w), F.lit(0))
    return rows.select(key, "segment", start.alias("start"), (start + F.length("segment_text")).alias("end"), "segment_text").filter("segment_text <> ''")


def dot(edges: DataFrame, by: str, src: str, dst: str) -> DataFrame:
    """by, graph: a DOT text of each group's edges, in order."""
    lines = F.array_sort(F.collect_set(F.concat(F.lit('  "'), F.col(src).cast("string"), F.lit('" -> "'), F.col(dst).cast("string"), F.lit('";'))))
    return edges.groupBy(by).agg(F.concat(F.lit("digraph {\n"), F.array_join(lines, "\n"), F.lit("\n}")).alias("graph"))


def export(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write a table as parquet, orc, json or csv (with a header)."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    if kind == "csv":
        writer = writer.option("header", True)
    if kind not in ("parquet", "orc", "json", "csv"):
        raise ValueError(f"unknown kind {kind!r}")
    writer.format(kind).save(path)


def import_run(have: DataFrame, new: DataFrame, keys: list[str], run: str) -> DataFrame:
    """have with the rows of a run's import: known keys are updated and carry the run's id."""
    from ..operators.versioned import upsert

    return upsert(have, new.withColumn("import_run_id", F.lit(run)), keys)
