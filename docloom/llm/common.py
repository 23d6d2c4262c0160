"""Small helpers the corpus operators share."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import clear, discard, mark, scratch, shared_dir, stored

__all__ = ["ascii_lower", "bounded_batches", "by_slices", "clear", "discard", "free_name", "mark", "placed", "scratch", "shared_dir", "slices", "stored", "table", "text_of", "vocabulary", "without"]

#: Rows and bytes of a slice in which Python code works through an Arrow batch; they bound what it holds besides the batch.
SLICE_ROWS, SLICE_BYTES = 512, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(columns: list[str], name: str) -> str:
    """name, or name_2, name_3 and so on: the first that none of the columns has (letter case aside)."""
    taken = {c.lower() for c in columns}
    n, found = 1, name
    while found.lower() in taken:
        n += 1
        found = f"{name}_{n}"
    return found


#: Bytes of a filter of keys, at most, and bits that a key gets below that.
FILTER_BYTES, BITS_PER_KEY = 1 << 23, 16


def _filter_mask(key: Column) -> Column:
    """Four bits of a word of 64."""
    bits = F.xxhash64(key, F.lit(1))
    places = [F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", bits, F.lit(6 * i)).bitwiseAND(63).cast("int")) for i in range(4)]
    return reduce(lambda a, b: a.bitwiseOR(b), places)


def possible(keys: DataFrame, key: str, most: int = FILTER_BYTES) -> Callable[[Column], Column]:
    """A test that is true for every long among keys and for few others: a blocked Bloom filter in expressions.

    A key's bits are in one word of 64. The filter's size follows the number of keys up to a bound, beyond
    which only the share of false hits grows; it is a table of one row, whose value reaches the tasks as a
    scalar subquery's. At most one number for each of its words passes the driver."""
    n = keys.count()
    words = max(1, min(most // 8, -(-n * BITS_PER_KEY // 64)))
    word = F.pmod(F.col(key), F.lit(words))
    merged = keys.filter(F.col(key).isNotNull()).select(word.alias("word"), _filter_mask(F.col(key)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table_ = bytearray(8 * words)
    for r in merged.toLocalIterator():
        struct.pack_into(">q", table_, 8 * r.word, r.bits)
    one = stored(keys.sparkSession.createDataFrame([(bytes(table_),)], "bits binary"), "key-filter").scalar()

    def test(k: Column) -> Column:
        own = F.conv(F.hex(F.substring(one, (F.pmod(k, F.lit(words)) * 8 + 1).cast("int"), F.lit(8))), 16, -10).cast("long")
        mask = _filter_mask(k)
        return own.bitwiseAND(mask) == mask

    return test


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text aren't in gone(_id, _key: the text's hash), null ids equal to null.

    Only rows that a filter of gone's keys can't rule out are joined; the others' texts stay where they are."""

    def row_key(doc_id: Column, text_key: Column) -> Column:
        return F.xxhash64(doc_id, text_key)

    text_key = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    maybe = F.coalesce(possible(gone.select(row_key(F.col("_id"), F.col("_key")).alias("k")), "k")(row_key(F.col("doc_id"), text_key)), F.lit(True))
    hit = docs.filter(maybe)
    same = hit["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(F.coalesce(hit["text"], F.lit(""))) == gone["_key"])
    return docs.filter(~maybe).unionByName(hit.join(gone, same, "left_anti"))


#: Items that placed() lists together.
PLACED_BLOCK = 256


def placed(items: Column, size: Callable[[Column], Column], made: Callable[[Column, Column], Column], kind: str) -> Column:
    """made(place, x) of every x of an array, flattened; made gives an array of type kind, and x's place is the sum of the sizes before it.

    An aggregate copies its list at each step, so lists are made for blocks of items and then joined:
    n items cost about n * (block + n / block) / 2 copied references instead of n * n / 2."""
    none = F.array().cast(kind)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PLACED_BLOCK).cast("int")), lambda b: F.slice(items, b * PLACED_BLOCK + 1, PLACED_BLOCK))

    def one(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], made(a["at"], x)).alias("out"))

    def block(a: Column, own: Column) -> Column:
        return F.aggregate(own, F.struct(a["at"].alias("at"), none.alias("out")), one, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))

    return F.when(F.size(items) > 0, F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda a: a["out"])).otherwise(none)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of an Arrow batch, at most: a task holds one on each side of the pipe to Python.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends Python no Arrow batch above BATCH_BYTES (but for a single larger row)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(conf.get(name)).rstrip("bB"))
    if now <= 0 or now > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded rows and bytes of a text or binary column; a single row may be larger."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + SLICE_ROWS, max(at + 1, int(ends.searchsorted(before + SLICE_BYTES, "right"))))
        yield batch.slice(at, to - at)
        at = to


def by_slices(work: Callable[[list[list]], dict[str, pa.Array | list]], schema: pa.Schema, text: int = -1) -> Callable:
    """A mapInArrow function: work gets the columns of a slice as Python lists and returns the output columns. text: the column that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text % batch.num_columns):
                out = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name] for f in schema], schema=schema)
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    return run
