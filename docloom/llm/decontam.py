"""Benchmark decontamination by winnowing.

Words are hashed; k-gram hashes are winnowed: of every ``window - k + 1`` consecutive k-grams the one
with the smallest hash is a fingerprint. Both sides choose alike from the content of a window, so a
shared span of ``window`` words always shares a fingerprint. A document's windows whose fingerprint is
one of the benchmark's are extended to the full window and joined with the benchmark's windows.

The fingerprints of the benchmark reach the documents' tasks as a Bloom filter of 16 bits for each, up
to ``BLOOM_BYTES``; beyond that only the share of false hits grows. False hits go at the join, which
compares two 64-bit hashes of the whole window, both from 64-bit hashes of its words. An item of fewer
words than a window is one window of its length; its hash is looked up among all spans of that length
(there are at most ``window - 1`` such lengths).

Windows that belong to the same items share an item set, known by sums over its items' hashes, so no
window's items are gathered. Documents with the same item sets share one signature, and an item list and
its digest are made once for each signature, not for each document.

Defined results: null, empty and word-less texts have no words and are not contaminated; texts of any
length are read whole; word-less items are no windows; an item of fewer words than a window that equals
part of a longer one counts by itself; documents at exactly one word in ``one_in`` are contaminated;
repeated documents come out once each; repeated items with one id count once, a null item_id is no item;
an empty benchmark leaves all documents clean; an empty documents table gives no rows; other columns
aren't read, and clean() returns them as they are. doc_id and item_id must be numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, text_of, without

WINDOW = 13
K = 5
#: Contaminated from this share of hit words on: one in so many.
ONE_IN = 20
BLOOM_BYTES = 1 << 25
_HASHES = 4

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
#: A-Z to lower case, other ASCII characters that aren't letters or digits to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) < 150_000:
            self[word] = h
        return h


_known = Words()


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, n: int, base: np.uint64 = _A) -> np.ndarray:
    """A mixed 64-bit hash of each n consecutive words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = out * base + words[i : i + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each span consecutive hashes, the place of the smallest (the first of equals)."""
    if len(hashes) < span:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(hashes, span).argmin(axis=1) + np.arange(len(hashes) - span + 1)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Places in a filter of size bits, one row for each of the filter's hashes."""
    with np.errstate(over="ignore"):
        step = hashes * _B | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) >> np.uint64(1) for i in range(_HASHES)]) % np.uint64(size)


def _contains(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _bits(hashes, len(bloom) * 8)
    return ((bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


_SPAN = "struct<start: int, len: int, h1: long, h2: long>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("len", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _windows(words: np.ndarray, starts: np.ndarray, n: int, first: np.ndarray) -> list[dict]:
    second = grams(words, n, _B)[starts].view(np.int64).tolist()
    return [{"start": s, "len": n, "h1": a, "h2": b} for s, a, b in zip(starts.tolist(), first[starts].view(np.int64).tolist(), second, strict=True)]


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """item_id, start, len, h1, h2, fp: every window of every item with the fingerprint a document would choose for it."""
    schema = pa.schema([("item_id", pa.int64()), ("len", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(text)
                if not len(words):
                    continue
                n = min(window, len(words))
                whole = grams(words, n)
                fps = whole if n < window else (g := grams(words, k))[winnow(g, window - k + 1)]
                out += [(item, n, x["h1"], x["h2"], f) for x, f in zip(_windows(words, np.arange(len(whole)), n, whole), fps.view(np.int64).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return items.filter("item_id is not null").select(F.col("item_id").cast("long"), text_of()).mapInArrow(run, "item_id long, len int, h1 long, h2 long, fp long")


def _bloom(hashes: DataFrame, most: int = BLOOM_BYTES) -> np.ndarray:
    """The filter of a column of longs, two bytes for each: at most most / 8 words reach the driver, each the OR of its bits."""
    hashes = hashes.distinct()
    size = min(most, max(64, 2 * hashes.count() + 7 >> 3 << 3))

    def run(batches):
        own = np.zeros(size, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy().view(np.uint64), size * 8).ravel()
            np.bitwise_or.at(own, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(words[used], pa.int64())], names=["word", "bits"])

    merged = hashes.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(size // 8, np.int64)
    for r in merged.toLocalIterator():
        out[r.word] = r.bits
    return out.view(np.uint8)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(base, lines). base: row (a number of its own for each row of docs), doc_id, text_key (a hash of the text),
    n_words and spans, the windows whose fingerprint passed the filter. lines: the items' windows."""
    spark = docs.sparkSession
    lines = stored(_item_windows(items, window, k), "item-windows")
    shorter = [r.len for r in lines.filter(F.col("len") < window).select("len").distinct().collect()]  # at most window - 1 numbers
    bloom = spark.sparkContext.broadcast(_bloom(lines.select("fp")))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(_SPAN_TYPE))])
    span = window - k + 1

    def spans(words: np.ndarray) -> list[dict]:
        out = []
        if len(words) >= window:
            g = grams(words, k)
            chosen = winnow(g, span)
            places = np.unique(chosen)
            listed = np.zeros(len(g), bool)
            listed[places] = _contains(bloom.value, g[places])
            starts = np.flatnonzero(listed[chosen])
            if len(starts):
                out += _windows(words, starts, window, grams(words, window))
        for n in shorter:
            whole = grams(words, n)
            if len(starts := np.flatnonzero(_contains(bloom.value, whole)) if len(whole) else []):
                out += _windows(words, starts, n, whole)
        return out

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1):
                n_words, found = [], []
                for text in part.column(1).to_pylist():
                    words = word_hashes(text)
                    n_words.append(len(words))
                    found.append(spans(words))
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(found)), pa.int64()), part.column(0), part.column(2), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(_SPAN_TYPE))], schema=schema)
                row += len(found)

    base = stored(bounded_batches(docs).select(F.col("doc_id").cast("long"), text_of(), F.xxhash64(text_of())).mapInArrow(run, f"row long, doc_id long, text_key long, n_words long, spans array<{_SPAN}>"), "document-windows")
    return base, lines


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, one_in: int = ONE_IN) -> tuple[DataFrame, DataFrame]:
    """(rows, lists). rows: row, doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated and signature (null: no
    item) of every row of docs(doc_id, text). lists: signature and item_ids (array of strings in order), once for each signature."""
    base, lines = hits(docs, items, window, k)
    lines = stored(lines.select("h1", "h2", "len", "item_id").distinct(), "window-items")
    item = F.col("item_id")
    name = F.concat_ws(":", F.count("*"), F.bit_xor(F.xxhash64(item, F.lit(1))), F.sum(F.xxhash64(item, F.lit(2)).cast("decimal(20,0)")))
    sets = stored(lines.groupBy("h1", "h2", "len").agg(name.alias("item_set")), "item-sets")
    found = base.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(sets, ["h1", "h2", "len"])
    marks = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"), F.array_sort(F.collect_set("item_set")).alias("item_sets"))
    covered = F.expr("aggregate(spans, struct(0L as n, 0 as reach), (a, s) -> struct(a.n + greatest(0, s.end - greatest(s.start, a.reach)) as n, greatest(a.reach, s.end) as reach), a -> a.n)")
    marks = stored(marks.select("row", covered.alias("n_hit"), F.sha2(F.array_join("item_sets", ","), 256).alias("signature"), "item_sets"), "marks")
    # first(): rows with one signature have one list of item sets, and windows with one item set the same items.
    named = marks.groupBy("signature").agg(F.first("item_sets").alias("item_sets")).select("signature", F.explode("item_sets").alias("item_set"))
    shown = stored(sets.groupBy("item_set").agg(F.min(F.struct("h1", "h2", "len")).alias("w")).select("item_set", "w.*").join(named, "item_set").select("signature", "h1", "h2", "len"), "shown-windows")
    ids = lines.join(shown, ["h1", "h2", "len"]).select("signature", item.cast("string").alias("item"))
    lists = stored(ids.groupBy("signature").agg(F.array_sort(F.collect_set("item")).alias("item_ids")).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)), "item-lists")
    hit = marks.select("row", "n_hit", "signature").join(lists.select("signature", F.size("item_ids").cast("long").alias("n_items"), "items_sha256"), "signature")
    zero, empty = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    columns = "row", "doc_id", "text_key", "n_words"
    plain = base.filter(F.size("spans") == 0).select(*columns, zero.alias("n_hit"), zero.alias("n_items"), empty.alias("items_sha256"), F.lit(None).cast("string").alias("signature"))
    marked = base.filter(F.size("spans") > 0).select(*columns).join(hit, "row", "left").select(*columns, F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), "signature")
    rows = plain.unionByName(marked).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))
    return rows, lists.select("signature", "item_ids")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, one_in: int = ONE_IN) -> DataFrame:
    """The rows of judged()."""
    return judged(docs, items, window, k, one_in)[0]


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. The few others are known by doc_id and text."""
    found = contamination(docs, items).filter("contaminated")
    bad = stored(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "contaminated")
    return without(docs, bad)
