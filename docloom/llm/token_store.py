"""Token-id files with Elias-Fano document boundaries.

File format: Parquet, so that Spark's own commit protocol covers retries and any store Spark can
reach will do. A row is a block of whole documents, in ascending doc_id order (nulls first, equal ids
by a hash of the text): ``shard`` and ``block`` (their order), ``shard_start`` (ids of the shard
before the block), ``n_docs``, ``n_null`` (documents without doc_id, in front), ``n_tokens``, ``ids``
(little-endian unsigned ids of ``width`` bytes), and two Elias-Fano sequences, ``ends`` (ends of the
documents in the block's id array) and ``doc_ids`` (less ``doc_base``). ``select(i)`` finds any
document's offset from the samples, without a table of 64-bit offsets; fetch() reads single documents
that way.

A block ends after ``block_tokens`` ids, at the end of a document; one document is never split.

Defined results: a null or empty text is one end id; repeated rows are stored as often as they come;
an empty table makes no block and reads back as no rows; other columns aren't read; special strings inside a text are encoded as
the tokenizers library does by default.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, slices, stored, text_of, vocabulary

END_ID = 0
BLOCK_TOKENS = 1 << 18
SAMPLE = 64
#: Ids that fetch() looks up, at most.
FETCH_IDS = 100_000


class EliasFano:
    """A sequence of non-decreasing non-negative integers in about 2 + log2(largest / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if width else np.zeros(0, np.uint8)
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1, np.uint8)
        bits[at] = 1
        return cls(n, width, low.tobytes(), np.packbits(bits, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes())

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.uint64)
        a, b = first * self.low_bits, last * self.low_bits
        raw = np.unpackbits(np.frombuffer(self.low, np.uint8, (b + 7) // 8 - a // 8, a // 8), bitorder="little")[a % 8 : a % 8 + b - a]
        return raw.reshape(-1, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, over the set bits of the upper part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4", 1, i // SAMPLE * 4)[0])
        left, byte = i % SAMPLE, at // 8
        word = self.high[byte] >> at % 8 << at % 8
        while left >= (ones := word.bit_count()):
            left, byte = left - ones, byte + 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        return (at - i) << self.low_bits | int(self._low(i, i + 1)[0])

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return (at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | self._low(0, self.n)


#: A unit ends before one of four kinds of white space, and after letters before an ASCII mark other than an apostrophe.
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"!-&(-/:-@\[-`{-~"
_UNIT = re.compile(f"[ \n\t\r]*(?:[{_LETTERS}]+(?=[{_MARKS}])|[^ \n\t\r]+)|[ \n\t\r]+")
#: White space beyond those four, for any reading of "white space".
_OTHER_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Units that a worker remembers, of so many characters at most.
CACHE_UNITS, CACHE_CHARS = 600_000, 48


class LibraryIds(dict):
    """The ids of the tokenizers library, little-endian, ``width`` bytes each; as a dict, of units met before.

    In a byte-level file whose pre-tokeniser uses its own pattern, with neither normaliser nor prefix
    space nor special strings that strip space, no pre-token goes on from a visible character to a space
    or line end, or from a letter to a mark, and none before such a place looks beyond it. So a text's ids
    are those of the units between these places; each distinct unit is encoded by the library and
    remembered up to a bound. Texts with rarer white space or a special string, and every text of any
    other file, go to the library whole.
    """

    def __init__(self, path: str, by_units: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.by_units = by_units and self._falls_apart(path)
        specials = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.whole_only = re.compile("|".join([_OTHER_SPACE, *specials]))

    def _falls_apart(self, path: str) -> bool:
        with open(path, encoding="utf-8") as data:
            spec = json.load(data)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        tokens = self.library.get_added_tokens_decoder().values()
        return plain and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in tokens) and not spec.get("truncation") and not spec.get("padding")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def __missing__(self, unit: str) -> bytes:
        ids = self.whole(unit)
        if len(unit) <= CACHE_CHARS and len(self) < CACHE_UNITS:
            self[unit] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [b"".join(map(self.__getitem__, _UNIT.findall(t))) if self.by_units and not self.whole_only.search(t) else self.whole(t) for t in texts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> LibraryIds:
    return LibraryIds(path)


_SEQUENCE = "struct<n: int, low_bits: int, low: binary, high: binary, samples: binary>"
_BLOCK = f"shard int, block int, shard_start long, n_docs int, n_null int, n_tokens long, width int, ids binary, ends {_SEQUENCE}, doc_base long, doc_ids {_SEQUENCE}"
_SEQUENCE_TYPE = pa.struct([("n", pa.int32()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
_BLOCK_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("shard_start", pa.int64()), ("n_docs", pa.int32()), ("n_null", pa.int32()), ("n_tokens", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("ends", _SEQUENCE_TYPE), ("doc_base", pa.int64()), ("doc_ids", _SEQUENCE_TYPE)])


def _fields(x: EliasFano) -> dict:
    return {"n": x.n, "low_bits": x.low_bits, "low": x.low, "high": x.high, "samples": x.samples}


def write(docs: DataFrame, where: str, path: str | None = None, block_tokens: int = BLOCK_TOKENS, partitions: int | None = None) -> None:
    """Encode docs(doc_id, text) and write the token files to the folder where."""
    path = path or vocabulary("byte_bpe_50k.json")

    def blocks(batches):
        own = tokenizer(path)
        end = np.array([END_ID], own.type).tobytes()
        shard, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        names, parts = [], []

        def close():
            nonlocal block, start, size
            ends = np.cumsum([len(p) for p in parts]) // own.width
            known = [x for x in names if x is not None]
            base = known[0] if known else 0
            row = {"shard": shard, "block": block, "shard_start": start, "n_docs": len(parts), "n_null": len(parts) - len(known), "n_tokens": int(ends[-1]), "width": own.width, "ids": b"".join(parts), "ends": _fields(EliasFano.of(ends)), "doc_base": base, "doc_ids": _fields(EliasFano.of(np.array([x - base for x in known], np.uint64)))}
            block, start, size = block + 1, start + int(ends[-1]), 0
            names.clear()
            parts.clear()
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for part in slices(batch, 1):
                doc_id, text = (c.to_pylist() for c in part.columns[:2])
                for name, raw in zip(doc_id, own.encode(text), strict=True):
                    names.append(name)
                    parts.append(raw + end)
                    size += len(parts[-1]) // own.width
                    if size >= block_tokens:
                        yield close()
        if parts:
            yield close()

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # The text's hash is part of the range, so rows of one id, or without any, don't all meet in one task.
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()
    dealt = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    dealt.mapInArrow(blocks, _BLOCK).write.parquet(where)


def read(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit) of every stored document, from the files alone."""
    stored = spark.read.schema(_BLOCK).parquet(where)
    # One number for each shard (as many as write() had tasks) goes to the driver and back.
    sizes = sorted(stored.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.shard)
    starts, at = [], 0
    for r in sizes:
        starts.append((r.shard, at))
        at += r.n
    offsets = spark.createDataFrame(starts, "shard int, before long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def documents(batches):
        for batch in batches:
            for b in batch.to_pylist():
                raw = np.frombuffer(b["ids"], f"<u{b['width']}")
                ends = EliasFano(**b["ends"]).all().astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                names = [None] * b["n_null"] + [b["doc_base"] + int(x) for x in EliasFano(**b["doc_ids"]).all()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(begins + b["start"], pa.int64()), pa.array([raw[x:y].astype("<u4").tobytes() for x, y in zip(begins, ends, strict=True)], pa.binary())], schema=schema)

    rows = stored.join(F.broadcast(offsets), "shard").select("n_null", "width", "ids", "ends", "doc_base", "doc_ids", (F.col("before") + F.col("shard_start")).alias("start"))
    return rows.mapInArrow(documents, "doc_id long, start long, ids binary")


def _first_at_least(x: EliasFano, value: int) -> int:
    """The index of the first element not below value, by select()."""
    low, high = 0, x.n
    while low < high:
        mid = (low + high) // 2
        if x.select(mid) < value:
            low = mid + 1
        else:
            high = mid
    return low


def fetch(spark: SparkSession, where: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the stored documents whose id is in wanted(doc_id), by select() alone: a block's other documents aren't decoded.

    Up to FETCH_IDS ids reach every task, and each block takes those between its first and last. A repeated stored id comes out as often as it is stored, an unknown or null one not at all."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    few = [r.doc_id for r in wanted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().limit(FETCH_IDS + 1).collect()]
    if len(few) > FETCH_IDS:
        raise ValueError(f"more than {FETCH_IDS} ids; join read() with them")
    names = np.sort(np.array(few, np.int64))

    def asked_of(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                last = r["doc_base"] + EliasFano(**r["doc_ids"]).select(r["doc_ids"]["n"] - 1)
                own = names[np.searchsorted(names, r["doc_base"]) : np.searchsorted(names, last, "right")]
                if len(own):
                    out.append((r["shard"], r["block"], own.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["s", "b", "asked"])

    def cut(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                names, ends, raw = EliasFano(**r["doc_ids"]), EliasFano(**r["ends"]), np.frombuffer(r["ids"], f"<u{r['width']}")
                for doc_id in sorted(r["asked"]):
                    i = _first_at_least(names, doc_id - r["doc_base"])
                    while i < names.n and names.select(i) == doc_id - r["doc_base"]:
                        at = r["n_null"] + i
                        out.append((doc_id, raw[ends.select(at - 1) if at else 0 : ends.select(at)].astype("<u4").tobytes()))
                        i += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    blocks = spark.read.schema(_BLOCK).parquet(where).filter("n_docs > n_null")
    # Only the ends and ids of blocks are read to find those that are asked.
    asked = stored(blocks.select("shard", "block", "doc_base", "doc_ids").mapInArrow(asked_of, "s int, b int, asked array<long>"), "store-asked")
    return blocks.join(asked, (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))).select("doc_base", "n_null", "width", "ids", "ends", "doc_ids", "asked").mapInArrow(cut, "doc_id long, ids binary")


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return documents.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
