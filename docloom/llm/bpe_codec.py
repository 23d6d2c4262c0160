"""Byte-level BPE encoding and decoding, long texts by overlapping chunks.

A text of up to ``chunk_chars`` characters is one chunk. A longer one is cut into cores of that
length, each read ``overlap_chars`` beyond its end. All chunks are pre-tokenised side by side, each
from its own start. Two neighbours are stitched at the first position of their overlap that both
have as a pre-token boundary and that lies between a visible character and white space: no match of
the pattern can cross such a place and none before it looks beyond it, so what follows is as in one
pass over the whole text. Where an overlap has no such place (one very long run), the neighbours
stay one piece. Pieces are then encoded side by side and their ids joined in order.

Defined results: a null or empty text has no ids and decodes to no bytes; a repeated row comes out
as often as it came in; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, by_slices, text_of, vocabulary

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("docloom", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    by_id = ranks(path)
    out = [b""] * (max(by_id.values()) + 1)
    for token, rank in by_id.items():
        out[rank] = token
    return out


def boundaries(text: str, pattern: str, whole: bool) -> list[int]:
    """Ends of the pre-tokens of text that can't change with what follows it (whole: nothing follows)."""
    import regex

    return [m.end() for m in regex.finditer(pattern, text) if whole or m.end() + 1 < len(text)]


def _stitchable(text: str, ends: list[int], low: int, high: int) -> list[int]:
    return [e for e in ends if low < e < min(high, len(text)) and not text[e - 1].isspace() and text[e] in " \n"]


def _encoder(path: str, pattern: str, keep: pa.Schema, spelled: bool = False):
    """The columns of keep and token_ids of a text, the last column; spelled: and content, what decode() makes of the ids."""
    schema = keep.append(pa.field("token_ids", pa.list_(pa.int32())))
    schema = schema.append(pa.field("content", pa.binary())) if spelled else schema

    def work(columns: list[list]) -> dict:
        encode = _encoding(path, pattern).encode_ordinary
        ids = [encode(t) for t in columns[-1]]
        out = dict(zip(keep.names, columns, strict=False)) | {"token_ids": pa.array(ids, pa.list_(pa.int32()))}
        return out | {"content": pa.array(_spell(ids, path), pa.binary())} if spelled else out

    return by_slices(work, schema)


def _spell(ids: list[list[int] | None], path: str) -> list[bytes]:
    spell = _token_bytes(path).__getitem__
    return [b"".join(map(spell, i or ())) for i in ids]


def _by_length(docs: DataFrame, path: str | None, pattern: str | None, chunk_chars: int, overlap_chars: int) -> tuple[DataFrame, DataFrame, str, str]:
    """doc_id and text of short and of long texts, path and pattern with their defaults."""
    if not 2 * overlap_chars < chunk_chars:
        raise ValueError("an overlap must be shorter than half a chunk")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.filter(F.length("text") <= chunk_chars), rows.filter(F.length("text") > chunk_chars), path or vocabulary("byte_bpe_50k.tiktoken"), pattern


_KEY = pa.schema([("doc_id", pa.int64())])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, token_ids (array<int>) of every row of docs(doc_id, text)."""
    short, long, path, pattern = _by_length(docs, path, pattern, chunk_chars, overlap_chars)
    encoded = short.mapInArrow(_encoder(path, pattern, _KEY), "doc_id long, token_ids array<int>")
    return encoded.unionByName(_encode_long(long, path, pattern, chunk_chars, overlap_chars))


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """decode(encode(docs)), with one Python worker a task where that takes two: the ids of short texts are decoded by the worker that has them."""
    short, long, path, pattern = _by_length(docs, path, pattern, chunk_chars, overlap_chars)
    both = short.mapInArrow(_encoder(path, pattern, _KEY, spelled=True), "doc_id long, token_ids array<int>, content binary")
    return both.unionByName(decode(_encode_long(long, path, pattern, chunk_chars, overlap_chars), path))


def _encode_long(rows: DataFrame, path: str, pattern: str, core: int, overlap: int) -> DataFrame:
    chunk_schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("copies", pa.int64()), ("chunk", pa.int32()), ("core", pa.string()), ("extra", pa.string()), ("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))])

    def pretokenise(columns: list[list]) -> dict:
        doc_id, text_key, copies, chunk, body, last = columns
        heads, tails = [], []
        for text, k, end in zip(body, chunk, last, strict=True):
            ends = boundaries(text, pattern, end)
            heads.append([] if k == 0 else _stitchable(text, ends, 0, overlap))
            tails.append([] if end else [e - core for e in _stitchable(text, ends, core, core + overlap)])
        return {"doc_id": doc_id, "text_key": text_key, "copies": copies, "chunk": chunk, "core": [t[:core] for t in body], "extra": [t[core:] for t in body], "head": heads, "tail": tails}

    # Equal rows are encoded once; copies says how often they come out. That also makes (doc_id, text_key) a key.
    once = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    n = F.ceil(F.length("text") / F.lit(core)).cast("int")
    chunks = once.select("doc_id", F.sha2("text", 256).alias("text_key"), "copies", "text", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk")).select(
        "doc_id", "text_key", "copies", "chunk", F.expr(f"substring(text, chunk * {core} + 1, {core + overlap})").alias("body"), (F.col("chunk") == F.col("n") - 1).alias("last")
    )
    # The chunks of one text are dealt to different tasks; each text is then brought together in order.
    cut = chunks.repartition("doc_id", "text_key", "chunk").mapInArrow(by_slices(pretokenise, chunk_schema, text=4), "doc_id long, text_key string, copies long, chunk int, core string, extra string, head array<int>, tail array<int>")
    order = Window.partitionBy("doc_id", "text_key").orderBy("chunk")
    joined = cut.withColumn("stitch", F.array_min(F.array_intersect("tail", F.lead("head").over(order))))
    joined = joined.withColumn("begin", F.lag("stitch").over(order)).withColumn("piece", F.count("stitch").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.concat(F.expr("substring(core, coalesce(begin, 0) + 1)"), F.expr("substring(extra, 1, coalesce(stitch, 0))"))
    pieces = joined.groupBy("doc_id", "text_key", "copies", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", own.alias("part")))).alias("parts"))
    pieces = pieces.select("doc_id", "text_key", "copies", "piece", F.concat_ws("", F.col("parts.part")).alias("text"))
    keep = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("copies", pa.int64()), ("piece", pa.int64())])
    encoded = pieces.mapInArrow(_encoder(path, pattern, keep), "doc_id long, text_key string, copies long, piece long, token_ids array<int>")
    whole = encoded.groupBy("doc_id", "text_key", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "token_ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten("parts.token_ids").alias("token_ids"), F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("doc_id", "token_ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token_ids, content (binary): the joined bytes of the ids. A null array decodes to no bytes."""
    path = path or vocabulary("byte_bpe_50k.tiktoken")
    schema = pa.schema([("doc_id", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("content", pa.binary())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                content = _spell(part.column(1).to_pylist(), path)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(schema.field(1).type), pa.array(content, pa.binary())], schema=schema)

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, token_ids array<int>, content binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )
