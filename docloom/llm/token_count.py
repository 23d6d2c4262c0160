"""Token counts of a BPE model with white-space marks and byte fallback, without emitting ids.

count = initial symbols - merges. Symbols form a linked list; a heap holds the adjacent pairs that
are pieces, lowest rank (highest score) first, then leftmost. The first is popped and merged, and
its new neighbours are pushed, until the heap is empty. A character outside the vocabulary counts as
its UTF-8 bytes. No piece of the vocabulary crosses from another character to a white-space mark, and
none of several characters holds some control characters; so a text falls apart into units there,
which are counted once and remembered. Both facts are read from the vocabulary, and where they don't
hold the whole text is one unit.

Defined results: a null or empty text has 0 bytes and 0 tokens; any length works, in n log n steps;
rows are counted one by one, so repeated rows come out alike; an empty table gives none; other
columns aren't read.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, text_of, vocabulary

MARK = "▁"
TOKEN_LIMIT = 4096
#: Units that a worker remembers; once full, the cache stays as it is (frequent units come early).
CACHE_UNITS = 800_000
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


class Counter:
    """Counts for one model file. The cache changes speed only."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as data:
            model.ParseFromString(data.read())
        norm, trained = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if trained.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or trained.treat_whitespace_as_suffix or USER_DEFINED in kinds or 5 in kinds:
            raise ValueError("only BPE models with identity normalisation and without user-defined or unused pieces")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.bytes = trained.byte_fallback and BYTE in kinds
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        several = [p for p in self.score if len(p) > 1]
        crossing = any(MARK in p.lstrip(MARK) for p in several)
        inside = set("".join(several))
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        self.unit = re.compile("(?s).+" if crossing else f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.known: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        return self.unit.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def merged(self, unit: str) -> int:
        """Tokens of a unit, by the heap."""
        symbols, score = list(unit), self.score
        n = len(symbols)
        if self.bytes:
            count = sum(1 if c in score else len(c.encode()) for c in symbols)
        else:
            count = n
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or right[i] != j or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            count -= 1
            after = right[i] = right[j]
            if after < n:
                left[after] = i
                s = score.get(piece + symbols[after])
                if s is not None:
                    heapq.heappush(heap, (-s, i, after, piece + symbols[after]))
            before = left[i]
            if before >= 0:
                s = score.get(symbols[before] + piece)
                if s is not None:
                    heapq.heappush(heap, (-s, before, i, symbols[before] + piece))
        return count

    def count(self, text: str) -> int:
        known, total = self.known, 0
        for unit in self.units(text):
            n = known.get(unit)
            if n is None:
                n = self.merged(unit)
                if len(unit) <= 64 and len(known) < CACHE_UNITS:
                    known[unit] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text)."""
    path = path or vocabulary("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def work(columns: list[list]) -> dict:
        own = counter(path)
        doc_id, n_bytes, text = columns
        n = [own.count(t) for t in text]
        return {"doc_id": doc_id, "n_bytes": n_bytes, "n_tokens": n, "over_limit": [x > limit for x in n]}

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("text"))
    return rows.mapInArrow(by_slices(work, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
