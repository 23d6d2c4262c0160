"""SimHash near-duplicate classes by anchor-point covering.

Fingerprints (64 bits) that differ in at most ``t`` bits are linked; a class is a connected component.

Search. Equal fingerprints are one node. The 64 bits are three blocks; two fingerprints within t bits
are within t div 3 bits on some block. Each block has a covering code: the perfect Golay code on 23
bits (radius 3), twice, and on the last 18 bits a Hamming code of 15 with 3 free bits (radius 1). Its
codewords are the anchors. A fingerprint is at home at its nearest anchor and is sent to every anchor
within covering radius plus threshold; so of two linked fingerprints one finds the other's copy at its
home. (Anchors on all 64 bits at once would need balls of thousands of anchors for cells this small.)

A cell (one anchor) of up to ``cell_rows`` fingerprints is compared by one task, a bounded block at a
time, and gives a spanning forest of its links, never all pairs. A larger cell is dealt out again: the
bits outside its block are within t, so of t + 1 parts of them one is equal, and the words of a part
are its anchors. Cells that are still larger are dense clusters: there, fingerprints are joined
through every point within t div 2 of them; two of them share a point exactly if they are within
2 * (t div 2) bits (t even), each point has a bounded number of fingerprints around it, and a
fingerprint makes a bounded number of rows. Nothing is capped or dropped at any level.

Classes. Links meet in rounds of large-star and small-star steps on tables in the shared folder; no
component is ever gathered in one task or on the driver, and a hub's neighbours are spread over tasks.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text of any
length is read whole, in blocks of shingles; repeated rows come out once each; columns but doc_id and
text aren't read, whatever their names; a null doc_id is never the smallest of a class, and a class of
nulls only has a null component_id; fingerprints at exactly the threshold are linked; an empty table
gives no rows. doc_id must be a number.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from .common import bounded_batches, by_slices, stored, text_of, without

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: First bit and bits of each block.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a cell that one task compares by itself.
CELL_ROWS = 16_384
TILE = 128
#: Fingerprint copies that a task compares: their comparison costs far more than their bytes say.
TASK_ROWS = 1 << 17


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space, word shingles with repeats."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle_words, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the fingerprint as a signed long) of every row of docs(doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def work(columns: list[list]) -> dict:
        fp = np.array([fingerprint(t, shingle_words) for t in columns[2]], np.uint64)
        return {"doc_id": columns[0], "text_key": columns[1], "fp": pa.array(fp.view(np.int64))}

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(text_of()), text_of()).mapInArrow(by_slices(work, schema), "doc_id long, text_key long, fp long")


class CoveringCode:
    """A linear code by the syndromes of its single bits: from any word, the codewords around it."""

    def __init__(self, n: int, syndromes: list[int]):
        self.n = n
        self.single = np.array(syndromes, np.int64)
        size = 1 << int(np.bitwise_or.reduce(self.single)).bit_length()
        self.by_weight: list[list[list[int]]] = []
        leader = np.full(size, -1, np.int64)
        self.radius, weight = 0, 0
        while (leader < 0).any():
            patterns = self.patterns(weight)
            for syndrome, e in patterns:
                if leader[syndrome] < 0:
                    leader[syndrome], self.radius = e, weight
            weight += 1
        self.leader = leader

    def patterns(self, weight: int) -> list[tuple[int, int]]:
        """(syndrome, bits) of all words of a weight."""
        out = []
        for places in combinations(range(self.n), weight):
            syndrome = bits = 0
            for p in places:
                syndrome, bits = syndrome ^ int(self.single[p]), bits | 1 << p
            out.append((syndrome, bits))
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for p in range(self.n):
            out ^= np.where(words >> p & 1, self.single[p], 0)
        return out

    @lru_cache(maxsize=8)  # noqa: B019 (the few codes live as long as the process)
    def around(self, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """By syndrome, where in the second array the words up to a weight of reach begin; those words."""
        found = sorted(x for w in range(reach + 1) for x in self.patterns(w))
        syndromes = np.array([s for s, _ in found])
        return np.searchsorted(syndromes, np.arange(len(self.leader) + 1)), np.array([e for _, e in found], np.int64)

    def anchors(self, words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Every codeword within reach of each word: (index of the word, codeword)."""
        begin, bits = self.around(reach)
        s = self.syndrome(words)
        count = begin[s + 1] - begin[s]
        index = np.repeat(np.arange(len(words)), count)
        place = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + begin[s][index]
        return index, words[index] ^ bits[place]

    def home(self, words: np.ndarray) -> np.ndarray:
        return words ^ self.leader[self.syndrome(words)]


def _golay_syndromes() -> list[int]:
    """x^i modulo the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code."""
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= 0b101011100011
    return out


@lru_cache(maxsize=1)
def codes() -> tuple[CoveringCode, ...]:
    golay = CoveringCode(23, _golay_syndromes())
    # Free bits have syndrome 0: no check, so every setting of them is an anchor of its own.
    return golay, golay, CoveringCode(18, [*range(1, 16), 0, 0, 0])


def _cut(fp: np.ndarray, block: int) -> np.ndarray:
    first, n = BLOCKS[block]
    return (fp.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << n) - 1)


_CELL_SCHEMA = pa.schema([("cell", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])
_CELL = "cell long, fp long, home boolean"


def _deal(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, level: int, distance: int):
    """Rows (cell, level, fp, home) of a level. Its cells' numbers say which block or part they are of.

    0: the anchors of each block. 1: within a cell, the bits of the other blocks fall into distance + 1
    parts, one of which is equal; its code is the trivial one, every word an anchor of radius 0."""
    if level == 0:
        for block in range(len(BLOCKS)):
            code, words = codes()[block], _cut(fp, block)
            index, anchor = code.anchors(words, code.radius + distance // len(BLOCKS))
            yield anchor << 2 | block, fp[index], (anchor == code.home(words)[index]) & home[index]
        return
    for block in range(len(BLOCKS)):
        rows = np.flatnonzero((cell & 3) == block)
        first, n = BLOCKS[block]
        bits = fp[rows].view(np.uint64)
        rest = (bits & np.uint64((1 << first) - 1)) | (bits >> np.uint64(first + n) << np.uint64(first) if first + n < 64 else np.uint64(0))
        size, parts = 64 - n, distance + 1
        for part in range(parts):
            low, high = part * size // parts, (part + 1) * size // parts
            value = (rest >> np.uint64(low) & np.uint64((1 << high - low) - 1)).astype(np.int64)
            yield (cell[rows] << 4 | part) << 16 | value, fp[rows], home[rows]


def _dealer(level: int, distance: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cell, fp, home = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for out in _deal(cell, fp, home.astype(bool), level, distance):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _CELL_SCHEMA, strict=True)], schema=_CELL_SCHEMA)

    return run


def forest(home: np.ndarray, all_: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (member, root) that span what the links of home with all_ (both sorted, distinct) connect.

    Breadth first: what a found fingerprint reaches leaves the rest, so a dense cell costs few comparisons.
    """
    n, is_home = len(all_), np.zeros(len(all_), bool)
    is_home[np.searchsorted(all_, home)] = True
    bits = all_.view(np.uint64)
    rest, out = np.arange(n), []
    while len(rest):
        root, ring, rest = rest[0], rest[:1], rest[1:]
        while len(ring) and len(rest):
            found = np.zeros(len(rest), bool)
            for at in range(0, len(ring), TILE):
                rows = ring[at : at + TILE]
                open_ = np.flatnonzero(~found)
                near = np.bitwise_count(bits[rows][:, None] ^ bits[rest[open_]][None, :]) <= distance
                # A link counts where one of the two is at home; the other pairs are found in the other's home cell.
                near &= is_home[rows][:, None] | is_home[rest[open_]][None, :]
                found[open_[near.any(axis=0)]] = True
            ring, rest = rest[found], rest[~found]
            out += [(int(all_[i]), int(all_[root])) for i in ring]
    return out


_EDGE = "u long, v long"
_EDGE_SCHEMA = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _compare(distance: int):
    """Over rows sorted by cell and fp: the links of each cell. A cell's rows may continue in the next batch."""

    def edges(cell: tuple[np.ndarray, np.ndarray]):
        fp, home = cell
        every, inverse = np.unique(fp, return_inverse=True)
        at_home = np.zeros(len(every), bool)
        np.logical_or.at(at_home, inverse, home)
        return forest(every[at_home], every, distance) if len(every) > 1 and at_home.any() else []

    def run(batches):
        held, last = [], None
        links: list[tuple[int, int]] = []

        def done():
            links.extend(edges(tuple(np.concatenate(x) for x in zip(*held, strict=True))))
            held.clear()

        for batch in batches:
            cell, fp, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True):
                if a == b:
                    continue
                if held and last != cell[a]:
                    done()
                last = cell[a]
                held.append((fp[a:b], home[a:b].astype(bool)))
            if len(links) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_EDGE_SCHEMA)
                links.clear()
        if held:
            done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], schema=_EDGE_SCHEMA)

    return run


def _points(reach: int):
    """Masks of up to reach of the 64 bits."""
    return np.array([sum(1 << p for p in places) for w in range(reach + 1) for places in combinations(range(64), w)], np.uint64)


def _through_points(dense: DataFrame, distance: int) -> DataFrame:
    """Links of fingerprints of dense cells through the points around them: to the smallest around each point."""
    masks = _points(distance // 2)

    def spread(batches):
        schema = pa.schema([("point", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 256):
                x = fp[at : at + 256]
                points = (x.view(np.uint64)[:, None] ^ masks[None, :]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points.ravel()), pa.array(np.repeat(x, len(masks)))], schema=schema)

    near = dense.select("fp").distinct().mapInArrow(spread, "point long, fp long")
    # A point has as many fingerprints around it as there are masks, at most.
    around = near.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    return around.select(F.explode(F.expr("slice(fps, 2, size(fps))")).alias("u"), F.expr("fps[0]").alias("v")).distinct()


def links(nodes: DataFrame, distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """u, v: links between distinct fingerprints nodes(fp) that connect exactly what distance bits connect."""
    if distance % 2:
        raise ValueError("an even number of bits is needed for the points of dense cells")
    found = None
    rows = nodes.select(F.lit(0).cast("long").alias("cell"), "fp", F.lit(True).alias("home"))
    for level in range(2):
        dealt = stored(rows.mapInArrow(_dealer(level, distance), _CELL), f"anchors{level}")
        # Counts are pre-aggregated; only cells above the bound are carried on.
        tasks = max(1, -(-dealt.count() // TASK_ROWS))
        large = stored(dealt.groupBy("cell").count().filter(F.col("count") > cell_rows).select("cell"), f"large{level}")
        some_large = not large.isEmpty()
        small = dealt.join(large, "cell", "left_anti") if some_large else dealt
        compared = small.select("cell", "fp", "home").repartition(tasks, "cell").sortWithinPartitions("cell", "fp").mapInArrow(_compare(distance), _EDGE)
        found = compared if found is None else found.unionByName(compared)
        if not some_large:
            return found.distinct()
        rows = dealt.join(large, "cell", "left_semi").select("cell", "fp", "home")
    return found.unionByName(_through_points(rows, distance)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) of every node with an edge of edges(u, v)."""
    return graph.components(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"))).withColumnsRenamed({"component": "root"})


def classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, text_key, fp, root, component_id of every row of docs(doc_id, text)."""
    prints = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = components(links(nodes.select("fp"), distance, cell_rows))
    rooted = stored(nodes.join(linked, nodes.fp == linked.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    # As a table of its own: Spark can then broadcast it if small, or split a class of very many fingerprints at the join.
    lowest = stored(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    by_fp = rooted.join(lowest, "root").select("fp", "root", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def first_of_class(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of docs for each class, with all its columns: that of the smallest doc_id (nulls last, then by a hash of the text)."""
    found = stored(classes(docs, shingle_words, distance).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n")), "class-members")
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n")
    # The smallest of each class is combined before the shuffle; the others are then told by their own keys,
    # so a class of any size is never brought together.
    first = found.groupBy("root").agg(F.min(who).alias("w"))
    first = stored(first.select(F.col("w.id").alias("_id"), F.col("w.key").alias("_key"), F.col("w.n").alias("_n")), "class-firsts")
    is_first = found["doc_id"].eqNullSafe(first["_id"]) & (found["text_key"] == first["_key"])
    gone = stored(found.join(first, is_first, "left_anti").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "class-gone")

    out = without(docs, gone)
    again = first.filter("_n > 1").select("_id", "_key")
    if again.isEmpty():
        return out
    again = stored(again, "class-repeats")
    same = out["doc_id"].eqNullSafe(again["_id"]) & (F.xxhash64(F.coalesce(out["text"], F.lit(""))) == again["_key"])
    return without(out, again).unionByName(out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
